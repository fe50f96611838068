"""Queries for networks, set operations and the flagship basin report."""
from pyspark.sql import functions as F

from bermline.operators import cells as C
from bermline.operators import graphs as GR
from bermline.operators import robust as RB
from bermline.plans import views as V
from bermline.plans.registry import query, rounded
from bermline.session import cut_lineage

_BASIN = """RECURSIVE t AS (SELECT comid, comid AS cur, next_down AS nxt FROM reaches UNION ALL
 SELECT t.comid, r.comid, r.next_down FROM t JOIN reaches r ON t.nxt = r.comid WHERE t.nxt > 0),
 b AS (SELECT t.comid, t.cur AS basin_id FROM t WHERE t.nxt <= 0 OR t.nxt NOT IN (SELECT comid FROM reaches))"""


@query("n1_trace_outlets", f"WITH {_BASIN} SELECT comid, basin_id FROM b")
def n1(spark, d):
    return GR.trace_outlets(V.reaches(spark, d))


@query("j15_map_key", f"WITH {_BASIN} SELECT id, basin_id FROM points JOIN b USING (comid)")
def j15(spark, d):
    b = GR.trace_outlets(V.reaches(spark, d))
    return C.map_key(V.points(spark, d).select("id", "comid"), b, "comid", "basin_id").select("id", "basin_id")


def report(spark, d, radius=15.0, min_uparea=50000.0):
    """Segments take the largest reach within the radius, reaches flow to their outlet, basins are summed up.

    The largest reach passes the threshold exactly when any does, so small reaches are left out before the join.
    """
    reaches = V.reaches(spark, d)
    large = reaches.filter(F.col("uparea") >= min_uparea).select("comid", "uparea", "x", "y")
    seg = C.within_distance_best(V.segments(spark, d), large, radius)
    basins = cut_lineage(GR.trace_outlets(reaches))
    tagged = C.map_key(seg, basins, "comid", "basin_id")
    return RB.basin_report(tagged, reaches, basins, min_uparea)


@query("a27_basin_report", f"""WITH {_BASIN}, m AS (SELECT segment_id, length_m, comid, uparea FROM (SELECT s.*, r.comid, r.uparea, row_number() OVER (PARTITION BY s.segment_id ORDER BY r.uparea DESC, r.comid) AS rn
  FROM segments s JOIN reaches r ON r.x BETWEEN s.x - 15 AND s.x + 15 AND r.y BETWEEN s.y - 15 AND s.y + 15 AND sqrt((r.x-s.x)^2+(r.y-s.y)^2) <= 15) WHERE rn = 1 AND uparea >= 50000),
 g AS (SELECT basin_id, count(*) AS n_positive_segments, round(sum(length_m) / 1000.0, 1) AS levee_length_km FROM m JOIN b USING (comid) GROUP BY 1)
 SELECT basin_id, n_positive_segments, levee_length_km, round(x, 1) AS outlet_x, round(y, 1) AS outlet_y,
 (SELECT count(*) FROM reaches r JOIN b USING (comid) WHERE b.basin_id = g.basin_id AND r.uparea >= 50000) AS n_reaches_ge_thresh FROM g JOIN reaches ON basin_id = comid""")
def a27(spark, d):
    return report(spark, d)


@query("n2_coverage_groups")
def n2(spark, d):
    s = V.scenes(spark, d)
    cells = s.selectExpr("scene_id", "block", "explode(sequence(cx0, cx0 + w)) AS cx", "cy0", "hh").selectExpr(
        "scene_id", "block", "cx", "explode(sequence(cy0, cy0 + hh)) AS cy").filter("cx < 20 AND cy < 20").selectExpr("scene_id", "cx + block * 20 AS cx", "cy")
    aoi = V.table(spark, d, "supplier").selectExpr("s_suppkey div 100 * 20 AS b").distinct().selectExpr("b", "explode(sequence(0, 19)) AS i").selectExpr("b + i AS cx", "explode(sequence(0, 19)) AS cy")
    return rounded(GR.coverage_groups(cells, aoi, 0.5))


@query("u1_union_aligned", "SELECT comid, uparea, NULL::DOUBLE AS h, NULL AS flag FROM reaches UNION ALL SELECT comid, NULL, h, flag FROM points")
def u1(spark, d):
    return GR.union_aligned(V.reaches(spark, d).select("comid", "uparea"), V.points(spark, d).select("comid", "h", "flag"))


@query("u2_coalesce_columns", "SELECT doc_id, coalesce(quality, CAST(n_chars AS INT)) AS key FROM documents LEFT JOIN labels USING (doc_id)")
def u2(spark, d):
    x = V.table(spark, d, "documents").join(V.table(spark, d, "labels"), "doc_id", "left").selectExpr("doc_id", "quality", "CAST(n_chars AS INT) AS n")
    return GR.coalesce_columns(x, "quality", "n", "key")
