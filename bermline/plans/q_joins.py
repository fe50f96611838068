"""Queries for spatial joins and lookups."""
from pyspark.sql import functions as F

from bermline.operators import cells as C
from bermline.operators import windows as W
from bermline.plans import views as V
from bermline.plans.q_rasters import tile_grid
from bermline.plans.q_rows import domain
from bermline.plans.registry import query, rounded

N = lambda: F.count(F.lit(1)).alias("n")
L = lambda c: F.col(c).cast("long").alias(c)


def dist(px: str = "p.x", py: str = "p.y", e: str = "e") -> str:
    t = f"greatest(0.0, least(1.0, (({px}-{e}.x0)*({e}.x1-{e}.x0)+({py}-{e}.y0)*({e}.y1-{e}.y0))/(({e}.x1-{e}.x0)^2+({e}.y1-{e}.y0)^2)))"
    return f"sqrt(({px}-({e}.x0+{t}*({e}.x1-{e}.x0)))^2+({py}-({e}.y0+{t}*({e}.y1-{e}.y0)))^2)"


def near(r: float, p: str = "p", e: str = "e") -> str:
    """Point in the box of an edge grown by r (edges run up and right)."""
    return f"{p}.x BETWEEN {e}.x0 - {r} AND {e}.x1 + {r} AND {p}.y BETWEEN {e}.y0 - {r} AND {e}.y1 + {r}"


_PL = lambda r: f"(SELECT p.*, e.line_id, {dist()} AS d FROM points p JOIN line_edges e ON {near(r)} WHERE {dist()} <= {r})"


def pts(spark, d):
    return V.points(spark, d).select("id", "x", "y", "h")


@query("j0_cell_keys", """SELECT c // 1000000 AS cx, c % 1000000 AS cy, count(*) AS n FROM (SELECT CAST(i AS BIGINT) * 1000000 + j AS c FROM (SELECT *, unnest(range(CAST(floor((x - 12) / 50) AS BIGINT), CAST(floor((x + 12) / 50) AS BIGINT) + 1)) AS i FROM
 (SELECT *, unnest(range(CAST(floor((y - 12) / 50) AS BIGINT), CAST(floor((y + 12) / 50) AS BIGINT) + 1)) AS j FROM (SELECT x + 100 AS x, y + 100 AS y FROM points)))) GROUP BY 1, 2""")
def j0(spark, d):
    p = pts(spark, d).select((F.col("x") + 100).alias("x"), (F.col("y") + 100).alias("y"))
    return C.cell_keys(p, 50.0, 12.0).groupBy("cx", "cy").agg(N())


@query("j1_intersects_join", f"""SELECT DISTINCT p.comid, e.line_id FROM reaches p JOIN line_edges e ON e.x0 <= p.x + 20 AND e.x1 >= p.x - 20 AND e.y0 <= p.y + 20 AND e.y1 >= p.y - 20
 WHERE greatest((p.x-20-e.x0)/(e.x1-e.x0), (p.y-20-e.y0)/(e.y1-e.y0), 0.0) <= least((p.x+20-e.x0)/(e.x1-e.x0), (p.y+20-e.y0)/(e.y1-e.y0), 1.0)""")
def j1(spark, d):
    b = V.reaches(spark, d).selectExpr("comid", "x - 20 AS xmin", "y - 20 AS ymin", "x + 20 AS xmax", "y + 20 AS ymax")
    return C.intersects_join(b, V.lines(spark, d), 0.0, 60.0, "comid", "line_id")


@query("j2_within_distance_best", """SELECT segment_id, comid, uparea FROM (SELECT s.segment_id, r.comid, r.uparea, row_number() OVER (PARTITION BY s.segment_id ORDER BY r.uparea DESC, r.comid) AS rn
 FROM segments s JOIN reaches r ON r.x BETWEEN s.x - 15 AND s.x + 15 AND r.y BETWEEN s.y - 15 AND s.y + 15 AND sqrt((r.x-s.x)^2+(r.y-s.y)^2) <= 15) WHERE rn = 1""")
def j2(spark, d):
    return C.within_distance_best(V.segments(spark, d), V.reaches(spark, d).select("comid", "uparea", "x", "y"), 15.0).select("segment_id", "comid", "uparea")


def reach_lines(spark, d):
    """Each reach as a line of two edges."""
    return V.reaches(spark, d).selectExpr("comid", "uparea", "array(struct(x AS x, y AS y), struct(x + 12 AS x, y + 7 AS y), struct(x + 25 AS x, y AS y)) AS pts")


_RL = "SELECT comid, uparea, x AS x0, y AS y0, x + 12 AS x1, y + 7 AS y1 FROM reaches UNION ALL SELECT comid, uparea, x + 12, y + 7, x + 25, y FROM reaches"


def edge_gap(a: str, b: str) -> str:
    """Distance of two edges: none if they cross, else that of one of the four ends."""
    side = lambda e, q, k: f"(({e}.x1-{e}.x0)*({q}.y{k}-{e}.y0)-({e}.y1-{e}.y0)*({q}.x{k}-{e}.x0))"
    ends = [dist(f"{q}.x{k}", f"{q}.y{k}", e) for e, q in ((a, b), (b, a)) for k in (0, 1)]
    return f"CASE WHEN {side(a, b, 0)}*{side(a, b, 1)} < 0 AND {side(b, a, 0)}*{side(b, a, 1)} < 0 THEN 0 ELSE least({', '.join(ends)}) END"


@query("j2_lines_within_best", f"""WITH r AS ({_RL}) SELECT line_id, comid, uparea FROM (SELECT e.line_id, r.comid, r.uparea, row_number() OVER (PARTITION BY e.line_id ORDER BY r.uparea DESC, r.comid) AS rn
 FROM line_edges e JOIN r ON r.x0 <= e.x1 + 10 AND r.x1 >= e.x0 - 10 AND least(r.y0, r.y1) <= e.y1 + 10 AND greatest(r.y0, r.y1) >= e.y0 - 10 WHERE {edge_gap('e', 'r')} <= 10) WHERE rn = 1""")
def j2l(spark, d):
    return C.lines_within_best(V.lines(spark, d), reach_lines(spark, d), 10.0, left_id="line_id")


@query("j3_nearest_line_join", f"""SELECT comid, m.l AS line_id, round(m.d, 6) AS d FROM (SELECT p.comid, min({{'d': {dist()}, 'l': e.line_id}}) AS m FROM reaches p, line_edges e GROUP BY p.comid)""")
def j3l(spark, d):
    return rounded(C.nearest_line_join(V.reaches(spark, d).select("comid", "x", "y"), V.lines(spark, d)).select("comid", "line_id", "d"))


@query("j3_nearest_join", """SELECT id, comid, round(d, 6) AS d FROM (SELECT p.id, r.comid, sqrt((p.x-r.x)^2+(p.y-r.y)^2) AS d, row_number() OVER (PARTITION BY p.id ORDER BY (p.x-r.x)^2+(p.y-r.y)^2, r.comid) AS rn
 FROM points p JOIN reaches r ON r.x BETWEEN p.x - 120 AND p.x + 120 AND r.y BETWEEN p.y - 120 AND p.y + 120) WHERE rn = 1""")
def j3(spark, d):
    return rounded(C.nearest_join(pts(spark, d), V.reaches(spark, d).select("comid", "x", "y"), "comid").select("id", "comid", "d"))


@query("j4_nearest_within", f"SELECT id, line_id, round(d, 6) AS d FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, line_id) AS rn FROM {_PL(10)}) WHERE rn = 1")
def j4(spark, d):
    return rounded(C.nearest_within(pts(spark, d), V.lines(spark, d), 10.0).select("id", "line_id", "d"))


@query("j4_nearest_within_left", f"SELECT id, round(d, 6) AS d FROM (SELECT DISTINCT id FROM points) LEFT JOIN (SELECT id, min(d) AS d FROM {_PL(5)} GROUP BY 1) USING (id)")
def j4l(spark, d):
    return rounded(C.nearest_within(pts(spark, d), V.lines(spark, d), 5.0, how="left").select("id", "d"))


@query("j5_assign_to_segments", f"SELECT line_id AS segment_id, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, line_id) AS rn FROM {_PL(7)}) WHERE rn = 1 GROUP BY 1")
def j5(spark, d):
    s = V.lines(spark, d).withColumnRenamed("line_id", "segment_id")
    return C.assign_to_segments(pts(spark, d), s, 7.0).groupBy("segment_id").agg(N())


@query("j6_within_buffer_semi", f"SELECT DISTINCT id FROM {_PL(8)}")
def j6(spark, d):
    return C.within_buffer_semi(pts(spark, d), V.lines(spark, d), 8.0).select("id")


@query("j6_within_buffer_share", f"SELECT near, count(*) AS n FROM (SELECT id, id IN (SELECT id FROM {_PL(3)}) AS near FROM points) GROUP BY 1")
def j6f(spark, d):
    return C.within_buffer_semi(pts(spark, d), V.lines(spark, d), 3.0, flag="near").groupBy("near").agg(N())


@query("j7_clip_lines", """SELECT line_id, polygon_id, edge, round((tb - ta) * len, 4) AS len FROM (SELECT line_id, polygon_id, CAST(edge AS BIGINT) AS edge, greatest(0.0, least((p0-x0)/(x1-x0), (p0+60-x0)/(x1-x0)), least((100.0-y0)/(y1-y0), (1500.0-y0)/(y1-y0))) AS ta,
 least(1.0, greatest((p0-x0)/(x1-x0), (p0+60-x0)/(x1-x0)), greatest((100.0-y0)/(y1-y0), (1500.0-y0)/(y1-y0))) AS tb, sqrt((x1-x0)^2+(y1-y0)^2) AS len
 FROM line_edges, (SELECT DISTINCT p_partkey // 50 AS polygon_id, (p_partkey // 50) * 75.0::DOUBLE AS p0 FROM part)) WHERE tb > ta""")
def j7(spark, d):
    c = C.clip_lines(V.lines(spark, d), domain(spark, d), 100.0).filter("len > 0")
    return rounded(c.groupBy("line_id", "polygon_id", L("edge")).agg(F.sum("len").alias("len")), places=4)


def triangles(spark, d):
    return V.table(spark, d, "part").selectExpr("p_partkey div 40 AS polygon_id").distinct().selectExpr(
        "polygon_id", "array(array(struct(60.0D * polygon_id + 3 AS x, 50.5D AS y), struct(60.0D * polygon_id + 55.3D AS x, 400.5D AS y), struct(60.0D * polygon_id + 3 AS x, 1800.5D AS y), struct(60.0D * polygon_id + 3 AS x, 50.5D AS y))) AS parts")


@query("j8_point_in_polygon", """WITH t AS (SELECT DISTINCT p_partkey // 40 AS polygon_id, (p_partkey // 40) * 60.0::DOUBLE + 3 AS x0 FROM part)
 SELECT id, polygon_id FROM points JOIN t ON x > x0 AND x < x0 + 52.3 AND y > 50.5 AND y < 1800.5 WHERE x < x0 + CASE WHEN y <= 400.5 THEN (y - 50.5) / 350 * 52.3 ELSE (1800.5 - y) / 1400 * 52.3 END""")
def j8(spark, d):
    # points on the left edge (x = x0) are cut off on both sides
    p = pts(spark, d).withColumn("x", F.col("x") + 1e-7)
    return C.point_in_polygon(p, triangles(spark, d), "inner", 60.0).select("id", "polygon_id").join(
        V.points(spark, d).select(F.col("id").alias("i2"), "x"), F.col("id") == F.col("i2")).filter("x > 60.0D * polygon_id + 3").select("id", "polygon_id")


@query("j9_line_intersections", """SELECT DISTINCT a_id, b_id, round(round(x, 6), 4) AS x, round(round(y, 6), 4) AS y FROM (SELECT a.line_id AS a_id, b.line_id AS b_id, a.x0 + t * (a.x1 - a.x0) AS x, a.y0 + t * (a.y1 - a.y0) AS y FROM
 (SELECT *, ((b.x0-a.x0)*(b.y1-b.y0)-(b.y0-a.y0)*(b.x1-b.x0))/det AS t, ((b.x0-a.x0)*(a.y1-a.y0)-(b.y0-a.y0)*(a.x1-a.x0))/det AS s FROM
  (SELECT a, b, (a.x1-a.x0)*(b.y1-b.y0)-(a.y1-a.y0)*(b.x1-b.x0) AS det FROM line_edges a JOIN line_edges b ON a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1
   WHERE a.line_id % 2 = 0 AND b.line_id % 2 = 1) WHERE det <> 0) WHERE t BETWEEN 0 AND 1 AND s BETWEEN 0 AND 1)""")
def j9(spark, d):
    ln = V.lines(spark, d)
    a = ln.filter("line_id % 2 = 0").selectExpr("line_id AS a_id", "pts")
    b = ln.filter("line_id % 2 = 1").selectExpr("line_id AS b_id", "pts")
    return rounded(C.line_intersections(a, b, 50.0), places=4).distinct()


@query("j11_exclude_near", f"SELECT id FROM points WHERE id NOT IN (SELECT id FROM {_PL(12)})")
def j11(spark, d):
    return C.exclude_near(pts(spark, d), V.lines(spark, d), 12.0).select("id")


@query("j12_endpoint_pairs", """WITH e AS (SELECT line_id, 0 AS port, ax AS x, ay AS y, ax - cx AS dx, ay - cy AS dy FROM lines UNION ALL SELECT line_id, 1, cx, cy, cx - ax, cy - ay FROM lines),
 p AS (SELECT a.line_id AS a_id, a.port AS a_port, b.line_id AS b_id, b.port AS b_port, sqrt((a.x-b.x)^2+(a.y-b.y)^2) AS gap, (b.x-a.x) AS ux, (b.y-a.y) AS uy, a.dx AS adx, a.dy AS ady, b.dx AS bdx, b.dy AS bdy
  FROM (SELECT line_id, port, x::DOUBLE AS x, y::DOUBLE AS y, dx::DOUBLE AS dx, dy::DOUBLE AS dy FROM e) a JOIN (SELECT line_id, port, x::DOUBLE AS x, y::DOUBLE AS y, dx::DOUBLE AS dx, dy::DOUBLE AS dy FROM e) b
  ON a.line_id < b.line_id AND b.x BETWEEN a.x - 30 AND a.x + 30 AND b.y BETWEEN a.y - 30 AND a.y + 30)
 SELECT a_id, a_port, b_id, b_port, round(gap, 6) AS gap FROM p WHERE gap <= 30 AND gap > 0
 AND degrees(acos(greatest(-1.0, least(1.0, (adx*ux+ady*uy)/(gap*sqrt(adx^2+ady^2)))))) <= 60.0 AND degrees(acos(greatest(-1.0, least(1.0, -(bdx*ux+bdy*uy)/(gap*sqrt(bdx^2+bdy^2)))))) <= 60.0""")
def j12(spark, d):
    p = C.endpoint_pairs(V.lines(spark, d).select("line_id", "pts"), 30.0, 60.0).filter("gap > 1e-5")
    return rounded(p)


@query("j13_attach_source", """WITH m AS (SELECT 'p' || l_orderkey AS patch_id, l_orderkey FROM lineitem UNION ALL SELECT 'n' || o_orderkey, o_orderkey FROM orders)
 SELECT patch_id, CASE WHEN o_custkey % 3 <> 0 THEN o_custkey END AS source_idx FROM (SELECT DISTINCT * FROM m) LEFT JOIN orders ON o_orderkey = l_orderkey""")
def j13(spark, d):
    o = V.table(spark, d, "orders")
    k = V.table(spark, d, "lineitem").select("l_orderkey").distinct()
    pos = o.selectExpr("concat('p', o_orderkey) AS patch_id", "o_custkey AS segment_id")
    neg = o.selectExpr("concat('n', o_orderkey) AS patch_id", "concat('p', o_orderkey) AS source_positive_id")
    seg = V.table(spark, d, "customer").selectExpr("c_custkey AS segment_id", "CASE WHEN c_custkey % 3 <> 0 THEN c_custkey END AS source_idx")
    meta = k.selectExpr("concat('p', l_orderkey) AS patch_id").union(o.selectExpr("concat('n', o_orderkey)"))
    return C.attach_source(meta, seg, pos, neg)


@query("j14_attach_split", "SELECT patch_id, region, tp, CASE WHEN vec_id % 4 = 0 THEN 'val' ELSE 'train' END AS split FROM confusion JOIN patch_meta USING (patch_id, region)")
def j14(spark, d):
    m = V.patches(spark, d).selectExpr("region", "patch_id", "CASE WHEN vec_id % 4 = 0 THEN 'val' ELSE 'train' END AS split")
    return C.attach_split(V.results(spark, d).select("region", "patch_id", "tp"), m)


@query("j16_id_hits", """SELECT 'orders' AS table_name, 'o_custkey' AS column_name, count(*) AS hits FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)
 UNION ALL SELECT 'orders', 'o_orderkey', count(*) FROM orders WHERE o_orderkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)
 UNION ALL SELECT 'lineitem', 'l_suppkey', count(*) FROM lineitem WHERE l_suppkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""")
def j16(spark, d):
    ids = V.table(spark, d, "customer").filter("c_acctbal < 0").selectExpr("c_custkey AS id")
    t = {"orders": V.table(spark, d, "orders"), "lineitem": V.table(spark, d, "lineitem")}
    return C.id_hits(ids, t, {"orders": ["o_custkey", "o_orderkey"], "lineitem": ["l_suppkey"]})


def sites(spark, d):
    """Points on the patch mosaic: the middle of every patch, moved a little by its key."""
    g = tile_grid(spark, d)
    return g, V.table(spark, d, "embeddings").selectExpr("vec_id AS id", "(vec_id % 16 * 8 + 3) * 10.0D + (vec_id % 7) * 1.5D AS x", f"{g.y0}D - (vec_id div 16 * 8 + 3) * 10.0D - (vec_id % 5) * 1.7D AS y")


_SITE = """s AS (SELECT vec_id AS id, ((vec_id % 16 * 8 + 3) * 10.0 + (vec_id % 7) * 1.5) / 10.0 AS c, ((vec_id // 16 * 8 + 3) * 10.0 + (vec_id % 5) * 1.7) / 10.0 AS r FROM embeddings),
 f AS (SELECT id, c::DOUBLE AS c, r::DOUBLE AS r, floor(c - 0.5) AS c0, floor(r - 0.5) AS r0, c - 0.5 - floor(c - 0.5) AS u, r - 0.5 - floor(r - 0.5) AS w FROM s)"""


def holes(spark, d):
    return V.mosaic(spark, d).selectExpr("row", "col", "CASE WHEN value >= -0.15 THEN value END AS value")


@query("j17_sample_bilinear", f"""WITH {_SITE} SELECT id, round(v, 6)::DOUBLE AS value FROM (SELECT id, sum(k * value) / nullif(sum(k), 0) AS v FROM (SELECT id, value, CASE WHEN row = r0 THEN 1 - w ELSE w END * CASE WHEN col = c0 THEN 1 - u ELSE u END AS k
 FROM f JOIN mosaic ON row BETWEEN r0 AND r0 + 1 AND col BETWEEN c0 AND c0 + 1 WHERE value >= -0.15) GROUP BY 1) RIGHT JOIN (SELECT id FROM s) USING (id)""")
def j17(spark, d):
    g, p = sites(spark, d)
    return rounded(C.sample_bilinear(p, holes(spark, d), g.x0, g.y0, g.res, g.nrows, g.ncols).select("id", "value"))


@query("j18_sample_nearest", f"WITH {_SITE} SELECT id, round(CASE WHEN value >= -0.15 THEN value END, 6) AS value FROM f LEFT JOIN mosaic ON row = round_even(r, 0) AND col = round_even(c, 0)")
def j18(spark, d):
    g, p = sites(spark, d)
    return rounded(C.sample_nearest(p, holes(spark, d), g.x0, g.y0, g.res).select("id", "value"))


_WIN = "(SELECT f.id, value FROM f JOIN mosaic ON row BETWEEN trunc(r) - 1 AND trunc(r) + 1 AND col BETWEEN trunc(c) - 1 AND trunc(c) + 1 WHERE value >= -0.15)"


@query("j19_sample_window_max", f"WITH {_SITE} SELECT id, round(v, 6) AS value FROM s LEFT JOIN (SELECT id, max(value) AS v FROM {_WIN} GROUP BY 1) USING (id)")
def j19(spark, d):
    g, p = sites(spark, d)
    return rounded(C.sample_window(p, holes(spark, d), g.x0, g.y0, g.res, g.nrows, g.ncols, 5.0).select("id", "value"))


@query("j19_sample_window_median", f"WITH {_SITE} SELECT id, round(v, 6) AS value FROM s LEFT JOIN (SELECT id, quantile_cont(value, 0.5) AS v FROM {_WIN} GROUP BY 1) USING (id)")
def j19m(spark, d):
    g, p = sites(spark, d)
    return rounded(C.sample_window(p, holes(spark, d), g.x0, g.y0, g.res, g.nrows, g.ncols, 1.0, "median").select("id", "value"))


@query("j20_sample_on_axis", """WITH s AS (SELECT vec_id AS id, (vec_id % 16 * 8 + 3) * 10.0 + (vec_id % 7) * 1.5 AS x, vec_id // 16 AS b FROM embeddings), q AS (SELECT id, CAST(floor(x / 10) AS BIGINT) AS c, b * 8 + 4 AS r FROM s)
 SELECT q.id, round(max(m.value), 6) AS value FROM q JOIN mosaic m ON m.row BETWEEN r - 1 AND r + 1 AND m.col BETWEEN c - 1 AND c + 1 GROUP BY 1""")
def j20(spark, d):
    """Axis lines run along the middle of every patch row."""
    g, p = sites(spark, d)
    ln = V.table(spark, d, "embeddings").selectExpr("vec_id div 16 AS b").distinct().selectExpr("b AS axis", f"array(struct(0.0D AS x, {g.y0}D - b * 80 - 45 AS y), struct(1280.0D AS x, {g.y0}D - b * 80 - 45 AS y)) AS pts")
    return rounded(C.sample_on_axis(p, ln, V.mosaic(spark, d), g.x0, g.y0, g.res, g.nrows, g.ncols, 40.0).select("id", "value"))


@query("j22_coverage_share", """WITH a AS (SELECT DISTINCT s_suppkey // 100 * 20 + i AS cx, j AS cy FROM supplier, range(20) x(i), range(20) y(j)), f AS (SELECT scene_id, block * 20 + cx0 AS x0, cy0 AS y0, w, hh FROM scenes)
 SELECT scene_id, count(cx) AS cells, round(count(cx) / (SELECT count(*) FROM a), 6) AS share FROM f LEFT JOIN a ON cx >= x0 AND cx < x0 + w AND cy >= y0 AND cy < y0 + hh GROUP BY 1""")
def j22(spark, d):
    box = lambda x0, y0, x1, y1: f"array(array(struct(CAST({x0} AS DOUBLE) AS x, CAST({y0} AS DOUBLE) AS y), struct(CAST({x1} AS DOUBLE) AS x, CAST({y0} AS DOUBLE) AS y), struct(CAST({x1} AS DOUBLE) AS x, CAST({y1} AS DOUBLE) AS y), struct(CAST({x0} AS DOUBLE) AS x, CAST({y1} AS DOUBLE) AS y), struct(CAST({x0} AS DOUBLE) AS x, CAST({y0} AS DOUBLE) AS y))) AS parts"
    f = V.scenes(spark, d).selectExpr("scene_id", box("block * 20 + cx0", "cy0", "block * 20 + cx0 + w", "cy0 + hh"))
    a = V.table(spark, d, "supplier").selectExpr("s_suppkey div 100 AS b").distinct().selectExpr(box("b * 20", "0", "b * 20 + 20", "20"))
    return rounded(C.coverage_share(f, a, 1.0))


@query("j23_windows_with_line")
def j23(spark, d):
    b = V.lines(spark, d).agg(F.max(F.col("pts")[2]["x"])).first()[0]
    return C.windows_with_line(V.lines(spark, d), 50.0, (0.0, 0.0, b, 1000.0))


@query("a35_profile_visibility", """WITH v AS (SELECT raster_id, row, max(value) FILTER (col = 4) - min(value) FILTER (col < 2 OR col >= 6) AS p FROM pixels GROUP BY 1, 2)
 SELECT round(quantile_cont(p, 0.5), 6) AS median, round(avg(p), 6) AS mean, round(min(p), 6) AS lo, round(max(p), 6) AS hi, round(avg(CASE WHEN p > 0.1 THEN 1.0 ELSE 0.0 END), 6) AS share_1, count(*) AS n,
 CASE WHEN quantile_cont(p, 0.5) > 0.1 THEN 'GO' ELSE 'CONSIDER' END AS verdict FROM v""")
def a35(spark, d):
    p = V.patches(spark, d).select(F.col("vec_id").alias("raster_id"), F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.slice(F.col("value"), r * 8 + 1, F.lit(8)))).alias("row", "profile"))
    return rounded(W.profile_visibility(p, 2, (0.1,)))

