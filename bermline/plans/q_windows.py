"""Queries for windows and flood runs."""
from pyspark.sql import functions as F

from bermline.operators import flood as FL
from bermline.operators import windows as W
from bermline.operators.cells import ring_join
from bermline.plans import views as V
from bermline.plans.registry import query, rounded

N = lambda: F.count(F.lit(1)).alias("n")


@query("w1_along_track_distance", """SELECT event_id, track, round(sum(s) OVER (PARTITION BY track ORDER BY t, event_id), 4) AS d FROM
 (SELECT *, coalesce(sqrt((x - lag(x) OVER w)^2 + (y - lag(y) OVER w)^2), 0) AS s FROM tracks WINDOW w AS (PARTITION BY track ORDER BY t, event_id))""")
def w1(spark, d):
    return rounded(W.along_track_distance(V.tracks(spark, d), ["track"], ["t", "event_id"]).select("event_id", "track", "d"), places=4)


@query("w2_along_track_prominence", """SELECT a.event_id, count(b.h) AS n_neighbours, CASE WHEN count(b.h) >= 4 THEN round(any_value(a.h) - quantile_cont(b.h, 0.5), 6) END AS prominence
 FROM tracks a LEFT JOIN tracks b ON a.track = b.track AND abs(b.x - a.x) >= 40 AND abs(b.x - a.x) <= 300 GROUP BY 1""")
def w2(spark, d):
    t = V.tracks(spark, d).withColumn("d", F.col("x"))
    p = W.along_track_prominence(t)
    return rounded(p.select("event_id", "n_neighbours", "prominence"))


@query("w3_planar_prominence", """WITH c AS (SELECT DISTINCT x, y, h FROM points WHERE flag = 'R'), r AS (SELECT x AS rx, y AS ry, h AS rh FROM points WHERE flag <> 'R'),
 m AS (SELECT x, y, h, quantile_cont(rh, 0.5) AS med, count(*) AS n FROM c JOIN r ON rx BETWEEN x - 30 AND x + 30 AND ry BETWEEN y - 30 AND y + 30
  AND sqrt((x-rx)^2+(y-ry)^2) BETWEEN 10 AND 30 GROUP BY 1, 2, 3)
 SELECT c.x, c.y, c.h, coalesce(n, 0) AS n_ref, CASE WHEN n >= 10 AND c.h - med <= 8 THEN c.h - med END AS prominence FROM c LEFT JOIN m USING (x, y, h)""")
def w3(spark, d):
    p = V.points(spark, d)
    c = p.filter("flag = 'R'").select("x", "y", "h").distinct()
    return W.planar_prominence(c, p.filter("flag <> 'R'").select("x", "y", "h"), r_in=10.0, r_out=30.0)


@query("w4_best_row", "SELECT comid, id, h, price FROM (SELECT *, row_number() OVER (PARTITION BY comid ORDER BY h DESC, price DESC, id DESC) AS rn FROM points) WHERE rn = 1")
def w4(spark, d):
    return W.best_row(V.points(spark, d).select("comid", "id", "h", "price"), ["comid"], ["h", "price", "id"])


_W5 = """(SELECT *, (volume_mil_m3 - lag(volume_mil_m3) OVER (PARTITION BY run ORDER BY hour)) * 1e6 / 3600.0 AS dv FROM hourly)"""


def inflow(spark, d):
    return V.table(spark, d, "events").groupBy(F.col("event_type").alias("run")).agg((F.max("value") * 100).alias("q_in"))


_Q = "(SELECT event_type AS run, max(value) * 100 AS q_in FROM events GROUP BY 1)"


@query("w5_hourly_volume_change", f"SELECT run, hour, round(dv, 4) AS dv_dt_m3s, round(dv / q_in * 100, 4) AS dv_dt_pct FROM {_W5} JOIN {_Q} USING (run)")
def w5(spark, d):
    s = W.hourly_volume_change(V.hourly(spark, d), inflow(spark, d))
    return rounded(s.select("run", "hour", F.col("dV_dt_m3s").alias("dv_dt_m3s"), F.col("dV_dt_pct_inflow").alias("dv_dt_pct")), places=4)


@query("w6_hourly_level_change", """SELECT run, hour, count(*) AS n_cells, round(quantile_cont(abs(zs - p), 0.5), 6) AS dz_median_m, round(max(abs(zs - p)), 6) AS dz_max_m FROM
 (SELECT *, lag(zs) OVER (PARTITION BY run, row, col ORDER BY hour) AS p FROM cells_hourly) WHERE p IS NOT NULL AND (zs - zb > 0.05 OR p - zb > 0.05) GROUP BY 1, 2""")
def w6(spark, d):
    return rounded(W.hourly_level_change(V.cells_hourly(spark, d)))


@query("w7_steady_state", f"""SELECT run, hour, dz_max_m, round(dv, 4) AS dv, coalesce(abs(dv / q_in * 100) < 25.0, dz_max_m < 0.05) AS steady, dz_max_m < 0.05 AS steady_cellmax
 FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY hour DESC) AS rn FROM {_W5}) JOIN {_Q} USING (run) WHERE rn = 1""")
def w7(spark, d):
    s = W.steady_state(W.hourly_volume_change(V.hourly(spark, d), inflow(spark, d)), pct=25.0)
    return rounded(s.select("run", "hour", "dz_max_m", F.round("dV_dt_m3s", 4).alias("dv"), "steady", "steady_cellmax"))


@query("w7_level_drift", """WITH e AS (SELECT run, row, col, abs(max(zs) FILTER (hour = 9) - max(zs) FILTER (hour = 7)) AS d FROM cells_hourly GROUP BY 1, 2, 3)
 SELECT run, count(d) AS n_cells, round(quantile_cont(d, 0.5), 6) AS drift_median, round(max(d), 6) AS drift_max, max(d) < 0.05 AS steady FROM e GROUP BY 1""")
def w7d(spark, d):
    return rounded(W.level_drift(V.cells_hourly(spark, d)))


@query("w8_suffix_sum", "SELECT flag, h, CAST(sum(n) OVER (PARTITION BY flag ORDER BY h DESC) AS BIGINT) AS above FROM (SELECT flag, h, count(*) AS n FROM points GROUP BY 1, 2)")
def w8(spark, d):
    t = V.points(spark, d).groupBy("flag", "h").agg(N())
    return W.suffix_sum(t, ["h"], {"above": "n"}, ["flag"]).select("flag", "h", "above")


@query("w9_running_id", "SELECT comid, printf('pos_%07d', row_number() OVER (ORDER BY comid) - 1) AS patch_id FROM reaches")
def w9(spark, d):
    return W.running_id(V.reaches(spark, d).select("comid"), "pos_", ["comid"])


@query("w10_chainage", """SELECT levee_id, comid, round(c1 - uparea, 2) AS chain0, round(c1, 2) AS chain1 FROM (SELECT comid % 7 AS levee_id, comid, uparea,
 sum(uparea) OVER (PARTITION BY comid % 7 ORDER BY comid) AS c1 FROM reaches)""")
def w10(spark, d):
    s = V.reaches(spark, d).selectExpr("comid % 7 AS levee_id", "comid", "uparea AS length_m")
    return rounded(W.chainage(s, order=["comid"]).select("levee_id", "comid", "chain0", "chain1"), places=2)


@query("j10_ring_join", """SELECT count(*) AS n, round(sum(d), 2) AS d FROM (SELECT sqrt((p.x-r.x)^2+(p.y-r.y)^2) AS d FROM points p JOIN reaches r
 ON r.x BETWEEN p.x - 40 AND p.x + 40 AND r.y BETWEEN p.y - 40 AND p.y + 40) WHERE d BETWEEN 10 AND 40""")
def j10(spark, d):
    r = ring_join(V.points(spark, d).select("id", "x", "y"), V.reaches(spark, d).select(F.col("comid").alias("rid"), "x", "y"), 10.0, 40.0)
    return r.agg(N(), F.round(F.sum("d"), 2).alias("d"))


# ---- flood ---------------------------------------------------------------------------------

def final_cells(spark, d):
    return V.mosaic(spark, d).selectExpr("concat('run', row div 8 % 2) AS run", "row", "col", "value AS zsmax", "0.0D AS zb")


@query("a28_depth_stats", """SELECT run, round(count(h) * 100.0 / 1e6, 6)::DOUBLE AS wet_area_km2, round(max(h), 6) AS max_depth_m, round(avg(h), 6) AS mean_depth_m,
 round(sum(h) * 100.0 / 1e6, 6)::DOUBLE AS volume_mil_m3 FROM (SELECT 'run' || (row // 8 % 2) AS run, CASE WHEN value >= 0.05 THEN value END AS h FROM mosaic) GROUP BY 1""")
def a28(spark, d):
    return rounded(FL.depth_stats(final_cells(spark, d), 100.0))


@query("a28_hourly_series", """SELECT run, hour, round(count(*) FILTER (zs - zb > 0.05) * 100.0 / 1e6, 6)::DOUBLE AS wet_area_km2,
 round(sum(CASE WHEN zs - zb > 0.05 THEN zs - zb ELSE 0.0 END) * 100.0 / 1e6, 6)::DOUBLE AS volume_mil_m3 FROM cells_hourly GROUP BY 1, 2""")
def a28h(spark, d):
    return rounded(FL.hourly_series(V.cells_hourly(spark, d), 100.0))


@query("r27_depth_grid", "SELECT row, col, round(CASE WHEN value >= 0.05 THEN value END, 6) AS h FROM mosaic")
def r27(spark, d):
    return rounded(FL.depth_grid(final_cells(spark, d)).select("row", "col", "h"))


@query("r27_orient", """SELECT raster_id, 7 - col AS row, 7 - row AS col, round(value, 6) AS v FROM pixels""")
def r27o(spark, d):
    """Transposed grids with both axes reversed come back in map order."""
    c = V.pixels(spark, d).selectExpr("raster_id AS run", "row", "col", "value", "CAST(100 - row AS DOUBLE) AS x", "CAST(50 + col AS DOUBLE) AS y")
    return rounded(FL.orient(c).select(F.col("run").alias("raster_id"), "row", "col", F.col("value").alias("v")))


def two_runs(spark, d):
    m = V.mosaic(spark, d)
    base = m.selectExpr("row", "col", "value AS zs").withColumn("h", F.when(F.col("zs") >= 0.05, F.col("zs")))
    dyke = m.selectExpr("row", "col", "CASE WHEN row % 5 = 0 THEN value * 1.2D + 0.04D ELSE value * 0.9D - 0.01D END AS zs").withColumn("h", F.when(F.col("zs") >= 0.05, F.col("zs")))
    return base, dyke.filter("(row + col) % 11 <> 0")


_TWO = """(SELECT row, col, value AS zb, CASE WHEN value >= 0.05 THEN value END AS hb, CASE WHEN (row + col) % 11 <> 0 THEN zl END AS zl,
 CASE WHEN (row + col) % 11 <> 0 AND zl >= 0.05 THEN zl END AS hl FROM (SELECT *, CASE WHEN row % 5 = 0 THEN value * 1.2 + 0.04 ELSE value * 0.9 - 0.01 END AS zl FROM mosaic))"""


@query("a33_compare_runs", f"""WITH c AS (SELECT *, CASE WHEN hb IS NOT NULL AND hl IS NOT NULL THEN zl - zb END AS dz FROM {_TWO})
 SELECT round(count(*) FILTER (hb IS NOT NULL AND hl IS NULL) * 100.0 / 1e6, 6)::DOUBLE AS protected_area_km2,
 round(count(*) FILTER (hl IS NOT NULL AND hb IS NULL) * 100.0 / 1e6, 6)::DOUBLE AS newly_wet_area_km2,
 round((count(hl) - count(hb)) * 100.0 / 1e6, 6)::DOUBLE AS wet_area_diff_km2, round(count(*) FILTER (abs(dz) > 0.05) * 100.0 / 1e6, 6)::DOUBLE AS changed_area_km2,
 round(quantile_cont(dz, 0.5) FILTER (abs(dz) > 0.05), 6) AS dz_median_changed_m, round(min(dz), 6) AS dz_min_m, round(max(dz), 6) AS dz_max_m FROM c""")
def a33(spark, d):
    return rounded(FL.compare_runs(FL.align_runs(*two_runs(spark, d)), 100.0))


@query("j21_align_runs", f"SELECT row, col, round(hb, 6) AS h_b, round(zb, 6) AS zs_b, round(hl, 6) AS h_l, round(zl, 6) AS zs_l FROM {_TWO}")
def j21(spark, d):
    c = V.table(spark, d, "region").selectExpr("0.0D AS x0", "0.0D AS y0", "10.0D AS dx", "10.0D AS dy", "128 AS mmax", "r_regionkey * 0 + 1000 AS nmax")
    return rounded(FL.align_runs(*two_runs(spark, d), config=c))


@query("s12_parse_run_config", """SELECT c_custkey AS run, round(c_acctbal, 2) AS x0, CAST(c_custkey AS DOUBLE) AS y0, 10.0::DOUBLE AS dx, CASE WHEN c_custkey % 4 <> 0 THEN 20.0::DOUBLE END AS dy,
 c_nationkey AS mmax, 77 AS nmax, CASE WHEN c_custkey % 2 = 0 THEN 32633 ELSE 2180 END AS epsg, CASE WHEN c_custkey % 4 = 0 THEN 'dy' ELSE '' END AS missing FROM customer""")
def s12(spark, d):
    t = V.table(spark, d, "customer").selectExpr(
        "c_custkey AS run", "concat('mmax = ', c_nationkey, '\n', 'nmax=77\n  x0 = ', CAST(c_acctbal AS STRING), '\ny0 = ', c_custkey, '\ndx   = 10.0\n', "
        "CASE WHEN c_custkey % 4 <> 0 THEN 'dy = 20\n' ELSE 'dyy = 3\n' END, CASE WHEN c_custkey % 2 = 0 THEN 'epsg = 32633\n' ELSE '' END) AS text")
    return rounded(FL.parse_run_config(t), "x0", places=2)


@query("s13_total_inflow", """SELECT o_custkey AS run, round(q, 2) AS q_in FROM (SELECT o_custkey, o_totalprice + 5.5 AS q,
 row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders WHERE o_orderkey % 3 <> 0) WHERE rn = 1""")
def s13(spark, d):
    lines = V.table(spark, d, "orders").selectExpr(
        "o_custkey AS run", "o_orderkey AS line_no",
        "CASE o_orderkey % 6 WHEN 0 THEN 'time q1 q2' WHEN 3 THEN '42' ELSE concat('  ', o_orderkey, '   ', CAST(o_totalprice AS STRING), '  5.5 ') END AS line")
    return rounded(FL.total_inflow(lines), places=2)


@query("s14_check_weirs", """SELECT l_suppkey AS file, count(*) FILTER (l_linenumber = 7) AS n_blocks, count(*) FILTER (l_linenumber < 6) AS n_vertices, count(*) FILTER (l_linenumber = 6) AS n_bad,
 CAST(min(l_partkey) FILTER (l_linenumber < 6) AS DOUBLE) AS x_min, CAST(max(l_partkey) FILTER (l_linenumber < 6) AS DOUBLE) AS x_max,
 CAST(min(l_quantity) FILTER (l_linenumber < 6) AS DOUBLE) AS y_min, CAST(max(l_quantity) FILTER (l_linenumber < 6) AS DOUBLE) AS y_max,
 min(l_tax) FILTER (l_linenumber < 6) AS z_min, max(l_tax) FILTER (l_linenumber < 6) AS z_max,
 count(*) FILTER (l_linenumber < 6 AND l_partkey BETWEEN 10 AND 1000 AND l_quantity BETWEEN 5 AND 40) AS n_inside,
 count(*) FILTER (l_linenumber < 6 AND l_quantity BETWEEN 10 AND 1000 AND l_partkey BETWEEN 5 AND 40) AS n_inside_swapped FROM lineitem GROUP BY 1""")
def s14(spark, d):
    t = V.table(spark, d, "lineitem").selectExpr(
        "l_suppkey AS file", "CASE WHEN l_linenumber = 7 THEN concat('weir', l_orderkey) WHEN l_linenumber = 6 THEN concat(l_partkey, ' x ', CAST(l_tax AS STRING), ' 0.6') "
        "ELSE concat(l_partkey, ' ', CAST(l_quantity AS STRING), '  ', CAST(l_tax AS STRING), ' 0.60') END AS line")
    return FL.check_weirs(t, (10.0, 5.0, 1000.0, 40.0))


@query("u3_assert_unique", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def u3(spark, d):
    return FL.assert_unique(V.table(spark, d, "orders"), ["o_custkey"])
