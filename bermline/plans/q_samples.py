"""Queries for splits and samples; the twins draw with the multiplicative hash."""
from pyspark.sql import functions as F

from bermline.operators import rasters as RA
from bermline.operators import samples as S
from bermline.operators.coverage import run_cells
from bermline.plans import views as V
from bermline.plans.q_joins import dist
from bermline.plans.registry import MIX, mix, query

N = lambda: F.count(F.lit(1)).alias("n")


def grouped(spark, d):
    o = V.table(spark, d, "orders")
    return o.selectExpr("o_orderstatus AS region", "o_custkey div 3 AS comid", "o_orderkey AS k", "o_totalprice AS uparea")


_G = "(SELECT o_orderstatus AS region, o_custkey // 3 AS comid, o_orderkey AS k FROM orders)"
_GK = "comid * 3 + CASE region WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END"
_RANK = f"(SELECT region, comid, row_number() OVER (ORDER BY {MIX.format(k=_GK)}, region, comid) AS rk, count(*) OVER () AS n FROM (SELECT DISTINCT region, comid FROM {_G}))"


def gmix():
    return mix(F.expr("comid * 3 + CASE region WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END"))


@query("g1_group_split", f"SELECT split, region, count(*) AS n, count(DISTINCT comid) AS n_groups FROM (SELECT g.*, CASE WHEN rk <= floor(n * 0.75::DOUBLE) THEN 'train' ELSE 'val' END AS split FROM {_G} g JOIN {_RANK} r USING (region, comid)) GROUP BY 1, 2")
def g1(spark, d):
    s = S.group_split(grouped(spark, d), ["region", "comid"], u=gmix())
    return s.groupBy("split", "region").agg(N(), F.count_distinct("comid").alias("n_groups"))


@query("g2_three_way_split", f"""SELECT region, comid, k, CASE WHEN rk <= floor(n * 0.7::DOUBLE) THEN 'train' WHEN rk <= floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'val' ELSE 'test' END AS split
 FROM {_G} g JOIN {_RANK} r USING (region, comid)""")
def g2(spark, d):
    f = (("train", 0.70), ("val", 0.15), ("test", 0.15))
    return S.group_split(grouped(spark, d), ["region", "comid"], f, u=gmix()).select("region", "comid", "k", "split")


@query("g3_calibration_split", f"SELECT region, comid, k, CASE WHEN rk <= greatest(1, floor(n * 0.3::DOUBLE)) THEN 'calib' ELSE 'report' END AS split FROM {_G} g JOIN {_RANK} r USING (region, comid)")
def g3(spark, d):
    return S.calibration_split(grouped(spark, d), ["region", "comid"], u=gmix()).select("region", "comid", "k", "split")


_BL = f"""(SELECT *, row // 16 AS block_r, col // 16 AS block_c FROM mosaic)"""
_BR = f"(SELECT block_r, block_c, row_number() OVER (ORDER BY {MIX.format(k='(block_r * 8 + block_c)')}, block_r, block_c) AS rk, count(*) OVER () AS n FROM (SELECT DISTINCT block_r, block_c FROM {_BL}))"
_SPLIT = f"(SELECT b.*, CASE WHEN rk <= greatest(1, round_even(n * 0.3::DOUBLE, 0)) THEN 'test' ELSE 'train' END AS split FROM {_BL} b JOIN {_BR} r USING (block_r, block_c))"


def split_pixels(spark, d):
    return S.block_split(V.mosaic(spark, d).withColumnRenamed("truth", "label"), 16, u=mix(F.expr("block_r * 8 + block_c")))


@query("g4_block_split", f"SELECT row, col, split FROM {_SPLIT}")
def g4(spark, d):
    return split_pixels(spark, d).select("row", "col", "split")


_PU = MIX.format(k="(row * 128 + col)")


@query("g5_balanced_sample", f"""SELECT row, col, split, label FROM (SELECT *, row_number() OVER (PARTITION BY split, label ORDER BY {_PU}, row, col) AS rk FROM
 (SELECT row, col, split, truth AS label FROM {_SPLIT})) WHERE rk <= CASE split WHEN 'train' THEN 700 ELSE 300 END""")
def g5(spark, d):
    s = S.balanced_sample(split_pixels(spark, d), {"train": 700, "test": 300}, ["row", "col"], u=mix(F.expr("row * 128 + col")))
    return s.select("row", "col", "split", "label")


@query("g6_prevalence_sample", f"""WITH s AS (SELECT row, col, split, truth AS label FROM {_SPLIT}), p AS (SELECT split, least(CASE split WHEN 'train' THEN 140 ELSE 60 END, count(*) FILTER (label = 1)) AS np FROM s GROUP BY 1),
 r AS (SELECT *, row_number() OVER (PARTITION BY split, label ORDER BY {_PU}, row, col) AS rk FROM s)
 SELECT row, col, split, label FROM r JOIN p USING (split) WHERE rk <= CASE label WHEN 1 THEN np ELSE np * 5 END""")
def g6(spark, d):
    s = S.prevalence_sample(split_pixels(spark, d), {"train": 140, "test": 60}, ["row", "col"], 5, u=mix(F.expr("row * 128 + col")))
    return s.select("row", "col", "split", "label")


@query("g7_stratified_group_kfold", f"""WITH g AS (SELECT block_r, block_c, count(*) FILTER (truth = 1) AS p, count(*) AS n FROM {_BL} GROUP BY 1, 2),
 r AS (SELECT *, (row_number() OVER (ORDER BY p DESC, n DESC, block_r, block_c) - 1) % 10 AS k FROM g)
 SELECT CASE WHEN k < 5 THEN k ELSE 9 - k END AS fold, count(*) AS n_groups, CAST(sum(p) AS BIGINT) AS n_pos FROM r GROUP BY 1""")
def g7(spark, d):
    f = S.stratified_group_kfold(S.with_block(V.mosaic(spark, d), 16), ["block_r", "block_c"], "truth")
    return f.groupBy("fold").agg(F.count_distinct("block_r", "block_c").alias("n_groups"), F.sum("truth").alias("n_pos"))


@query("g8_label_weights", """WITH m AS (SELECT row, col, min(d) AS d FROM (SELECT CAST(r AS BIGINT) AS row, CAST(c AS BIGINT) AS col, sqrt((px-(x0+t*(x1-x0)))^2+(py-(y0+t*(y1-y0)))^2) AS d FROM
  (SELECT *, greatest(0.0, least(1.0, ((px-x0)*(x1-x0)+(py-y0)*(y1-y0))/((x1-x0)^2+(y1-y0)^2))) AS t FROM (SELECT *, (c + 0.5) * 10.0::DOUBLE AS px, 2200 - (r + 0.5) * 10.0::DOUBLE AS py FROM
   (SELECT *, unnest(range(CAST(floor((2200 - y1 - 30) / 10) AS BIGINT), CAST(floor((2200 - y0 + 30) / 10) AS BIGINT) + 1)) AS r FROM
    (SELECT *, unnest(range(CAST(floor((x0 - 30) / 10) AS BIGINT), CAST(floor((x1 + 30) / 10) AS BIGINT) + 1)) AS c FROM line_edges))))) GROUP BY 1, 2)
 SELECT row, col, CASE WHEN d <= 25 THEN 1 ELSE 0 END AS label, CASE WHEN d <= 7.5 THEN 1.0 WHEN d <= 25 THEN 0.3 ELSE 1.0 END::DOUBLE AS weight
 FROM (SELECT DISTINCT CAST(floor((2200 - y) / 10) AS BIGINT) AS row, CAST(floor(x / 10) AS BIGINT) AS col FROM points) LEFT JOIN m USING (row, col)""")
def g8(spark, d):
    px = V.points(spark, d).select(F.floor((2200 - F.col("y")) / 10).alias("row"), F.floor(F.col("x") / 10).alias("col")).distinct()
    grid = RA.Grid(0.0, 2200.0, 10.0)
    ln = V.lines(spark, d)
    return S.label_weights(px, RA.rasterize(ln, grid, 25.0, all_touched=False), RA.rasterize(ln, grid, 7.5, all_touched=False))


@query("g9_corridor_negatives")
def g9(spark, d):
    from bermline.plans.q_joins import reach_lines
    return S.corridor_negatives(reach_lines(spark, d), V.lines(spark, d), V.table(spark, d, "supplier").count(), 30.0, 8.0, 10)


@query("g10_paired_negatives")
def g10(spark, d):
    pos = V.reaches(spark, d).selectExpr("CAST(comid AS STRING) AS patch_id", "CASE WHEN uparea >= 200000 THEN 'L' ELSE 'M' END AS category", "comid", "uparea", "x", "y")
    ln = V.lines(spark, d).selectExpr("CASE WHEN size >= 25 THEN 'L' ELSE 'M' END AS category", "pts")
    return S.paired_negatives(pos, ln, 10.0, 200.0, 5)


@query("g11_sample_pixels", f"""SELECT count(*) AS n, count(DISTINCT vec_id) AS n_patches, CAST(sum(vec_id) AS BIGINT) AS s FROM (SELECT vec_id FROM (SELECT vec_id, row_number() OVER (ORDER BY {MIX.format(k='vec_id')}, vec_id) AS rk FROM patch_meta) WHERE rk <= 300), range(16)""")
def g11(spark, d):
    s = S.sample_pixels(V.patches(spark, d), 300, 16, "vec_id", u=mix(F.col("vec_id")))
    return s.agg(N(), F.count_distinct("vec_id").alias("n_patches"), F.sum("vec_id").alias("s"))


@query("g12_patch_centres")
def g12(spark, d):
    m = V.mosaic(spark, d).withColumnRenamed("truth", "label")
    n = V.table(spark, d, "embeddings").count()
    return S.patch_centres(m, (n + 15) // 16 * 8, 128, 8, n)


@query("g13_keep_basins", "SELECT comid, uparea FROM (SELECT comid, uparea, comid % 50 AS b FROM reaches) WHERE uparea >= 100000 AND b IN (3, 7, 20)")
def g13(spark, d):
    return S.keep_basins(V.reaches(spark, d).withColumn("basin_id", F.col("comid") % 50), [3, 7, 20], 100000.0).select("comid", "uparea")


@query("l3_first_n_matching", f"SELECT vec_id FROM (SELECT vec_id, row_number() OVER (ORDER BY {MIX.format(k='vec_id')}, vec_id) AS rk FROM patch_meta WHERE patch_type = 'positive') WHERE rk <= 20")
def l3(spark, d):
    return S.first_n_matching(V.patches(spark, d), F.col("patch_type") == "positive", 20, ["vec_id"], u=mix(F.col("vec_id"))).select("vec_id")


@query("u4_remaining_groups", f"SELECT comid FROM (SELECT DISTINCT comid FROM {_G}) WHERE comid NOT IN (SELECT comid FROM {_G} WHERE region = 'F') AND comid NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def u4(spark, d):
    g = grouped(spark, d)
    other = V.table(spark, d, "customer").filter("c_acctbal > 5000").selectExpr("c_custkey AS comid")
    return S.remaining_groups(g, g.filter("region = 'F'"), other, keys=["comid"])


@query("a39_corridor", "SELECT comid FROM reaches WHERE uparea >= 150000 AND comid % 50 IN (1, 2, 3)")
def a39(spark, d):
    return S.corridor(V.reaches(spark, d).withColumn("basin_id", F.col("comid") % 50), 150000.0, [1, 2, 3]).select("comid")




_BUFFERED = f"""(SELECT DISTINCT r AS row, c AS col FROM (SELECT *, unnest(range(CAST(floor((x0 - 7) / 5) AS BIGINT), CAST(floor((x1 + 7) / 5) AS BIGINT) + 1)) AS c FROM
 (SELECT *, unnest(range(CAST(floor((y0 - 7) / 5) AS BIGINT), CAST(floor((y1 + 7) / 5) AS BIGINT) + 1)) AS r FROM (SELECT e.* FROM line_edges e JOIN lines USING (line_id) WHERE size >= 30))) e
 WHERE {dist("(c + 0.5) * 5", "(r + 0.5) * 5")} <= 7)"""


def large_lines(spark, d):
    return V.lines(spark, d).filter("size >= 30")


@query("a39_corridor_rows", f"SELECT row, count(*) AS n_cells, CAST(sum(opens) AS BIGINT) AS n_runs, CAST(min(col) AS BIGINT) AS c0, CAST(max(col) AS BIGINT) AS c1 FROM (SELECT *, CASE WHEN col = lag(col) OVER (PARTITION BY row ORDER BY col) + 1 AND col % 4096 <> 0 THEN 0 ELSE 1 END AS opens FROM {_BUFFERED}) GROUP BY 1")
def a39_rows(spark, d):
    """Cells and runs of the buffered lines by row."""
    r = S.corridor_runs(large_lines(spark, d), 7.0, 5.0)
    return r.groupBy("row").agg(F.sum(run_cells(r)).alias("n_cells"), F.count(F.lit(1)).alias("n_runs"), F.min("c0").alias("c0"), F.max("c1").alias("c1"))


@query("a39_corridor_pieces", f"""WITH RECURSIVE cell AS MATERIALIZED {_BUFFERED}, run AS MATERIALIZED (SELECT row, g, min(col) AS c0, max(col) AS c1 FROM (SELECT row, col, col - row_number() OVER (PARTITION BY row ORDER BY col) AS g FROM cell) GROUP BY 1, 2),
 id AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY row, c0) AS id FROM run),
 link AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM id a JOIN id b ON abs(a.row - b.row) = 1 AND a.c0 <= b.c1 AND b.c0 <= a.c1),
 reach AS (SELECT id, id AS other FROM id UNION SELECT reach.id, link.b FROM reach JOIN link ON link.a = reach.other WHERE link.b < reach.id OR true),
 piece AS (SELECT id, min(other) AS piece FROM reach GROUP BY 1)
 SELECT min(row) AS row0, max(row) AS row1, min(c0) AS c0, max(c1) AS c1, CAST(sum(c1 - c0 + 1) AS BIGINT) AS n_cells, 25.0 * sum(c1 - c0 + 1)::DOUBLE AS area FROM id JOIN piece USING (id) GROUP BY piece""")
def a39_pieces(spark, d):
    """Connected pieces of the corridor of the largest lines."""
    return S.corridor_pieces(large_lines(spark, d), 7.0, 5.0).drop("piece")
