"""Cases of the third review: explosive steps, sums, merged lines, map round trips."""
import math


from pyspark.sql import functions as F

from bermline.operators import cells as C
from bermline.operators import rasters as R


def lines(spark, rows):
    return spark.createDataFrame([(i, [(float(x), float(y)) for x, y in p]) for i, p in rows], "line_id long, pts array<struct<x double, y double>>")


def test_box_edge_near_as_the_distance(spark):
    d = spark.range(20_000).selectExpr(*[f"CAST(floor(rand({k}) * 30) AS DOUBLE) AS {c}" for k, c in enumerate(("x0", "y0", "x1", "y1", "xmin", "ymin"))])
    d = d.withColumn("xmax", F.col("xmin") + 1 + F.rand(7) * 9).withColumn("ymax", F.col("ymin") + 1 + F.rand(8) * 9).cache()
    for buffer in (0.0, 0.7, 3.1):
        both = d.select((C.box_edge_distance() <= buffer).alias("a"), C.box_edge_near(buffer).alias("b"))
        assert both.filter("a").count() > 1000 and both.filter("NOT (a <=> b)").isEmpty()


def test_rasterize_spreads_a_small_file(spark):
    """One partition of lines is dealt out before its cells are made, and a grid's limits hold for the cells made."""
    ln = lines(spark, [(k, [(7 * k, 3), (7 * k + 40, 23 + k), (7 * k + 55, 23 + k)]) for k in range(12)]).coalesce(1)
    assert C.spread(ln).rdd.getNumPartitions() >= int(spark.conf.get("spark.sql.shuffle.partitions"))
    got = {(r["row"], r["col"]) for r in R.rasterize(ln, R.Grid(0.0, 60.0, 5.0, 12, 9), 3.0).collect()}

    def gap(px, py, a, b):
        d = (b[0] - a[0], b[1] - a[1])
        t = max(0.0, min(1.0, ((px - a[0]) * d[0] + (py - a[1]) * d[1]) / (d[0] ** 2 + d[1] ** 2)))
        return math.hypot(px - a[0] - t * d[0], py - a[1] - t * d[1])

    want = set()
    for r in ln.collect():
        for a, b in zip(r["pts"], r["pts"][1:]):
            for row in range(12):
                for col in range(9):  # the nearest of a dense grid of places in the cell
                    if min(gap(5 * col + i / 8, 55 - 5 * row + j / 8, a, b) for i in range(41) for j in range(41)) <= 3.0:
                        want.add((row, col))
    assert want <= got and len(got - want) <= 0.02 * len(want)


def test_sum_that_rounds_to_zero_is_missing(spark):
    d = spark.createDataFrame([(0, 0, 2e-8), (0, 0, -1e-8), (0, 1, 1e-8), (0, 1, 0.25)], "row int, col int, value double")
    got = {r["col"]: r["value"] for r in R.mosaic_sum(d, places=6).collect()}
    assert got == {0: None, 1: 0.25}


def test_parts_of_a_line_merge_only_with_each_other(spark):
    """The second line starts where the first one ends."""
    from bermline.operators.morphology import merge_pseudonodes

    rows = [(0, 0, [(0, 0), (1, 1)]), (1, 0, [(1, 1), (2, 0)]), (2, 1, [(2, 0), (3, 1)]), (3, 1, [(3, 1), (4, 0)])]
    d = spark.createDataFrame([(i, k, [(float(x), float(y)) for x, y in p]) for i, k, p in rows], "line_id long, line long, pts array<struct<x double, y double>>")
    assert {(r["line_id"], r["n_lines"], len(r["pts"])) for r in merge_pseudonodes(d, within=["line"]).collect()} == {(0, 2, 3), (2, 2, 3)}
    assert [(r["n_lines"], len(r["pts"])) for r in merge_pseudonodes(d).collect()] == [(4, 5)]


def test_reach_positions_stay_on_the_map(spark, tmp_path):
    from bermline.plans.registry import all_queries

    keys = [0, 1, 149_999, 3_599_999, 8_999_999, 35_999_999, 359_999_999]
    spark.createDataFrame([(k, 1.0) for k in keys], "o_orderkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r["comid"]: r["err_mm"] for r in all_queries()["p33_reproject"](spark, str(tmp_path)).collect()}
    assert got == {k: 0 for k in keys}


def test_glcm_of_many_rasters_in_whole_batches(spark):
    """Rasters of equal and unequal tiles against the texture of each mirrored raster as a whole."""
    import numpy as np

    rng = np.random.default_rng(5)
    q = rng.integers(0, 6, (7, 9, 11))
    d = spark.createDataFrame([(k, r, c, int(q[k, r, c])) for k in range(7) for r in range(9) for c in range(11)], "raster_id long, row long, col long, level int")
    got = {(r["raster_id"], r["row"], r["col"]): r for r in R.glcm(d, 9, 11, window=5, levels=6, tile=4, keys=["raster_id"]).collect()}
    assert len(got) == q.size and "MapInArrow" in R.glcm(d, 9, 11, window=5, levels=6, tile=4, keys=["raster_id"])._jdf.queryExecution().toString()
    for k in range(7):
        for band, want in R.window_glcm(np.pad(q[k], 2, mode="reflect"), 5, 6).items():
            assert all(abs(got[k, r, c][band] - want[r, c]) < 1e-12 for r in range(9) for c in range(11)), (k, band)


def test_level_drift_does_not_shuffle_by_run(spark):
    from bermline.operators.windows import level_drift

    d = spark.range(4000).selectExpr("concat('run', id % 2) AS run", "id div 40 AS row", "id div 4 % 10 AS col", "CAST(id div 2 % 2 * 4 AS BIGINT) AS hour", "id * 1.0D AS zs")
    seen = []
    real = type(d).checkpoint
    type(d).checkpoint = lambda self, *a, **k: (seen.append(self._jdf.queryExecution().executedPlan().toString()), real(self, *a, **k))[1]
    try:
        level_drift(d).collect()
    finally:
        type(d).checkpoint = real
    assert seen and "BroadcastHashJoin" in seen[0] and "hashpartitioning(run#" not in seen[0].split("BroadcastHashJoin")[1]


def test_orthometric_takes_each_point_once(spark):
    """Two points of one id keep their own heights: no grouping by id."""
    from bermline.functions import crs

    g = spark.createDataFrame([(r, c, 10.0 * r + c) for r in range(3) for c in range(3) if (r, c) != (2, 2)], "row long, col long, n_value double")
    p = spark.createDataFrame([(1, 0.5, 0.5, 100.0), (1, 0.25, 1.5, 50.0), (2, 1.5, 1.5, 9.0), (3, None, 1.0, 9.0)], "id long, lon double, lat double, h_te_ellipsoid double")
    got = sorted((r["id"], r["lon"] or -1.0, r["geoid_N"], r["h_te_ortho"]) for r in crs.orthometric(p, g, 0.0, 0.0, 1.0).collect())
    assert got == [(1, 0.25, 15.25, 34.75), (1, 0.5, 5.5, 94.5), (2, 1.5, None, None), (3, -1.0, None, None)]
