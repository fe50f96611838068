"""Hand cases and properties for metrics, statistics, samples, hydrology and streams."""
import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from bermline.operators import flood as FL
from bermline.operators import metrics as M
from bermline.operators import robust as RB
from bermline.operators import samples as S
from bermline.operators import windows as W
from bermline.operators.ml import class_weights
from bermline.operators.rasters import score_batches
from bermline.operators.rows import resolve_column


def test_metrics_by_hand(spark):
    d = spark.createDataFrame([(2, 1, 1)], "tp long, fp long, fn long")
    r = M.count_metrics(d).first()
    assert all(abs(r[k] - 2 / 3) < 1e-5 for k in ("precision", "recall", "f1", "dice")) and abs(r["iou"] - 0.5) < 1e-5
    z = M.count_metrics(spark.createDataFrame([(0, 0, 0)], "tp long, fp long, fn long"), null_on_empty=True).first()
    assert all(z[k] is None for k in M.METRICS)


def test_threshold_tie(spark):
    """A score equal to the threshold counts as above in the sweep, not in the per-patch counts."""
    s = M.threshold_sweep(spark.createDataFrame([(0.5, 1)], "score double, truth int"), (0.5,)).first()
    assert (s["tp"], s["fn"]) == (1, 0)
    c = M.confusion_counts(spark.createDataFrame([("a", [0.5], [1])], "patch_id string, prob array<double>, label array<int>")).first()
    assert (c["tp"], c["fn"]) == (0, 1)


def test_rank_metrics_by_hand(spark):
    r = M.rank_metrics(spark.createDataFrame([(0.9, 1), (0.8, 0), (0.7, 1)], "score double, truth int")).first()
    assert abs(r["ap"] - 5 / 6) < 1e-12 and abs(r["roc_auc"] - 0.5) < 1e-12


def test_heights_by_hand(spark):
    seg = spark.createDataFrame([(1, 1, 8.0), (2, 1, 5.0), (3, 2, 4.0)], "segment_id long, levee_id long, dsm_med double")
    pts = spark.createDataFrame([(1, 1, 10.0, 1.0), (1, 1, 11.0, 2.0), (1, 1, 12.0, 3.0)], "segment_id long, levee_id long, h double, dz double")
    r = {x["segment_id"]: x for x in RB.resolve_heights(seg, pts).collect()}
    assert r[1]["method"] == "z_measured" and r[1]["z"] == 11 and abs(r[1]["z_cons"] - 10.4) < 1e-9
    assert r[2]["method"] == "dz_levee" and r[2]["z"] == 7 and r[3]["method"] == "dz_default" and r[3]["z"] == 4.9


def test_datum_offset_needs_points(spark):
    d = spark.createDataFrame([(0.0, 0.0, 1.0)], "x double, y double, v double")
    with pytest.raises(Exception, match="fewer than 200"):
        RB.datum_offset(d, "v", d.select(F.lit(0).cast("long").alias("gx"), F.lit(0).cast("long").alias("gy"))).collect()


def test_kruskal_known_value(spark):
    g = {"a": [1, 3, 5, 7, 9], "b": [2, 4, 6, 8, 10]}
    d = spark.createDataFrame([(k, float(v)) for k, vs in g.items() for v in vs], "g string, v double")
    h, p = RB.kruskal(d, "v", "g")
    assert abs(h - 0.2727272727) < 1e-9 and abs(p - math.erfc(math.sqrt(h / 2))) < 1e-12  # chi-square tail with one degree of freedom


def test_trend_equals_least_squares(spark):
    rng = np.random.default_rng(0)
    rows = [(float(x), float(y), float(v), int(n)) for x, y, v, n in zip(rng.uniform(0, 5e5, 30), rng.uniform(0, 5e5, 30), rng.normal(size=30), rng.integers(100, 900, 30))]
    t = RB.weighted_trend(spark.createDataFrame(rows, "x_m double, y_m double, median double, n long"))
    a = np.array(rows)
    w = np.sqrt(a[:, 3])
    X = np.c_[np.ones(30), a[:, 0] / 1e5, a[:, 1] / 1e5] * w[:, None]
    c, res, *_ = np.linalg.lstsq(X, a[:, 2] * w, rcond=None)
    np.testing.assert_allclose(t["coef"], c, atol=1e-9)
    np.testing.assert_allclose(t["se"], np.sqrt(np.diag(res[0] / 27 * np.linalg.inv(X.T @ X))), rtol=1e-7)


def test_along_track_frame_is_inclusive(spark):
    rows = [("t", 0.0, 100.0)] + [("t", d, float(k)) for k, d in enumerate((40.0, 39.9, 300.0, 300.1, -40.0, -300.0))]
    d = spark.createDataFrame(rows, "track string, d double, h double")
    r = W.along_track_prominence(d).filter("h = 100").first()
    assert r["n_neighbours"] == 4 and r["prominence"] == 100 - 3.0  # neighbours 0, 2, 4, 5


def test_along_track_returns_every_row(spark):
    rows = [("t", 0.0, 100.0), ("t", 0.0, 100.0), ("t", None, 7.0), ("t", None, 8.0), (None, 50.0, 1.0), ("u", 50.0, 2.0), *[("t", 60.0 + k, float(k)) for k in range(4)], ("t", 70.0, None)]
    d = spark.createDataFrame(rows, "track string, d double, h double")
    got = W.along_track_prominence(d).collect()
    assert len(got) == len(rows)
    assert [(r["n_neighbours"], r["prominence"]) for r in got if r["h"] == 100.0] == [(4, 98.5)] * 2  # the copy and the row without a height are none
    assert all(r["n_neighbours"] == 0 and r["prominence"] is None for r in got if r["d"] is None or r["track"] != "t")
    assert W.along_track_prominence(d.limit(0)).count() == 0


def test_steady_by_hand(spark):
    s = spark.createDataFrame([("a", 1, 0.2, 79.0, 1.017), ("b", 1, 0.2, 7.9, 0.154), ("c", 1, 0.01, 1.0, None)],
                              "run string, hour int, dz_max_m double, dV_dt_m3s double, dV_dt_pct_inflow double")
    assert {r["run"]: r["steady"] for r in W.steady_state(s).collect()} == {"a": False, "b": True, "c": True}


def test_splits_are_disjoint_and_whole(spark):
    d = spark.range(5000).selectExpr("id", "id % 211 AS comid", "concat('r', id % 2) AS region")
    s = S.group_split(d, ["region", "comid"], (("train", 0.7), ("val", 0.15), ("test", 0.15)))
    assert s.count() == 5000
    per = s.groupBy("region", "comid").agg(F.count_distinct("split").alias("k"))
    assert per.filter("k > 1").isEmpty()
    n = per.count()
    sizes = {r["split"]: r["g"] for r in s.groupBy("split").agg(F.count_distinct("region", "comid").alias("g")).collect()}
    assert sizes["train"] == int(n * 0.7) and sizes["val"] == int(n * 0.15)
    again = S.group_split(d, ["region", "comid"], (("train", 0.7), ("val", 0.15), ("test", 0.15)))
    assert again.exceptAll(s).isEmpty()


def test_balanced_sample_without_replacement(spark):
    d = spark.range(20000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'test' ELSE 'train' END AS split", "CASE WHEN id % 50 = 0 THEN 1 ELSE 0 END AS label")
    s = S.balanced_sample(d, {"train": 100, "test": 1000}, ["id"])
    got = {(r["split"], r["label"]): r["n"] for r in s.groupBy("split", "label").agg(F.count_distinct("id").alias("n")).collect()}
    assert got == {("train", 0): 100, ("train", 1): 100, ("test", 0): 1000, ("test", 1): 134}


def test_kfold_is_balanced(spark):
    d = spark.range(50000).selectExpr("id", "id % 300 AS g", "CASE WHEN id % 300 < 20 AND id % 7 = 0 THEN 1 ELSE 0 END AS label")
    f = S.stratified_group_kfold(d, ["g"])
    assert f.groupBy("g").agg(F.count_distinct("fold").alias("k")).filter("k <> 1").isEmpty()
    pos = [r["p"] for r in f.groupBy("fold").agg(F.sum("label").alias("p")).collect()]
    assert len(pos) == 5 and max(pos) - min(pos) <= 0.1 * sum(pos)


def test_corridor_negatives_keep_their_distances(spark):
    reaches = spark.createDataFrame([(i, i * 100.0, 50.0) for i in range(20)], "comid long, x double, y double")
    ln = spark.createDataFrame([(1, [{"x": 0.0, "y": 60.0}, {"x": 900.0, "y": 60.0}])], "line_id long, pts array<struct<x: double, y: double>>")
    got = S.corridor_negatives(reaches, ln, 60, 80.0, 30.0, 20).collect()
    assert len(got) == 60 and len({r["patch_id"] for r in got}) == 60
    for r in got:
        d = [(math.hypot(r["x"] - i * 100, r["y"] - 50), i) for i in range(20)]
        assert min(d)[0] <= 80 and r["comid"] == min(d)[1]
        assert not (0 <= r["x"] <= 900 and abs(r["y"] - 60) <= 30)


def test_paired_negatives_respect_category(spark):
    pos = spark.createDataFrame([(f"pos_{i}", "L" if i % 2 else "M", i, 1.0, i * 50.0, 0.0) for i in range(40)], "patch_id string, category string, comid long, uparea double, x double, y double")
    ln = spark.createDataFrame([("L", [{"x": 0.0, "y": 100.0}, {"x": 2000.0, "y": 100.0}])], "category string, pts array<struct<x: double, y: double>>")
    got = S.paired_negatives(pos, ln, 60.0, 300.0, 50).collect()
    assert len(got) == 40
    for r in got:
        px = int(r["source_positive_id"][4:]) * 50.0
        assert 0.3 * 300 - 1e-9 <= math.hypot(r["x"] - px, r["y"]) <= 300 + 1e-9
        assert r["category"] != "L" or not (0 <= r["x"] <= 2000 and abs(r["y"] - 100) <= 60)


def test_patch_centres(spark):
    d = spark.range(64 * 64).selectExpr("id div 64 AS row", "id % 64 AS col", "CASE WHEN id % 64 = 20 THEN 1 ELSE 0 END AS label")
    few = S.patch_centres(d, 64, 64, 16, 200).collect()
    assert len(few) == 200 and sum(r["kind"] == "positive" for r in few) == 100
    assert all(8 <= r["row"] < 55 and 8 <= r["col"] < 55 for r in few) and all(r["col"] == 20 for r in few if r["kind"] == "positive")
    one = S.patch_centres(d, 64, 64, 16, 20).collect()
    assert len({r["row"] for r in one if r["kind"] == "positive"}) == 10


def test_first_n_matching_raises_when_short(spark):
    with pytest.raises(Exception, match="fewer than 11"):
        S.first_n_matching(spark.range(10), F.col("id") >= 0, 11, ["id"]).collect()


def test_grid_check_and_unique(spark):
    c = spark.createDataFrame([(0.0, 0.0, 10.0, 10.0, 5, 5), (0.0, 0.0, 20.0, 10.0, 5, 5)], "x0 double, y0 double, dx double, dy double, mmax int, nmax int")
    e = spark.createDataFrame([], "row int, col int, h double, zs double")
    with pytest.raises(ValueError, match="different grids"):
        FL.align_runs(e, e, c)
    with pytest.raises(ValueError, match="unique"):
        FL.require_unique(spark.createDataFrame([(1,), (1,)], "index int"), ["index"])


def test_resolve_column(spark):
    d = spark.createDataFrame([(1, 2)], "H_ortho int, b int")
    assert resolve_column(d, ["h", "h_ORTHO"]) == "H_ortho" and resolve_column(d, ["q"], False) is None


def test_class_weights(spark):
    d = spark.createDataFrame([(1,), (0,), (0,), (0,)], "label int")
    assert sorted(r["w"] for r in class_weights(d).collect()) == [1.0, 1.0, 1.0, 3.0]


def test_score_arrays_in_batches(spark):
    d = spark.createDataFrame([(1, [1.0, 2.0]), (2, None)], "id int, a array<double>")
    got = {r["id"]: r["p"] for r in score_batches(d, lambda: (lambda x: x * 2), "a", "p").collect()}
    assert got == {1: [2.0, 4.0], 2: None}


def test_stream_steadiness_equals_batch(spark, tmp_path):
    from bermline.plans import views as V
    from bermline.plans.q_sources import event_arrivals
    from bermline.streaming import streams as ST

    d = "/root/testdata/sf0.001"
    inflow = V.table(spark, d, "events").groupBy(F.col("event_type").alias("run")).agg((F.max("value") * 100).alias("q_in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for arrived in event_arrivals(spark, d, str(tmp_path)):
            s = ST.stream_steadiness(ST.hourly_volumes(arrived), inflow, 25.0)
            q = (s.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck"))
                 .outputMode("append").trigger(availableNow=True).start())
            q.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = {(r["run"], r["hour_start"]): r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    b = W.hourly_volume_change(V.hourly(spark, d), inflow).collect()
    t0 = dt.datetime(1970, 1, 1)
    want = {(r["run"], t0 + dt.timedelta(hours=r["hour"] + 473352)): r for r in b}
    assert len(got) > 0.8 * len(want)
    for k, r in got.items():
        w = want[k]["dV_dt_m3s"]
        assert (r["dV_dt_m3s"] is None) == (w is None) and (w is None or abs(r["dV_dt_m3s"] - w) < 1e-6)


def test_student_p_by_table():
    """Two-sided 5 % points of Student's t."""
    for dof, t in ((1, 12.7062), (2, 4.30265), (5, 2.57058), (10, 2.22814), (30, 2.04227), (120, 1.97993)):
        assert abs(RB.student_p(t, dof) - 0.05) < 1e-5 and abs(RB.student_p(-t, dof) - 0.05) < 1e-5
    assert RB.student_p(0.0, 7) == 1.0
