import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from bermline.functions import crs
from bermline.functions import geometry as G
from bermline.operators import cells as C
from bermline.operators import rasters as R
from bermline.operators import rows as P


def line(spark, *pts, **cols):
    d = spark.createDataFrame([(1, [{"x": float(x), "y": float(y)} for x, y in pts])], "line_id long, pts array<struct<x: double, y: double>>")
    return d.withColumns({k: F.lit(v) for k, v in cols.items()})


def lengths(df):
    return [round(r["length_m"], 6) for r in df.orderBy("k").collect()]


@pytest.mark.parametrize("L, want", [(1250, [625, 625]), (99, []), (100, [100]), (2500, [500] * 5)])
def test_segment_equal(spark, L, want):
    assert lengths(P.segment_equal(line(spark, (0, 0), (L, 0)))) == want


@pytest.mark.parametrize("L, want", [(1300, [1300]), (1400, [1400]), (2500, [1000, 1000, 500]), (2300, [1000, 1300]), (2000, [1000, 1000])])
def test_segment_tail_merge(spark, L, want):
    assert lengths(P.segment_tail_merge(line(spark, (0, 0), (L, 0)))) == want


def test_substring_keeps_vertices_and_length(spark):
    d = line(spark, (0, 0), (10, 0), (10, 10), (30, 10))
    s = d.select(G.substring(F.col("pts"), F.lit(5.0), F.lit(25.0)).alias("s")).first()["s"]
    assert [(p["x"], p["y"]) for p in s] == [(5, 0), (10, 0), (10, 10), (15, 10)]


def test_angle_degenerate(spark):
    d = spark.range(1)
    z = [F.lit(float(v)) for v in (0, 0, 0, 0, 1, 1)]
    assert d.select(G.angle_deg(*z)).first()[0] == 180.0


def test_known_map_coordinates(spark):
    """Central meridian and origin points, and the round trip of random positions."""
    d = spark.createDataFrame([(19.0, 52.0)], "lon double, lat double")
    p = d.select(crs.forward(F.col("lon"), F.col("lat"), 2180).alias("p")).first()["p"]
    # meridian arc of 52 N on GRS80 by numeric integration
    lat = np.radians(np.linspace(0, 52, 200001))
    m = crs.A * (1 - crs.E2) / (1 - crs.E2 * np.sin(lat) ** 2) ** 1.5
    arc = np.sum((m[1:] + m[:-1]) / 2 * np.diff(lat))
    assert abs(p["x"] - 500000) < 1e-6 and abs(p["y"] - (0.9993 * arc - 5300000)) < 1e-3
    o = spark.createDataFrame([(10.0, 52.0)], "lon double, lat double").select(crs.forward(F.col("lon"), F.col("lat"), 3035).alias("p")).first()["p"]
    assert abs(o["x"] - 4321000) < 1e-6 and abs(o["y"] - 3210000) < 1e-6
    a = spark.createDataFrame([(-96.0, 23.0)], "lon double, lat double").select(crs.forward(F.col("lon"), F.col("lat"), 5070).alias("p")).first()["p"]
    assert abs(a["x"]) < 1e-6 and abs(a["y"]) < 1e-6


@pytest.mark.parametrize("epsg, lon, lat", [(2180, 21.3, 50.2), (3035, 4.9, 52.3), (5070, -90.1, 35.2)])
def test_projection_round_trip(spark, epsg, lon, lat):
    d = spark.createDataFrame([(lon, lat)], "lon double, lat double").withColumn("p", crs.forward(F.col("lon"), F.col("lat"), epsg))
    r = d.select(crs.inverse(F.col("p.x"), F.col("p.y"), epsg).alias("g")).first()["g"]
    assert abs(r["lon"] - lon) < 1e-9 and abs(r["lat"] - lat) < 1e-8


def seg_dist(p, a, b):
    p, a, b = map(np.asarray, (p, a, b))
    t = np.clip(np.dot(p - a, b - a) / np.dot(b - a, b - a), 0, 1)
    return float(np.hypot(*(p - a - t * (b - a))))


def test_joins_equal_brute_force_with_a_hot_cell(spark):
    """A third of the points sits in one place; negative coordinates occur."""
    rng = np.random.default_rng(3)
    pts = [(i, *(rng.normal(3, 0.5, 2) if i % 3 == 0 else rng.uniform(-60, 60, 2))) for i in range(300)]
    pts = [(i, float(x), float(y)) for i, x, y in pts]
    segs = [(j, *map(float, (x, y, x + dx, y + dy))) for j, (x, y, dx, dy) in enumerate(np.c_[rng.uniform(-60, 60, (40, 2)), rng.uniform(-30, 30, (40, 2))])]
    p = spark.createDataFrame(pts, "id long, x double, y double")
    ln = spark.createDataFrame([(j, [{"x": a, "y": b}, {"x": c, "y": d}]) for j, a, b, c, d in segs], "line_id long, pts array<struct<x: double, y: double>>")
    want = {}
    for i, x, y in pts:
        ds = sorted((seg_dist((x, y), (a, b), (c, d)), j) for j, a, b, c, d in segs)
        if ds[0][0] <= 7:
            want[i] = ds[0]
    got = {r["id"]: (r["d"], r["line_id"]) for r in C.nearest_within(p, ln, 7.0).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k][0] - want[k][0]) < 1e-9 and got[k][1] == want[k][1] for k in want)
    assert {r["id"] for r in C.within_buffer_semi(p, ln, 7.0).collect()} == set(want)
    assert {r["id"] for r in C.exclude_near(p, ln, 7.0).collect()} == {i for i, *_ in pts} - set(want)

    refs = [(k, float(x), float(y)) for k, (x, y) in enumerate(rng.uniform(-300, 300, (25, 2)))]
    n = C.nearest_join(p, spark.createDataFrame(refs, "rid long, x double, y double"), "rid", 2.0).collect()
    assert len(n) == 300
    for r in n:
        d = min(math.hypot(r["x"] - x, r["y"] - y) for _, x, y in refs)
        assert abs(r["d"] - d) < 1e-9


def test_nearest_within_left_has_null(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0), (2, 500.0, 0.0)], "id long, x double, y double")
    r = {x["id"]: x["d"] for x in C.nearest_within(p, line(spark, (0, 3), (5, 3)), 10.0, how="left").collect()}
    assert r[1] == 3.0 and r[2] is None


def test_ring_is_inclusive(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0)], "id long, x double, y double")
    r = spark.createDataFrame([(k, float(x), 0.0) for k, x in enumerate((49.9, 50, 200, 200.1))], "rid long, x double, y double")
    assert {x["rid"] for x in C.ring_join(p, r).collect()} == {1, 2}


@pytest.mark.parametrize("touched", [True, False])
def test_rasterize_equals_brute_force(spark, touched):
    segs = [((3.0, 95.0), (77.0, 12.0)), ((10.0, 10.0), (90.0, 10.0))]
    d = spark.createDataFrame([(k, [{"x": a[0], "y": a[1]}, {"x": b[0], "y": b[1]}]) for k, (a, b) in enumerate(segs)], "line_id long, pts array<struct<x: double, y: double>>")
    got = {(r["row"], r["col"]) for r in R.rasterize(d, R.Grid(0.0, 100.0, 5.0, 20, 20), 4.0, touched).collect()}

    def box_dist(a, b, r, c):
        # sampled distance of the cell square to the segment
        t = np.linspace(0, 1, 4001)
        x, y = a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])
        l, top = c * 5.0, 100 - r * 5.0
        return np.hypot(np.maximum.reduce([l - x, 0 * x, x - l - 5]), np.maximum.reduce([top - 5 - y, 0 * y, y - top])).min()

    for r in range(20):
        for c in range(20):
            if touched:
                d0 = min(box_dist(a, b, r, c) for a, b in segs)
            else:
                d0 = min(seg_dist((c * 5 + 2.5, 97.5 - r * 5), a, b) for a, b in segs)
            if abs(d0 - 4.0) > 0.02:
                assert ((r, c) in got) == (d0 < 4.0), (r, c, d0)


def test_sliding_centres_equal_brute_force(spark):
    d = line(spark, (-37, 11), (143, 88), (150, -60))
    got = {(r["x"], r["y"]) for r in R.sliding_centres(d, 6.0, 16.0, 32.0).collect()}
    t = np.linspace(0, 1, 5001)
    want = set()
    for i in range(-10, 20):
        for j in range(-10, 20):
            cx, cy = (i + 0.5) * 16, (j + 0.5) * 16
            best = 1e9
            for a, b in (((-37, 11), (143, 88)), ((143, 88), (150, -60))):
                x, y = a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])
                best = min(best, np.hypot(np.maximum(np.abs(x - cx) - 16, 0), np.maximum(np.abs(y - cy) - 16, 0)).min())
            if best <= 6.0:
                want.add((cx, cy))
    assert got == want


def test_convex_hull_equals_support_points(spark):
    rng = np.random.default_rng(5)
    xy = rng.normal(0, 10, (5000, 2))
    d = spark.createDataFrame([("k", float(x), float(y)) for x, y in xy], "key string, x double, y double")
    h = P.convex_hull(d, "key", salts=7).orderBy("k").collect()
    hull = np.array([(r["x"], r["y"]) for r in h])
    for a in np.linspace(0, 2 * np.pi, 360):
        u = np.array([np.cos(a), np.sin(a)])
        assert abs((xy @ u).max() - (hull @ u).max()) < 1e-12
    nxt = np.roll(hull, -1, axis=0)
    area2 = (hull[:, 0] * nxt[:, 1] - hull[:, 1] * nxt[:, 0]).sum()
    assert area2 > 0


def test_symmetries_invert(spark):
    d = spark.createDataFrame([(list(map(float, range(16))),)], "a array<double>")
    for f, k in P.D4:
        t = P.turn(F.col("a"), 4, f, k)
        x = np.arange(16).reshape(4, 4)
        want = np.rot90(np.fliplr(x) if f else x, k).ravel().tolist()
        r = d.select(t.alias("t"), P.unturn(t, 4, f, k).alias("u")).first()
        assert r["t"] == want and r["u"] == list(range(16))
    for h in P.FLIPS:
        assert d.select(P.mirror(P.mirror(F.col("a"), 4, h), 4, h).alias("u")).first()["u"] == list(range(16))
    same = P.tta_average(d, lambda a: a, 4, "a").first()["prob"]
    flip = P.tta_average(d, lambda a: a, 4, "a", "flip").first()["prob"]
    assert same == list(range(16)) == flip


def test_augment_keeps_pixels_together(spark):
    d = spark.createDataFrame([(str(i), list(map(float, range(16))), list(range(16))) for i in range(40)], "id string, a array<double>, b array<int>")
    rows = P.augment(d, ["a", "b"], 4, ["id"]).collect()
    assert len({r["t"] for r in rows}) == 8
    assert all([int(v) for v in r["a"]] == r["b"] and sorted(r["b"]) == list(range(16)) for r in rows)


def test_point_pairs_copies_few_rows(spark, monkeypatch):
    from bermline.operators import cells as C
    n, kept = 30, []
    monkeypatch.setattr(C, "_exploded", lambda df: kept.append(df.count()) or df)
    grid = [(float(i % n), float(i // n) - 7) for i in range(n * n)]
    a = spark.createDataFrame(grid[::7], "x double, y double")
    got = C.point_pairs(a, spark.createDataFrame(grid, "x double, y double"), 3.0, 1.0).collect()
    want = {(p, q) for p in grid[::7] for q in grid if 1.0 <= ((p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2) ** 0.5 <= 3.0}
    assert len(got) == len(want) and {((r["x"], r["y"]), (r["rx"], r["ry"])) for r in got} == want
    assert kept[0] < 6 * n * n
