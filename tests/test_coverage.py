"""Quadtree covers and runs of cells against brute force."""
import math
import random

import numpy as np
from pyspark.sql import functions as F

from bermline.operators import cells as C
from bermline.operators import coverage as V
from bermline.operators import samples as S

POLYGON = "polygon_id long, parts array<array<struct<x: double, y: double>>>"
LINE = "line_id long, pts array<struct<x: double, y: double>>"


def closed(points):
    pts = [{"x": float(a), "y": float(b)} for a, b in points]
    return [*pts, pts[0]]


def inside(parts, px, py):
    """Crossings to the right of each point."""
    odd = np.zeros(len(px), bool)
    for ring in parts:
        x, y = np.array([p["x"] for p in ring]), np.array([p["y"] for p in ring])
        for a, b, c, d in zip(x[:-1], y[:-1], x[1:], y[1:]):
            if b != d:
                odd ^= ((b > py) != (d > py)) & (px < (c - a) * (py - b) / (d - b) + a)
    return odd


def star(n, cx, cy, r, seed):
    g = np.random.default_rng(seed)
    t = np.sort(g.uniform(0, 2 * math.pi, n))
    k = r * g.uniform(0.4, 1.0, n)
    return closed(zip(cx + k * np.cos(t), cy + k * np.sin(t)))


def check(spark, polygons, px, py, size):
    points = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(px, py))], "id long, x double, y double")
    df = spark.createDataFrame(polygons, POLYGON)
    got = {(r["id"], r["polygon_id"]) for r in C.point_in_polygon(points, df, "inner", size).select("id", "polygon_id").collect()}
    want = {(int(i), pid) for pid, parts in polygons for i in np.flatnonzero(inside(parts, px, py))}
    assert got == want
    some = {i for i, _ in want}
    assert {r["id"] for r in C.point_in_polygon(points, df.drop("polygon_id"), size=size).collect()} == some
    assert {r["id"] for r in C.point_in_polygon(points, df, "left_anti", size, key=["id"]).collect()} == set(range(len(px))) - some


def test_points_in_polygons_equal_brute_force(spark):
    g = np.random.default_rng(5)
    polygons = [(i, [star(40, *g.uniform(-300, 300, 2), g.uniform(20, 200), i), star(15, 0, 0, 30, i + 50)]) for i in range(6)]
    check(spark, polygons, g.uniform(-400, 400, 3000), g.uniform(-400, 400, 3000), 17.0)


def test_points_on_round_coordinates(spark):
    """Vertices, edges and points share coordinates; the rule is that of the plain crossing test."""
    r = random.Random(3)
    polygons = [(0, [closed([(0, 0), (8, 0), (8, 8), (0, 8)]), closed([(2, 2), (2, 6), (6, 6), (6, 2)])]), (1, [closed([(4, -4), (12, 4), (4, 12), (-4, 4)])]),
                (2, [closed([(r.randrange(-6, 14), r.randrange(-6, 14)) for _ in range(9)])])]
    px, py = (np.array(v, float) for v in zip(*[(a / 2, b / 2) for a in range(-14, 30) for b in range(-14, 30)]))
    for size in (1.0, 2.0, 5.0):
        check(spark, polygons, px, py, size)


def test_polygon_of_many_vertices(spark):
    g = np.random.default_rng(8)
    t = np.arange(100_000) * (2 * math.pi / 100_000)
    k = 800 + 60 * np.sin(9 * t) + 0.02 * g.uniform(-1, 1, 100_000)
    ring = closed(zip(k * np.cos(t), k * np.sin(t)))
    px, py = g.uniform(-900, 900, 400), g.uniform(-900, 900, 400)
    points = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(px, py))], "id long, x double, y double")
    df = spark.createDataFrame([(7, [ring])], POLYGON)
    cover = V.polygon_cover(df, 20.0)
    most = cover.agg(F.max(F.size("_edges")).alias("n"), F.min("_base").alias("b")).first()
    assert most["n"] <= V.MOST_EDGES and most["b"] < 0
    x, y = np.array([p["x"] for p in ring]), np.array([p["y"] for p in ring])
    a, b, c, d = x[:-1, None], y[:-1, None], x[1:, None], y[1:, None]
    want = set()
    for k in range(0, 400, 50):
        p, q = px[None, k:k + 50], py[None, k:k + 50]
        with np.errstate(divide="ignore", invalid="ignore"):
            odd = (((b > q) != (d > q)) & (p < (c - a) * (q - b) / (d - b) + a)).sum(axis=0) % 2 == 1
        want |= {int(i) + k for i in np.flatnonzero(odd)}
    assert {r["id"] for r in V.polygon_pairs(points, cover, 20.0).collect()} == want


def test_polygons_without_anything(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, None, 1.0)], "id long, x double, y double")
    none = spark.createDataFrame([], POLYGON)
    assert C.point_in_polygon(points, none, "inner").count() == 0 and C.point_in_polygon(points, none).count() == 0
    odd = spark.createDataFrame([(None, [closed([(-1, -1), (1, -1), (0, 2)])]), (4, None), (5, []), (6, [[]]), (3, [closed([(-1, -1), (1, -1), (0, 2)])])], POLYGON)
    assert [r["polygon_id"] for r in C.point_in_polygon(points, odd, "inner").collect()] == [3]


def test_clipped_lengths(spark):
    polygons = [(1, [star(30, 0, 0, 100, 4), star(12, 10, 5, 20, 6)]), (2, [star(30, 60, 20, 90, 5)])]
    r = random.Random(6)
    lines = [(i, [{"x": r.uniform(-120, 160), "y": r.uniform(-120, 120)} for _ in range(3)]) for i in range(25)]
    got = C.clip_lines(spark.createDataFrame(lines, LINE), spark.createDataFrame(polygons, POLYGON), 15.0).groupBy("line_id", "polygon_id").agg(F.sum("len").alias("s")).collect()
    got = {(x["line_id"], x["polygon_id"]): x["s"] for x in got}
    t = (np.arange(40_000) + 0.5) / 40_000
    for i, p in lines:
        for pid, parts in polygons:
            want = sum(inside(parts, a["x"] + t * (b["x"] - a["x"]), a["y"] + t * (b["y"] - a["y"])).mean() * math.hypot(b["x"] - a["x"], b["y"] - a["y"]) for a, b in zip(p, p[1:]))
            assert abs(got.get((i, pid), 0.0) - want) < 0.1


def cells_near(lines, buffer, size, box):
    c, r = np.meshgrid(np.arange(*box), np.arange(*box))
    x, y, hit = (c + 0.5) * size, (r + 0.5) * size, np.zeros(c.shape, bool)
    for p in lines:
        for a, b in zip(p, p[1:]):
            dx, dy = b[0] - a[0], b[1] - a[1]
            t = np.clip(((x - a[0]) * dx + (y - a[1]) * dy) / max(dx * dx + dy * dy, 1e-300), 0, 1)
            hit |= np.hypot(x - a[0] - t * dx, y - a[1] - t * dy) <= buffer
    return {(int(i), int(j)) for i, j in zip(r[hit], c[hit])}


def pieces_of(cells):
    left, out = set(cells), []
    while left:
        todo, mine = [left.pop()], 0
        while todo:
            r, c = todo.pop()
            mine += 1
            for n in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                if n in left:
                    left.remove(n)
                    todo.append(n)
        out.append(mine)
    return sorted(out)


def test_corridor_equals_brute_raster(spark, monkeypatch):
    r = random.Random(2)
    lines = [[(r.uniform(-60, 60), r.uniform(-60, 60)) for _ in range(2)] for _ in range(6)] + [[(-40.3, 7.1), (50.2, 7.1)], [(3.3, -50.0), (3.3, 20.0)], [(55.0, 55.0), (55.0, 55.0)]]
    lines = [[(a / 2, b / 2) for a, b in p] for p in lines]
    df = spark.createDataFrame([(i, [{"x": a, "y": b} for a, b in p]) for i, p in enumerate(lines)], LINE)
    for block in (16,):  # runs end where a block of cells ends
        monkeypatch.setattr(V, "RUN_BLOCK", block)
        runs = S.corridor_runs(df, 1.37, 0.5).collect()
        got = [(x["row"], c) for x in runs for c in range(x["c0"], x["c1"] + 1)]
        assert len(got) == len(set(got)) and set(got) == cells_near(lines, 1.37, 0.5, (-80, 80))
        pieces = S.corridor_pieces(df, 1.37, 0.5).collect()
        assert sorted(x["n_cells"] for x in pieces) == pieces_of(got)
        assert abs(sum(x["area"] for x in pieces) - 0.25 * len(got)) < 1e-9


def test_polygon_runs_and_shares(spark):
    polygons = [(i, [star(25, 3 * i, -2 * i, 12, i), star(8, 3 * i, -2 * i, 4, i + 30)]) for i in range(4)]
    df = spark.createDataFrame(polygons, POLYGON)
    c, r = (v.ravel() for v in np.meshgrid(np.arange(-60, 60), np.arange(-60, 60)))
    cells = {pid: {(int(a), int(b)) for a, b in zip(r[m], c[m])} for pid, parts in polygons for m in [inside(parts, (c + 0.5) * 0.5, (r + 0.5) * 0.5)]}
    got = {}
    for x in V.polygon_runs(df, 0.5).collect():
        got.setdefault(x["polygon_id"], set()).update((x["row"], k) for k in range(x["c0"], x["c1"] + 1))
    assert got == cells
    aoi = df.filter("polygon_id < 2")
    area = cells[0] | cells[1]
    shares = C.coverage_share(df.withColumnRenamed("polygon_id", "scene_id"), aoi, 0.5).collect()
    assert {x["scene_id"]: (x["cells"], round(x["share"], 9)) for x in shares} == {i: (len(s & area), round(len(s & area) / len(area), 9)) for i, s in cells.items()}


def test_candidates_are_uniform_over_cells(spark):
    runs = spark.createDataFrame([(0, 0, 9), (3, -5, -5), (4, 100, 188)], "row long, c0 long, c1 long")
    got = S.cells_of_runs(runs, 0, 20_000).groupBy("row", "col").count().collect()
    assert len(got) == 100 and sum(x["count"] for x in got) == 20_000 and 130 < min(x["count"] for x in got) and max(x["count"] for x in got) < 280
    assert S.cells_of_runs(runs.filter("false"), 0, 5).count() == 0
