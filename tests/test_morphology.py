"""Morphology, thinning, components and centre lines against plain implementations."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from bermline.operators import graphs as GR
from bermline.operators import morphology as M
from bermline.operators import rasters as R

GRID = R.Grid(0.0, 0.0, 1.0)


def px(spark, cells):
    return spark.createDataFrame([(int(r), int(c)) for r, c in cells], "row long, col long")


def cells(df):
    return {(r["row"], r["col"]) for r in df.collect()}


def blob(seed=2, n=60):
    rng = np.random.default_rng(seed)
    a = rng.random((n, n))
    for _ in range(3):
        p = np.pad(a, 1, mode="edge")
        a = sum(p[i:i + n, j:j + n] for i in range(3) for j in range(3)) / 9
    return (a > np.quantile(a, 0.6)).astype(np.uint8)


def test_components_cross_tiles(spark):
    a = blob()
    got = M.connected_components(px(spark, np.argwhere(a)), tile=16).collect()
    lab = {(r["row"], r["col"]): (r["component"]["row"], r["component"]["col"]) for r in got}
    assert len(lab) == a.sum()
    seen, want = set(), {}
    for s in map(tuple, np.argwhere(a).tolist()):
        if s in seen:
            continue
        stack, comp = [s], []
        seen.add(s)
        while stack:
            p = stack.pop()
            comp.append(p)
            for i, j in M.NEIGHBOURS:
                q = (p[0] + i, p[1] + j)
                if 0 <= q[0] < 60 and 0 <= q[1] < 60 and a[q] and q not in seen:
                    seen.add(q)
                    stack.append(q)
        want.update({p: min(comp) for p in comp})
    assert lab == want


def test_diagonal_neighbours_are_one_component(spark):
    assert len({r["component"] for r in M.connected_components(px(spark, [(0, 0), (1, 1)])).collect()}) == 1
    assert len({r["component"] for r in M.connected_components(px(spark, [(0, 0), (1, 1)]), 4).collect()}) == 2


def test_star_contraction_on_a_hub_and_a_path(spark):
    e = [(0, i) for i in range(1, 400)] + [(1000 + i, 1001 + i) for i in range(300)] + [(7, 7)]
    c = {r["id"]: r["component"] for r in GR.components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert len(c) == 701 and all(v == (0 if k < 400 else 1000) for k, v in c.items())


def test_closing_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    a = rng.random((20, 20)) < 0.15
    se = M.disk(3)
    ins = lambda r, c: 0 <= r < 20 and 0 <= c < 20
    wide = {(r + i, c + j) for r, c in np.argwhere(a) for i, j in se if ins(r + i, c + j)}
    want = {(r, c) for r in range(20) for c in range(20) if all((r + i, c + j) in wide for i, j in se if ins(r + i, c + j))}
    assert cells(M.binary_closing(px(spark, np.argwhere(a)), 3, (), 20, 20)) == want


def test_thinning_by_tiles_equals_whole(spark):
    a = blob(6, 90)
    want = np.pad(a, 2)
    while True:
        changed = False
        for second in (False, True):
            kill = M.thin_step(want, second)
            changed |= bool(kill.any())
            want[kill] = 0
        if not changed:
            break
    got = cells(M.skeletonize(px(spark, np.argwhere(a)), tile=32, steps=2))
    assert got == {(r - 2, c - 2) for r, c in map(tuple, np.argwhere(want).tolist())}


def thinned(a):
    want = np.pad(a, 2)
    while True:
        changed = False
        for second in (False, True):
            kill = M.thin_step(want, second)
            changed |= bool(kill.any())
            want[kill] = 0
        if not changed:
            return want[2:-2, 2:-2]


def test_thinning_of_many_masks_equals_whole(spark):
    """200 random masks as rasters of one table, with tiles of three sizes."""
    r = np.random.default_rng(12)
    masks = []
    for k in range(200):
        a = (r.random((14 + k % 19, 14 + k % 19)) < 0.55 + 0.35 * r.random()).astype(np.uint8)
        a[r.integers(0, 12):, : 3 + k % 5] = 1
        masks.append(a)
    rows = [(k, int(i), int(j)) for k, a in enumerate(masks) for i, j in np.argwhere(a)]
    df = spark.createDataFrame(rows, "m long, row long, col long")
    want = {(k, int(i), int(j)) for k, a in enumerate(masks) for i, j in np.argwhere(thinned(a))}
    for tile, steps in ((8, 4), (16, 3), (32, 16)):
        assert {(x.m, x.row, x.col) for x in M.skeletonize(df, ["m"], tile=tile, steps=steps).collect()} == want


def test_y_skeleton_gives_one_line(spark):
    """Arms of 10, 10 and 3 pixels, minimum 5: one line of length 20."""
    arms = [(0, c) for c in range(-10, 11)] + [(r, 0) for r in range(1, 4)]
    lines = M.centrelines(px(spark, arms), GRID, 5.0).collect()
    assert [round(r["length_m"], 6) for r in lines] == [20.0]
    pts = [(p["x"], p["y"]) for p in lines[0]["pts"]]
    assert len(pts) == 21 and {pts[0], pts[-1]} == {(-9.5, -0.5), (10.5, -0.5)}
    assert all(abs(a[0] - b[0]) <= 1 and abs(a[1] - b[1]) <= 1 for a, b in zip(pts, pts[1:]))


def test_closed_ring_is_emitted(spark):
    ring = [(0, c) for c in range(1, 9)] + [(9, c) for c in range(1, 9)] + [(r, 0) for r in range(1, 9)] + [(r, 9) for r in range(1, 9)]
    lines = M.centrelines(px(spark, ring), GRID, 5.0).collect()
    assert len(lines) == 1 and len(lines[0]["pts"]) == len(ring) + 1 and lines[0]["pts"][0] == lines[0]["pts"][-1]


def test_walked_edges_cover_the_skeleton_once(spark):
    a = blob(8, 60)
    skel = cells(M.skeletonize(px(spark, np.argwhere(a))))
    lines = M.walk_edges(px(spark, skel), GRID).collect()
    deg = {p: sum((p[0] + i, p[1] + j) in skel for i, j in M.NEIGHBOURS) for p in skel}
    inner, steps = [], set()
    for r in lines:
        path = [(int(round(-p["y"] - 0.5)), int(round(p["x"] - 0.5))) for p in r["pts"]]
        assert len(path) >= 2 and all(max(abs(p[0] - q[0]), abs(p[1] - q[1])) == 1 for p, q in zip(path, path[1:]))
        inner += path[1:-1]
        for p, q in zip(path, path[1:]):
            e = (min(p, q), max(p, q))
            assert e not in steps
            steps.add(e)
        assert abs(r["length_px"] - sum(np.hypot(p[0] - q[0], p[1] - q[1]) for p, q in zip(path, path[1:]))) < 1e-9
    want = {(min(p, q), max(p, q)) for p in skel for i, j in M.NEIGHBOURS for q in [(p[0] + i, p[1] + j)] if q in skel}
    assert steps == want
    assert len(inner) == len(set(inner)) and all(deg[p] == 2 for p in inner)


def test_spurs_are_pruned(spark):
    main = [(0, c) for c in range(30)]
    spur, branch = [(r, 10) for r in range(1, 4)], [(r, 20) for r in range(1, 15)]
    got = cells(M.prune_spurs(px(spark, main + spur + branch), 5))
    assert not got & set(spur[1:]) and set(main) <= got and set(branch) <= got


def lines_df(spark, *lines):
    return spark.createDataFrame([(k, [{"x": float(x), "y": float(y)} for x, y in p]) for k, p in enumerate(lines)], "line_id long, pts array<struct<x: double, y: double>>")


def test_gaps_are_bridged_in_chains(spark):
    d = lines_df(spark, [(0, 0), (100, 0)], [(300, 1), (150, 0)], [(350, 0), (400, 0)], [(1000, 0), (1010, 0)], [(120, 30), (120, 200)])
    got = {r["line_id"]: r for r in M.bridge_gaps(d, 100.0, 45.0).collect()}
    assert sorted(got) == [0, 3, 4] and got[0]["n_lines"] == 3
    assert [(p["x"], p["y"]) for p in got[0]["pts"]] == [(0, 0), (100, 0), (150, 0), (300, 1), (350, 0), (400, 0)]


def test_greedy_matching_takes_shortest_first(spark):
    p = spark.createDataFrame([(1, 2, 5.0), (2, 3, 4.0), (3, 4, 3.0), (5, 6, 1.0), (4, 5, 2.0)], "a long, b long, gap double")
    assert {(r["a"], r["b"]) for r in GR.mutual_matching(p).collect()} == {(5, 6), (3, 4), (1, 2)}


def greedy(rows):
    used, out = set(), set()
    for g, a, b in sorted((g, a, b) for a, b, g in rows):
        if not {a, b} & used:
            used |= {a, b}
            out.add((a, b))
    return out


def test_matching_equals_greedy_order(spark):
    """A chain of 300 falling gaps is complete; random pairs with ties and hubs follow the greedy order."""
    chain = [(k, k + 1, float(1000 - k)) for k in range(300)]
    got = GR.mutual_matching(spark.createDataFrame(chain, "a long, b long, gap double")).collect()
    assert {(x["a"], x["b"]) for x in got} == greedy(chain) and len(got) == 150
    r = np.random.default_rng(3)
    rows = list({(int(min(a, b)), int(max(a, b))): (int(min(a, b)), int(max(a, b)), float(g)) for a, b, g in zip(r.integers(0, 40, 150), r.integers(0, 40, 150), r.integers(0, 20, 150)) if a != b}.values())
    got = GR.mutual_matching(spark.createDataFrame(rows, "a long, b long, gap double")).collect()
    assert {(x["a"], x["b"]) for x in got} == greedy(rows)
    assert GR.mutual_matching(spark.createDataFrame([], "a long, b long, gap double")).count() == 0


def test_pseudonodes_merge_but_junctions_do_not(spark):
    d = lines_df(spark, [(0, 0), (1, 0)], [(2, 0), (1, 0)], [(2, 0), (3, 0)], [(3, 0), (4, 1)], [(3, 0), (4, -1)])
    got = M.merge_pseudonodes(d).collect()
    assert sorted(r["n_lines"] for r in got) == [1, 1, 3]
    big = max(got, key=lambda r: r["n_lines"])
    assert [p["x"] for p in big["pts"]] in ([0, 1, 2, 3], [3, 2, 1, 0])


def test_closed_chain_of_lines_opens_once(spark):
    d = lines_df(spark, [(0, 0), (1, 0)], [(1, 0), (1, 1)], [(1, 1), (0, 0)])
    got = M.merge_pseudonodes(d).collect()
    assert len(got) == 1 and got[0]["n_lines"] == 3 and len(got[0]["pts"]) == 4


def test_outlets_with_cycle(spark):
    r = spark.createDataFrame([(1, 2), (2, 3), (3, 0), (4, 9), (5, 6), (6, 5), (7, 6), (8, None)], "comid long, next_down long")
    got = {x["comid"]: x["basin_id"] for x in GR.trace_outlets(r).collect()}
    assert got == {1: 3, 2: 3, 3: 3, 4: 4, 5: 5, 6: 5, 7: 5, 8: 8}


def test_long_river(spark):
    n = 3000
    r = spark.range(1, n + 1).select(F.col("id").alias("comid"), (F.col("id") - 1).alias("next_down"))
    assert GR.trace_outlets(r).filter("basin_id <> 1").isEmpty()


def test_coverage_groups(spark):
    area = [(x, y) for x in range(10) for y in range(10)]
    sc = [(1, x, y) for x, y in area if x < 6] + [(2, x, y) for x, y in area if x >= 5] + [(3, x, y) for x, y in area] + [(4, 99, 99)] + [(5, x, y) for x, y in area if x == 0]
    got = GR.coverage_groups(spark.createDataFrame(sc, "scene_id long, cx long, cy long"), spark.createDataFrame(area, "cx long, cy long")).collect()
    rows = sorted((r["grp"], r["step"], r["scene_id"], r["accepted"]) for r in got)
    assert rows == [(0, 0, 3, True), (1, 0, 1, True), (1, 1, 2, True), (2, 0, 5, False)]


@pytest.mark.parametrize("tile", [8, 16, 64])
def test_texture_does_not_depend_on_tiles(spark, tile):
    rng = np.random.default_rng(0)
    q = rng.integers(0, 16, (21, 19))
    d = spark.createDataFrame([(int(r), int(c), int(q[r, c])) for r in range(21) for c in range(19)], "row long, col long, level int")
    got = R.glcm(d, 21, 19, window=7, levels=16, tile=tile).orderBy("row", "col").toPandas()
    p = np.pad(q, 3, mode="reflect")
    want = []
    for r in range(21):
        for c in range(19):
            w, g = p[r:r + 7, c:c + 7], np.zeros((16, 16))
            for a, b in ((w[:, :-1], w[:, 1:]), (w[1:, :-1], w[:-1, 1:]), (w[:-1], w[1:]), (w[:-1, :-1], w[1:, 1:])):
                np.add.at(g, (a.ravel(), b.ravel()), 1)
                np.add.at(g, (b.ravel(), a.ravel()), 1)
            g /= g.sum()
            i, j = np.indices(g.shape)
            mi, mj = (g * i).sum(), (g * j).sum()
            sd = max(np.sqrt((g * (i - mi) ** 2).sum() * (g * (j - mj) ** 2).sum()), 1e-10)
            want.append(((g * (i - j) ** 2).sum(), (g / (1 + abs(i - j))).sum(), (g ** 2).sum(), (g * (i - mi) * (j - mj)).sum() / sd))
    np.testing.assert_allclose(got[["contrast", "homogeneity", "energy", "correlation"]].to_numpy(), np.array(want), atol=1e-9)


def test_tpi_forms_agree(spark):
    rng = np.random.default_rng(9)
    z = rng.normal(size=(16, 16))
    d = spark.createDataFrame([(r, c, float(z[r, c])) for r in range(16) for c in range(16)], "row long, col long, value double")
    pix = R.tpi(d, 3).orderBy("row", "col").toPandas()["value"].to_numpy()
    arr = spark.createDataFrame([(z.ravel().tolist(),)], "a array<double>").select(R.patch_tpi(F.col("a"), 16, 3).alias("t")).first()["t"]
    np.testing.assert_allclose(pix, arr, atol=1e-9)
    ones = spark.createDataFrame([(r, c, 1.0) for r in range(3) for c in range(3)], "row long, col long, value double")
    assert all(abs(r["value"]) < 1e-12 for r in R.tpi(ones, 1).collect())


def test_mosaic_hand_case(spark):
    d = spark.createDataFrame([(0, 0, 0, 1.0), (0, 0, 1, None), (1, 0, 0, 2.0), (1, 0, 1, 5.0)], "ord int, row int, col int, value double")
    val = lambda m: [r["value"] for r in m.orderBy("col").collect()]
    assert val(R.mosaic_in_order(d, "ord")) == [1, 5] and val(R.mosaic_extreme(d)) == [2, 5] and val(R.mosaic_sum(d)) == [3, 5]


def test_soft_skeleton_and_cldice(spark):
    z = [0.0] * 64
    one = [1.0 if 8 * 3 <= i < 8 * 4 else 0.0 for i in range(64)]
    d = spark.createDataFrame([(0, z, [0] * 64), (1, one, [int(v) for v in one]), (2, one, [0] * 64)], "id int, prob array<double>, label array<int>")
    got = {r["id"]: r["cldice"] for r in R.cldice(d, 8).collect()}
    assert abs(got[0] - 1) < 1e-6 and abs(got[1] - 1) < 1e-6 and got[2] < 1e-3


def test_stitch_constant_patches(spark):
    d = spark.createDataFrame([(100.0, 100.0, [0.7] * 64), (140.0, 100.0, [0.7] * 64)], "cx double, cy double, prob array<double>")
    for m in ("feather", "average", "max"):
        v = [r["value"] for r in R.stitch(d, (60.0, 60.0, 180.0, 140.0), 40.0, 80.0, 10.0, 8, m).collect()]
        assert v and all(abs(x - 0.7) < 1e-12 for x in v)


def test_patch_labels_and_channels(spark):
    g = R.Grid(0.0, 640.0, 10.0, 64, 64)
    z = np.random.default_rng(1).random((64, 64))
    d = spark.createDataFrame([(r, c, float(z[r, c])) for r in range(64) for c in range(64)], "row long, col long, value double")
    t = R.to_tiles(d, 16)
    c = spark.createDataFrame([("a", 320.0, 320.0), ("b", 10.0, 630.0), ("out", 5000.0, 0.0)], "patch_id string, x double, y double")
    ln = spark.createDataFrame([(1, [{"x": 300.0, "y": 330.0}, {"x": 340.0, "y": 330.0}])], "line_id long, pts array<struct<x: double, y: double>>")
    cells_ = R.rasterize(ln, g, 15.0)
    a = {r["patch_id"]: r for r in R.assemble_channels(c, {k: t for k in ("dsm", "canopy_height", "canopy_height_sd", "water")}, dict.fromkeys(("dsm", "canopy_height", "canopy_height_sd", "water"), g), cells_, 8, 10.0, (1,), 16).collect()}
    assert set(a) == {"a", "b"} and len(a["a"]["channels"]) == 5
    np.testing.assert_allclose(np.array(a["a"]["channels"]["dsm"]).reshape(8, 8), z[28:36, 28:36], atol=1e-6)
    b = np.array(a["b"]["channels"]["dsm"]).reshape(8, 8)
    assert (b[:3] == 0).all() and (b[:, :3] == 0).all()
    np.testing.assert_allclose(b[3:, 3:], z[:5, :5], atol=1e-6)
    want = {(r["row"] - 28, r["col"] - 28) for r in cells_.collect() if 28 <= r["row"] < 36 and 28 <= r["col"] < 36}
    assert {divmod(i, 8) for i, v in enumerate(a["a"]["label"]) if v} == want and a["b"]["n_label_px"] == 0


def pruned(cells, min_px):
    """Brute force: every end walks to its junction, all at once, until nothing goes."""
    cells = set(cells)
    while True:
        near = {c: [(c[0] + i, c[1] + j) for i, j in M.NEIGHBOURS if (c[0] + i, c[1] + j) in cells] for c in cells}
        gone = set()
        for e in (c for c in cells if len(near[c]) == 1):
            path, at = [e], near[e][0]
            while len(near[at]) == 2 and len(path) < min_px:
                path, at = path + [at], next(x for x in near[at] if x != path[-1])
            if len(near[at]) >= 3:
                gone |= set(path)
        if not gone:
            return cells
        cells -= gone


def test_prune_spurs_by_tiles(spark):
    rng = np.random.default_rng(7)
    cells = [(int(r), int(c)) for r, c in np.argwhere(rng.random((70, 50)) < 0.22) - 9]
    sc = spark.sparkContext
    for min_px, steps in ((1, 1), (3, 1), (4, 3)):
        sc.setJobGroup(f"prune{min_px}", "")
        got = {(r["row"], r["col"]) for r in M.prune_spurs(px(spark, cells), min_px, tile=16, steps=steps).collect()}
        assert got == pruned(cells, min_px)
    # a pass is a shuffle and a count; contracting the graph in every round took hundreds of jobs
    assert len(sc.statusTracker().getJobIdsForGroup("prune4")) < 40
    sc.setJobGroup("rest", "")
