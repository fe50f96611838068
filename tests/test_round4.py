"""Cases of the fourth review: plans that stay small, jobs that don't follow the number of rows."""
import random

from bermline.operators import coverage as A


def test_rows_of_edges_are_not_written_out_many_times(spark):
    """The filter on the runs had each term of the buffer's outline several times, too long to be compiled."""
    ln = spark.createDataFrame([(0, [(0.0, 0.0), (50.0, 20.0), (90.0, 20.0)])], "line_id long, pts array<struct<x double, y double>>")
    assert A.line_runs(ln, 7.0, 5.0)._jdf.queryExecution().optimizedPlan().toString().count("SQRT") <= 4


def test_runs_are_dissolved_without_broadcast_and_by_tile(spark):
    """Random runs over several tiles and blocks against labels spread cell by cell; the graph holds no runs from inside tiles."""
    rnd = random.Random(3)
    rows = [(rnd.randrange(-150, 150), c, c + rnd.randrange(1, 30)) for c in (rnd.randrange(-60, 60) + 4096 * rnd.randrange(-1, 2) for _ in range(1500))]
    seen, real = [], A.components
    A.components = lambda e: (seen.append(e), real(e))[1]
    try:
        got = A.dissolve_runs(spark.createDataFrame(rows, "row long, c0 long, c1 long")).collect()
    finally:
        A.components = real
    assert "BroadcastHashJoin" not in seen[0]._jdf.queryExecution().executedPlan().toString() and seen[0].count() < len(got) / 4
    piece = {(r["row"], c): r["piece"] for r in got for c in range(r["c0"], r["c1"] + 1)}
    cells, label = {(r, c) for r, a, b in rows for c in range(a, b + 1)}, {}
    assert cells == set(piece)
    for start in cells:
        todo = [start]
        while todo:
            r, c = todo.pop()
            if (r, c) in cells and (r, c) not in label:
                label[r, c] = start
                todo += [(r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)]
    assert len({(piece[k], label[k]) for k in cells}) == len(set(piece.values())) == len(set(label.values()))


def test_coverage_groups_take_jobs_by_group_not_by_scene(spark, monkeypatch):
    """Against the greedy order scene by scene; pieces in a task and pieces by joins give the same."""
    from bermline.operators import graphs as GR

    rnd, rows = random.Random(8), []
    for k in range(24):
        x, y = 50 * (k % 2) + rnd.randrange(5), rnd.randrange(5)
        rows += [(k, x + i, y + j) for i in range(1 + rnd.randrange(4)) for j in range(1 + rnd.randrange(4))]
    area = {(c + 50 * b, d) for b in range(2) for c in range(6) for d in range(6)}
    cells, pool, want = {}, set(range(24)), []
    for k, x, y in rows:
        cells.setdefault(k, set()).update({(x, y)} & area)
    for grp in range(24):
        free, members = set(area), []
        while len(area) - len(free) < 0.6 * len(area):
            n, k = max((len(cells[k] & free), -k) for k in pool)
            if not n:
                break
            members.append(-k)
            free -= cells[-k]
        covered = len(area) - len(free)
        want += [(k, grp, i, covered / len(area), covered >= 0.6 * len(area)) for i, k in enumerate(members)]
        pool -= set(members)
        if not members or not any(cells[k] for k in pool):
            break
    s, a = spark.createDataFrame(rows, "scene_id long, cx long, cy long"), spark.createDataFrame(sorted(area), "cx long, cy long")
    checkpoints, real = [], GR.cut_lineage
    monkeypatch.setattr(GR, "cut_lineage", lambda d: (checkpoints.append(1), real(d))[1])
    assert sorted(tuple(r) for r in GR.coverage_groups(s, a, 0.6).collect()) == sorted(want)
    assert len(checkpoints) < 12 + 3 * (1 + max(w[1] for w in want))
    monkeypatch.setattr(GR, "PIECE_CELLS", 0)
    assert sorted(tuple(r) for r in GR.coverage_groups(s, a, 0.6).collect()) == sorted(want)


def test_nearest_line_radius_counts_the_lengths_of_lines(spark, monkeypatch):
    """Long lines lie close everywhere: the first round does not pair a place with dozens of them."""
    from bermline.operators import cells as C

    lines = spark.range(50).selectExpr("id AS line_id", "array(struct(0.0D AS x, 20.0D * id AS y), struct(1000.0D AS x, 20.0D * id + 10 AS y)) AS pts")
    points = spark.range(40).selectExpr("id", "CAST(id * 25 AS DOUBLE) AS x", "CAST(id * 37 % 990 AS DOUBLE) AS y")
    pairs, real = [], C.point_line_pairs
    monkeypatch.setattr(C, "point_line_pairs", lambda *a: (pairs.append(real(*a).count()), real(*a))[1])
    got = {r["id"]: (r["line_id"], r["d"]) for r in C.nearest_line_join(points, lines).collect()}
    for k in range(40):
        x, y = 25.0 * k, 37.0 * k % 990
        best = min((abs(y - 20 * i - x / 100) / (1 + 1e-4) ** 0.5, i) for i in range(50))
        assert got[k][0] == best[1] and abs(got[k][1] - best[0]) < 1e-9
    assert pairs[0] <= 40 * 6
