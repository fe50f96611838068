"""Leakage-free splits and repeatable samples.

Every draw orders rows by a uniform hash of their key (or by a caller's column
``u``) and takes the rows below a rank. The rank comes from equal-width hash
buckets, so a class that holds most of the rows is not gathered in one task.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bermline.operators.cells import nearest_join, nearest_line_join, point_line_pairs, point_pairs
from bermline.operators.coverage import dissolve_runs, line_runs, run_cells
from bermline.operators.ordered import hashed_rank, row_numbers, running_totals, uniform_hash
from bermline.session import cut_lineage


def _ranked_groups(df: DataFrame, group: Sequence[str], seed: int, u: Column | None) -> DataFrame:
    g = df.select(*group).dropna().distinct()
    g = g.withColumn("_u", uniform_hash(*group, seed=seed) if u is None else u)
    return hashed_rank(g, [], "_u", group, "_rank", "_total")


def group_split(df: DataFrame, group: Sequence[str], fractions: Sequence[tuple[str, float]] = (("train", 0.75), ("val", 0.25)),
                seed: int = 42, u: Column | None = None, out: str = "split", at_least_one: bool = False) -> DataFrame:
    """Split whole groups: the first floor(n*f) of the shuffled groups, and so on; the last part takes the rest.

    Rows without a complete group key drop out.
    """
    g = _ranked_groups(df, group, seed, u)
    cut, label = F.lit(0), F.lit(None).cast("string")
    rules = []
    for name, f in fractions[:-1]:
        size = F.floor(F.col("_total") * F.lit(float(f)))
        if at_least_one:
            size = F.greatest(F.lit(1), size)
        cut = cut + size
        rules.append((F.col("_rank") <= cut, name))
    label = F.lit(fractions[-1][0])
    for cond, name in reversed(rules):
        label = F.when(cond, name).otherwise(label)
    return df.join(g.select(*group, label.alias(out)), list(group))


def calibration_split(df: DataFrame, group: Sequence[str] = ("comid",), fraction: float = 0.30, seed: int = 42,
                      u: Column | None = None) -> DataFrame:
    """Calibration and report part, at least one calibration group."""
    return group_split(df, group, (("calib", fraction), ("report", 1 - fraction)), seed, u, at_least_one=True)


def with_block(pixels: DataFrame, block: int = 256) -> DataFrame:
    return pixels.withColumn("block_r", F.floor(F.col("row") / block)).withColumn("block_c", F.floor(F.col("col") / block))


def block_split(pixels: DataFrame, block: int = 256, test: float = 0.30, seed: int = 42, u: Column | None = None) -> DataFrame:
    """Whole square blocks to train or test; max(1, round(n*test)) test blocks."""
    p = with_block(pixels, block)
    g = _ranked_groups(p, ["block_r", "block_c"], seed, u)
    n_test = F.greatest(F.lit(1), F.bround(F.col("_total") * F.lit(float(test)), 0).cast("long"))
    g = g.select("block_r", "block_c", F.when(F.col("_rank") <= n_test, "test").otherwise("train").alias("split"))
    return p.join(g, ["block_r", "block_c"])


def balanced_sample(pixels: DataFrame, caps: dict[str, int], key: Sequence[str], by: str = "split", label: str = "label",
                    seed: int = 42, u: Column | None = None) -> DataFrame:
    """Up to ``caps[split]`` rows of each class per split, without replacement."""
    cap = F.lit(None).cast("long")
    for name, n in caps.items():
        cap = F.when(F.col(by) == name, F.lit(n)).otherwise(cap)
    d = pixels.withColumn("_u", uniform_hash(*key, seed=seed) if u is None else u)
    return hashed_rank(d, [by, label], "_u", key, "_rank", "_total").filter(F.col("_rank") <= cap).drop("_u", "_rank", "_total")


def prevalence_sample(pixels: DataFrame, max_pos: dict[str, int], key: Sequence[str], ratio: int = 50, by: str = "split",
                      label: str = "label", seed: int = 42, u: Column | None = None) -> DataFrame:
    """All positives up to a cap per split, and ``ratio`` negatives for each positive taken."""
    cap = F.lit(None).cast("long")
    for name, n in max_pos.items():
        cap = F.when(F.col(by) == name, F.lit(n)).otherwise(cap)
    d = pixels.withColumn("_u", uniform_hash(*key, seed=seed) if u is None else u)
    pos = d.groupBy(F.col(by).alias("_by")).agg(F.count_if(F.col(label) == 1).alias("_np"))
    r = hashed_rank(d, [by, label], "_u", key, "_rank", "_total").join(pos, F.col(by) == F.col("_by"))
    n_pos = F.least(cap, F.col("_np"))
    take = F.when(F.col(label) == 1, n_pos).otherwise(n_pos * ratio)
    return r.filter(F.col("_rank") <= take).drop("_u", "_rank", "_total", "_by", "_np")


def stratified_group_kfold(df: DataFrame, group: Sequence[str], label: str = "label", k: int = 5, out: str = "fold") -> DataFrame:
    """Folds of whole groups with similar class counts: groups ordered by positives and size are dealt out
    back and forth over the folds."""
    g = df.groupBy(*group).agg(F.count_if(F.col(label) == 1).alias("_p"), F.count(F.lit(1)).alias("_n"))
    g = row_numbers(g.withColumn("_o", -F.col("_p")).withColumn("_m", -F.col("_n")), [], ["_o", "_m", *group], "_rn")
    pos = (F.col("_rn") - 1) % (2 * k)
    fold = F.when(pos < k, pos).otherwise(2 * k - 1 - pos)
    return df.join(g.select(*group, fold.alias(out)), list(group))


def label_weights(pixels: DataFrame, outer: DataFrame, core: DataFrame, weights: Sequence[float] = (1.0, 0.3, 1.0)) -> DataFrame:
    """label and weight per pixel from the outer and core line masks (row, col): core, rim and negative weight."""
    o = outer.select("row", "col", F.lit(True).alias("_o"))
    c = core.select("row", "col", F.lit(True).alias("_c"))
    d = pixels.join(o, ["row", "col"], "left").join(c, ["row", "col"], "left")
    w = F.when(F.col("_c"), weights[0]).when(F.col("_o"), weights[1]).otherwise(weights[2])
    return d.withColumn("label", F.when(F.col("_o"), 1).otherwise(0)).withColumn("weight", w.cast("double")).drop("_o", "_c")


def corridor_negatives(reaches: DataFrame, lines: DataFrame, n: int, buffer: float = 500.0, exclude: float = 100.0,
                       tries: int = 40, seed: int = 42, basins: DataFrame | None = None) -> DataFrame:
    """n uniform points near the reaches and away from the lines, with nearest reach and basin.

    Reaches are lines (``comid, pts``) or, without a column ``pts``, points (``comid, x, y``). Candidates are drawn from
    the cells that the buffered reaches touch, all cells alike, and kept where the exact distances allow; so the draw is
    uniform over the corridor and hardly any candidate is wasted on land far from it. Rounds of more candidates follow
    while too few are left.

    Fewer rows than n come back when n*tries candidates do not yield enough: the shortfall shows.
    """
    as_lines = "pts" in reaches.columns
    shapes = reaches.select("pts") if as_lines else reaches.select(F.array(F.struct("x", "y"), F.struct("x", "y")).alias("pts"))
    size = buffer / 8
    # every cell the buffer touches: half a diagonal is under a cell; each round draws from the runs
    runs = cut_lineage(corridor_runs(shapes, buffer + size, size))
    places = reaches.select("x", "y").distinct() if not as_lines else None
    drawn, kept = 0, None
    while drawn < n * tries and (kept is None or kept.count() < n):
        more = min(max(2 * n, 4 * drawn), n * tries - drawn)
        c = cells_of_runs(runs, drawn, drawn + more, seed).select(
            "cand", ((F.col("col") + uniform_hash("cand", seed=seed + 1)) * size).alias("x"), ((F.col("row") + uniform_hash("cand", seed=seed + 2)) * size).alias("y"))
        met = point_line_pairs(c, shapes, buffer, []) if as_lines else point_pairs(c, places, buffer)
        near = met.select(F.col("cand").alias("_id")).distinct()
        c = c.join(near, F.col("cand") == F.col("_id"), "left_semi")
        close = point_line_pairs(c, lines.select("pts"), exclude, []).select(F.col("cand").alias("_id")).distinct()
        c = c.join(close, F.col("cand") == F.col("_id"), "left_anti")
        kept = cut_lineage(c if kept is None else kept.unionByName(c))
        drawn += more
    c = row_numbers(kept, [], ["cand"], "_rn").filter(F.col("_rn") <= n)
    c = c.withColumn("patch_id", F.format_string("neg_%07d", F.col("_rn") - 1)).withColumn("patch_type", F.lit("negative")).drop("_rn")
    c = (nearest_line_join(c, reaches.select("comid", "pts"), "comid", buffer) if as_lines else nearest_join(c, reaches.select("x", "y", "comid"), "comid", buffer)).drop("d")
    return c if basins is None else c.join(basins.select("comid", "basin_id"), "comid", "left")


def paired_negatives(positives: DataFrame, lines: DataFrame, exclude: float = 100.0, r_max: float = 5000.0, tries: int = 50,
                     seed: int = 42) -> DataFrame:
    """One point per positive at a random angle and 0.3-1.0 of r_max, away from lines of its category; the first
    valid try wins. positives: patch_id, category, comid, uparea, x, y; lines: category, pts."""
    t = positives.select(F.col("patch_id").alias("source_positive_id"), F.col("category").alias("_cat"), "comid", "uparea",
                         F.col("x").alias("_x"), F.col("y").alias("_y"), F.explode(F.sequence(F.lit(0), F.lit(tries - 1))).alias("try"))
    ang = uniform_hash("source_positive_id", "try", seed=seed) * 6.283185307179586
    rad = r_max * (0.3 + 0.7 * uniform_hash("source_positive_id", "try", seed=seed + 1))
    t = t.withColumn("x", F.col("_x") + rad * F.cos(ang)).withColumn("y", F.col("_y") + rad * F.sin(ang)).drop("_x", "_y")
    hit = point_line_pairs(t, lines.select("category", "pts"), exclude, ["category"]).filter(F.col("category") == F.col("_cat"))
    bad = hit.select(F.col("source_positive_id").alias("_id"), F.col("try").alias("_t")).distinct()
    ok = t.join(bad, (F.col("source_positive_id") == F.col("_id")) & (F.col("try") == F.col("_t")), "left_anti")
    best = ok.groupBy("source_positive_id").agg(F.min_by(F.struct("_cat", "comid", "uparea", "x", "y", "try"), "try").alias("_m"))
    return best.select("source_positive_id", F.col("_m._cat").alias("category"), *[F.col(f"_m.{c}").alias(c) for c in ("comid", "uparea", "x", "y", "try")],
                       F.lit("negative").alias("patch_type"))


def sample_pixels(patches: DataFrame, max_patches: int = 300, per_patch: int = 4096, key: str = "patch_id", arr: str = "value",
                  seed: int = 42, u: Column | None = None) -> DataFrame:
    """Some patches, and some pixels of each: ``key, i, value``. The draw inside a patch happens in its row."""
    d = patches.withColumn("_u", uniform_hash(key, seed=seed) if u is None else u)
    d = hashed_rank(d, [], "_u", [key], "_rank", "_total").filter(F.col("_rank") <= max_patches)
    tagged = F.transform(F.col(arr), lambda v, i: F.struct(F.xxhash64(F.col(key), i, F.lit(seed)).alias("h"), i.alias("i"), v.alias("v")))
    picked = F.slice(F.array_sort(tagged), 1, per_patch)
    return d.select(key, F.explode(picked).alias("_p")).select(key, F.col("_p.i").alias("i"), F.col("_p.v").alias("value"))


def patch_centres(pixels: DataFrame, nrows: int, ncols: int, size: int, n: int, pos_ratio: float = 0.5, seed: int = 42) -> DataFrame:
    """Training patch centres away from the border: a share on positive pixels (with replacement only when they are
    too few), the rest anywhere."""
    half = size // 2
    r0, r1, c0, c1 = half, nrows - half - 1, half, ncols - half - 1
    pos = pixels.filter((F.col("label") == 1) & (F.col("row") >= r0) & (F.col("row") < r1) & (F.col("col") >= c0) & (F.col("col") < c1))
    pos = hashed_rank(pos.select("row", "col").withColumn("_u", uniform_hash("row", "col", seed=seed)), [], "_u", ["row", "col"], "_rank", "_total")
    n_pos = int(n * pos_ratio)
    spark = pixels.sparkSession
    total = pos.count()
    draws = spark.range(n_pos).withColumn("_pick", (F.col("id") + 1) if total >= n_pos else F.floor(uniform_hash("id", seed=seed + 2) * total) + 1)
    a = draws.join(pos, F.col("_pick") == F.col("_rank")).select("row", "col", F.lit("positive").alias("kind"))
    b = spark.range(n - n_pos).select((r0 + F.floor(uniform_hash("id", seed=seed + 3) * (r1 - r0))).alias("row"),
                                      (c0 + F.floor(uniform_hash("id", seed=seed + 4) * (c1 - c0))).alias("col"), F.lit("any").alias("kind"))
    return a.unionByName(b)


def keep_basins(df: DataFrame, basins: Sequence[int] | None = None, min_uparea: float = 2000.0) -> DataFrame:
    d = df.filter((F.col("uparea") >= min_uparea) & F.col("basin_id").isNotNull())
    return d if basins is None else d.filter(F.col("basin_id").isin(list(basins)))


def first_n_matching(df: DataFrame, predicate: Column, n: int, key: Sequence[str], seed: int = 42, u: Column | None = None) -> DataFrame:
    """The first n rows, in hash order, that satisfy a predicate; an error when there are fewer."""
    d = df.filter(predicate).withColumn("_u", uniform_hash(*key, seed=seed) if u is None else u)
    d = hashed_rank(d, [], "_u", key, "_rank", "_total")
    checked = F.when(F.col("_total") >= n, F.col("_rank")).otherwise(F.raise_error(F.lit(f"fewer than {n} matching rows")).cast("long"))
    return d.filter(checked <= n).drop("_u", "_rank", "_total")


def remaining_groups(all_groups: DataFrame, *taken: DataFrame, keys: Sequence[str] = ("group",)) -> DataFrame:
    out = all_groups.select(*keys).distinct()
    for t in taken:
        out = out.join(t.select(*keys), list(keys), "left_anti")
    return out


def corridor(reaches: DataFrame, min_uparea: float = 2000.0, basins: Sequence[int] | None = None) -> DataFrame:
    """Large reaches (optionally of some basins); the buffer is applied as a distance by the joins."""
    d = reaches.filter(F.col("uparea") >= min_uparea)
    d = d if basins is None else d.filter(F.col("basin_id").isin(list(basins)))
    if d.isEmpty():
        raise ValueError("no reaches in corridor (check threshold and basins)")
    return d


def corridor_runs(lines: DataFrame, buffer: float, size: float) -> DataFrame:
    """The dissolved corridor: merged runs (``row, c0, c1``) of the cells whose centre comes within ``buffer`` of a line."""
    return line_runs(lines.select("pts"), buffer, size)


def corridor_pieces(lines: DataFrame, buffer: float, size: float) -> DataFrame:
    """Connected pieces of the corridor: ``piece, n_cells, area``, the rows they span and their columns."""
    d = dissolve_runs(corridor_runs(lines, buffer, size))
    n = F.sum(run_cells(d)).alias("n_cells")
    return d.groupBy("piece").agg(n, (F.sum(run_cells(d)) * (size * size)).alias("area"), F.min("row").alias("row0"), F.max("row").alias("row1"),
                                  F.min("c0").alias("c0"), F.max("c1").alias("c1"))


def cells_of_runs(runs: DataFrame, first: int, last: int, seed: int = 42) -> DataFrame:
    """Candidates ``cand`` from ``first`` to ``last`` with a cell ``row, col`` each, drawn evenly from all cells of the runs.

    Runs get their place in a prefix sum of cells; a candidate's draw is looked up by blocks of that sum.
    """
    n = run_cells(runs)
    r = cut_lineage(running_totals(runs.withColumn("_n", n), [], ["row", "c0"], {"_end": "_n"}))
    total = r.agg(F.max("_end")).first()[0] or 0
    spark = runs.sparkSession
    block = max(1, total // 65536)  # a run of many blocks has a row for each of them
    r = r.withColumn("_start", F.col("_end") - F.col("_n"))
    r = r.withColumn("_b", F.explode(F.sequence(F.floor(F.col("_start") / block), F.floor((F.col("_end") - 1) / block))))
    pick = spark.range(first, last if total else first).select(F.col("id").alias("cand"), F.floor(uniform_hash("id", seed=seed) * total).alias("_at"))
    pick = pick.withColumn("_b", F.floor(F.col("_at") / block))
    met = pick.join(r.select("row", "c0", "_start", "_end", "_b"), "_b").filter("_start <= _at AND _at < _end")
    return met.select("cand", "row", (F.col("c0") + F.col("_at") - F.col("_start")).alias("col"))
