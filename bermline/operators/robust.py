"""Robust statistics, grid statistics, height fallback and data-set reports."""
from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bermline.operators.ordered import null_safe_join, quantiles, running_totals


def robust_block(df: DataFrame, col: str, by: Sequence[str] = (), extra=()) -> DataFrame:
    """n, median, mean absolute value, p20 and p80 over non-null values; NULL statistics when empty."""
    q = quantiles(df, by, col, (0.2, 0.5, 0.8), extra=[F.avg(F.abs(F.col(col))).alias("mae"), *extra])
    return q.select(*[c for c in q.columns if c != "q"], F.col("q")[0].alias("p20"), F.col("q")[1].alias("median"),
                    F.col("q")[2].alias("p80"))


def robust_by_method(df: DataFrame, col: str, method: str = "method", length: str = "length_m") -> DataFrame:
    return robust_block(df, col, (method,), [(F.sum(length) / 1000).alias("length_km")])


def grid_stats(df: DataFrame, col: str, size: float = 10000.0, min_n: int = 100, x: str = "x", y: str = "y") -> DataFrame:
    """Median per square cell, cells with at least ``min_n`` values. Cells are keyed by (gx, gy)."""
    d = df.withColumn("gx", F.floor(F.col(x) / size)).withColumn("gy", F.floor(F.col(y) / size))
    q = quantiles(d, ("gx", "gy"), col, (0.5,)).filter(F.col("n") >= min_n)
    return q.select("gx", "gy", "n", F.col("q")[0].alias("median"),
                    ((F.col("gx") + 0.5) * size).alias("x_m"), ((F.col("gy") + 0.5) * size).alias("y_m"))


def datum_offset(df: DataFrame, col: str, cells: DataFrame, size: float = 10000.0, min_n: int = 200) -> DataFrame:
    """Median offset inside the corridor cells (all cells when none), overall spread, shares near the median.

    ``cells`` holds the (gx, gy) of corridor cells. Fewer than ``min_n`` values raise an error.
    """
    d = df.filter(F.col(col).isNotNull()).withColumn("gx", F.floor(F.col("x") / size)).withColumn("gy", F.floor(F.col("y") / size))
    corr = d.join(cells.select("gx", "gy").distinct(), ["gx", "gy"], "left_semi")
    q_all = quantiles(d, (), col, (0.2, 0.5, 0.8), extra=[F.stddev_pop(col).alias("std")])
    q_all = q_all.select(F.col("n").alias("n_all"), "std", F.col("q")[0].alias("p20"), F.col("q")[1].alias("median_all"), F.col("q")[2].alias("p80"))
    q_cor = quantiles(corr, (), col, (0.5,)).select(F.col("n").alias("n_corridor"), F.col("q")[0].alias("_m"))
    near = d.select(F.col(col).alias("_v")).crossJoin(q_all.select("median_all")).agg(  # one row of totals
        F.avg(F.when(F.abs(F.col("_v") - F.col("median_all")) <= 0.2, 1.0).otherwise(0.0)).alias("share_02"),
        F.avg(F.when(F.abs(F.col("_v") - F.col("median_all")) <= 0.5, 1.0).otherwise(0.0)).alias("share_05"))
    out = q_all.crossJoin(q_cor).crossJoin(near)
    checked = F.when(F.col("n_all") >= min_n, F.coalesce("_m", "median_all")).otherwise(
        F.raise_error(F.lit(f"offset from fewer than {min_n} points")).cast("double"))
    return out.select(checked.alias("offset"), "median_all", "n_corridor", "n_all", "std", "p20", "p80", "share_02", "share_05")


def axis_cells(df: DataFrame, col: str, axis: DataFrame, corridor: float = 30000.0, size: float = 10000.0, min_n: int = 100) -> DataFrame:
    """Cells (gx, gy, n, median, x_m, y_m) with at least ``min_n`` values whose centre lies within ``corridor`` of the axis lines (``pts``)."""
    from bermline.operators.cells import point_line_pairs

    c = grid_stats(df, col, size, min_n)
    near = point_line_pairs(c.select("gx", "gy", F.col("x_m").alias("x"), F.col("y_m").alias("y")), axis.select("pts"), corridor, []).select("gx", "gy").distinct()
    return c.join(near, ["gx", "gy"], "left_semi")


def corridor_offset(df: DataFrame, col: str, axis: DataFrame, corridor: float = 30000.0, size: float = 10000.0, min_cell: int = 100, min_n: int = 200) -> DataFrame:
    """``datum_offset`` with the corridor of the axis: the median of the values in its well-filled cells."""
    return datum_offset(df, col, axis_cells(df, col, axis, corridor, size, min_cell), size, min_n)


def kruskal_terms(df: DataFrame, col: str, group: str) -> DataFrame:
    """H statistic with tie correction and degrees of freedom, computed on distinct values."""
    d = df.filter(F.col(col).isNotNull())
    per = d.groupBy(F.col(col).cast("double").alias("_v"), group).agg(F.count(F.lit(1)).alias("_c"))
    ties = per.groupBy("_v").agg(F.sum("_c").alias("_t"))
    ranked = running_totals(ties, [], ["_v"], {"_cum": "_t"})
    ranked = ranked.select("_v", "_t", (F.col("_cum") - (F.col("_t") - 1) / 2).alias("_avg"))
    g = per.join(ranked, "_v").groupBy(group).agg(F.sum(F.col("_c") * F.col("_avg")).alias("_r"), F.sum("_c").alias("_n"))
    s = g.agg(F.sum(F.col("_r") * F.col("_r") / F.col("_n")).alias("_s"), F.sum("_n").alias("n"), F.count(F.lit(1)).alias("k"))
    corr = ties.agg(F.sum(F.pow("_t", F.lit(3)) - F.col("_t")).alias("_tie"))
    n = F.col("n").cast("double")
    h = (12 / (n * (n + 1)) * F.col("_s") - 3 * (n + 1)) / (1 - F.col("_tie") / (n * n * n - n))
    return s.crossJoin(corr).select(h.alias("h"), (F.col("k") - 1).alias("dof"), "n")  # one row each


def _gamma_q(a: float, x: float) -> float:
    """Upper regularised incomplete gamma function (chi-square tail on one number)."""
    if x <= 0:
        return 1.0
    lead = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-15:
            k += 1
            term *= x / k
            total += term
        return 1.0 - total * lead
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 10000):
        an = -i * (i - a)
        b += 2
        d, c = 1 / (an * d + b), b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return lead * h


def kruskal(df: DataFrame, col: str, group: str) -> tuple[float, float]:
    """Kruskal-Wallis H and p-value."""
    r = kruskal_terms(df, col, group).first()
    return float(r["h"]), _gamma_q(r["dof"] / 2, r["h"] / 2)


def kruskal_table(df: DataFrame, col: str, group: str) -> DataFrame:
    """One row ``h, dof, n, p``: the Kruskal-Wallis test as a table."""
    r = kruskal_terms(df, col, group).first()
    p = _gamma_q(r["dof"] / 2, r["h"] / 2) if r["h"] is not None and r["dof"] else None
    return df.sparkSession.createDataFrame([(r["h"], r["dof"], r["n"], p)], "h double, dof long, n long, p double")


def _beta_share(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return min(max(x, 0.0), 1.0)
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _beta_share(1 - x, b, a)
    lead = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    f = d
    for m in range(1, 10000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + num * d), 1 + num / c
            f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return lead * f


def student_p(t: float, dof: float) -> float:
    """Two-sided p-value of Student's t."""
    return _beta_share(dof / (dof + t * t), dof / 2, 0.5)


def trend_sums(cells: DataFrame, value: str = "median", weight: str = "n") -> DataFrame:
    """Weighted normal-equation sums of value ~ 1 + x + y (coordinates per 100 km)."""
    x, y, v, w = F.col("x_m") / 1e5, F.col("y_m") / 1e5, F.col(value), F.col(weight)
    s = lambda e, name: F.sum(w * e).alias(name)
    return cells.agg(F.count(F.lit(1)).alias("k"), F.sum(w).alias("s1"), s(x, "sx"), s(y, "sy"), s(x * x, "sxx"),
                     s(x * y, "sxy"), s(y * y, "syy"), s(v, "sv"), s(x * v, "sxv"), s(y * v, "syv"), s(v * v, "svv"))


def weighted_trend(cells: DataFrame, value: str = "median", weight: str = "n") -> dict[str, list[float]]:
    """Coefficients, standard errors and t-values; a 3x3 solve on one aggregated row."""
    import numpy as np

    r = trend_sums(cells, value, weight).first()
    a = np.array([[r.s1, r.sx, r.sy], [r.sx, r.sxx, r.sxy], [r.sy, r.sxy, r.syy]])
    b = np.array([r.sv, r.sxv, r.syv])
    coef = np.linalg.solve(a, b)
    dof = r.k - 3
    rss = max(r.svv - float(coef @ b), 0.0)
    se = np.sqrt(np.diag(np.linalg.inv(a)) * rss / dof) if dof > 0 else np.full(3, np.nan)
    return {"coef": coef.tolist(), "se": se.tolist(), "t": (coef / se).tolist(), "p": [student_p(float(t), dof) if dof > 0 else math.nan for t in coef / se]}


def trend_table(cells: DataFrame, value: str = "median", weight: str = "n") -> DataFrame:
    """The weighted trend as rows ``term, coef, se, t, p`` (constant, east and north per 100 km)."""
    r = weighted_trend(cells, value, weight)
    rows = [(name, *(float(r[k][i]) for k in ("coef", "se", "t", "p"))) for i, name in enumerate(("constant", "east", "north"))]
    return cells.sparkSession.createDataFrame(rows, "term string, coef double, se double, t double, p double")


def resolve_heights(segments: DataFrame, points: DataFrame, dz_default: float = 0.9, min_seg: int = 3,
                    min_levee: int = 3, pct: float = 0.20) -> DataFrame:
    """Three-level height fallback: measured per segment, offset per levee, default offset.

    segments: segment_id, levee_id, dsm_med, ...; points: segment_id, levee_id, h, dz.
    """
    seg_h = quantiles(points, ("segment_id",), "h", (0.5, pct)).select(
        "segment_id", F.col("n").alias("_n"), F.col("q")[0].alias("_h"), F.col("q")[1].alias("_hc"))
    seg_dz = quantiles(points, ("segment_id",), "dz", (0.5,)).select("segment_id", F.col("q")[0].alias("_dz"))
    lev = quantiles(points, ("levee_id",), "dz", (0.5, pct)).select(
        "levee_id", F.col("n").alias("_ln"), F.col("q")[0].alias("_ldz"), F.col("q")[1].alias("_ldc"))
    d = segments.join(seg_h, "segment_id", "left").join(seg_dz, "segment_id", "left").join(lev, "levee_id", "left")
    measured, levee = F.coalesce("_n", F.lit(0)) >= min_seg, F.coalesce("_ln", F.lit(0)) >= min_levee
    dsm = F.col("dsm_med")
    return (d.withColumn("n_pts", F.coalesce("_n", F.lit(0)))
            .withColumn("method", F.when(measured, "z_measured").when(levee, "dz_levee").otherwise("dz_default"))
            .withColumn("dz_used", F.when(measured, F.col("_dz")).when(levee, F.col("_ldz")).otherwise(F.lit(dz_default)))
            .withColumn("z", F.when(measured, F.col("_h")).when(levee, dsm + F.col("_ldz")).otherwise(dsm + dz_default))
            .withColumn("z_cons", F.when(measured, F.col("_hc")).when(levee, dsm + F.col("_ldc")).otherwise(dsm + dz_default))
            .drop("_n", "_h", "_hc", "_dz", "_ln", "_ldz", "_ldc"))


def length_share(segments: DataFrame, by: str = "method", length: str = "length_m") -> DataFrame:
    """Share of length per method in percent, one decimal."""
    s = segments.groupBy(by).agg(F.sum(length).alias("_l"))
    total = segments.agg(F.sum(length).alias("_t"))
    return s.crossJoin(total).select(by, F.round(F.col("_l") / F.col("_t") * 100, 1).alias("percent_length"))  # one row of totals


def removal_reasons(points: DataFrame, dz_min: float = -0.3, dz_max: float = 8.0, canopy_max: float | None = 2.0) -> DataFrame:
    """Add ``reason``: vegetation before structure before below_dsm, else kept. ``canopy_max=None``: no canopy rule."""
    c = F.when(F.col("canopy") > canopy_max, "vegetation") if canopy_max is not None else F.when(F.lit(False), "vegetation")
    return points.withColumn("reason", c.when(F.col("dz") > dz_max, "structure").when(F.col("dz") < dz_min, "below_dsm").otherwise("kept"))


def channel_stats(pixels: DataFrame, exclude: Sequence[str] = ("dsm", "water")) -> DataFrame:
    """Mean and population deviation per channel (missing as 0, variance floor 1e-12); excluded channels get 0 and 1.

    pixels: channel, value.
    """
    v = F.coalesce(F.nanvl(F.col("value"), F.lit(0.0)), F.lit(0.0))
    s = pixels.groupBy("channel").agg(F.sum(v).alias("_s"), F.sum(v * v).alias("_q"), F.count(F.lit(1)).alias("_n"))
    mean = F.col("_s") / F.col("_n")
    std = F.sqrt(F.greatest(F.col("_q") / F.col("_n") - mean * mean, F.lit(1e-12)))
    skip = F.col("channel").isin(*exclude)
    return s.select("channel", F.when(skip, 0.0).otherwise(mean).alias("mean"), F.when(skip, 1.0).otherwise(std).alias("std"))


def pixel_stack_stats(pixels: DataFrame, keys: Sequence[str] = ("row", "col")) -> DataFrame:
    """Mean, population deviation and count per pixel over scenes; NULL where no scene is valid."""
    return pixels.groupBy(*keys).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count("value").alias("n"))


def partial_moments(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Count, mean and sum of squared deviations per key, ready to merge."""
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"),
                                 (F.var_pop(value) * F.count(value)).alias("m2"))


def merge_moments(partials: DataFrame, by: Sequence[str] = (), std_floor: float = 1e-6) -> DataFrame:
    """Combine partial moments of disjoint parts."""
    s = partials.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("mean")).alias("_s"),
                                  F.sum(F.col("m2") + F.col("n") * F.col("mean") * F.col("mean")).alias("_q"))
    mean = F.col("_s") / F.col("n")
    var = F.greatest(F.col("_q") / F.col("n") - mean * mean, F.lit(0.0))
    return s.select(*by, "n", mean.alias("mean"), F.greatest(F.sqrt(var), F.lit(std_floor)).alias("std"))


def domain_shift(a: DataFrame, b: DataFrame, n_q: int = 200) -> DataFrame:
    """Per channel: statistics of two domains, standardised mean difference and quantile-matched Wasserstein-1.

    a, b: channel, value.
    """
    qs = [0.005 + 0.99 * k / (n_q - 1) for k in range(n_q)]
    fixed = (0.02, 0.5, 0.98)

    def side(df: DataFrame, tag: str) -> DataFrame:
        q = quantiles(df, ("channel",), "value", (*fixed, *qs), extra=[F.avg("value").alias("_m"), F.stddev_pop("value").alias("_sd")])
        return q.select("channel", F.col("_m").alias(f"mean_{tag}"), F.col("_sd").alias(f"std_{tag}"), F.col("q")[0].alias(f"p2_{tag}"),
                        F.col("q")[1].alias(f"median_{tag}"), F.col("q")[2].alias(f"p98_{tag}"), F.slice("q", 4, n_q).alias(f"_q{tag}"))

    d = side(a, "a").join(side(b, "b"), "channel")
    w1 = F.aggregate(F.zip_with("_qa", "_qb", lambda u, v: F.abs(u - v)), F.lit(0.0), lambda s, e: s + e) / n_q
    sd = F.when(F.col("std_a") > 1e-9, F.col("std_a")).otherwise(F.lit(1e-9))
    d = d.withColumn("w1", w1)
    return d.withColumn("smd", (F.col("mean_b") - F.col("mean_a")) / sd).withColumn("w1_rel", F.col("w1") / sd).drop("_qa", "_qb")


def inventory(df: DataFrame, columns: Sequence[str], max_unique: int = 40, cross: str = "patch_type") -> DataFrame:
    """Value counts of low-cardinality columns and their cross-tab with ``cross`` (zero-filled).

    One pass: each row becomes one (column, value) pair per column, counted with map-side combine.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns])
    long = df.select(F.col(cross).cast("string").alias("_x"), F.inline(pairs))
    counts = long.groupBy("column_name", "value", "_x").agg(F.count(F.lit(1)).alias("n"))
    low = counts.groupBy("column_name").agg(F.count_distinct("value").alias("_u")).filter(F.col("_u") <= max_unique).select("column_name")
    counts = counts.join(low, "column_name")
    alone = counts.groupBy("column_name", "value").agg(F.sum("n").alias("n")).withColumn("patch_type", F.lit(""))
    types = counts.filter(F.col("_x").isNotNull()).select("_x").distinct()
    grid = alone.filter(F.col("column_name") != cross).select("column_name", "value").crossJoin(types)  # <= 40 x 40 per column
    tab = null_safe_join(grid, counts, ["column_name", "value", "_x"], "left")
    tab = tab.select("column_name", "value", F.coalesce("n", F.lit(0)).alias("n"), F.col("_x").alias("patch_type"))
    return alone.unionByName(tab)


def split_counts(df: DataFrame, split: str = "split", by: Sequence[str] = ("region", "patch_type")) -> DataFrame:
    """Counts per split, per split x each attribute, and in full."""
    cols = [split, *by]
    sets = [[split], *[[split, c] for c in by], cols]
    g = df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in cols])
    return g.agg(F.grouping_id(*cols).cast("long").alias("level"), F.count(F.lit(1)).alias("n"))


def binned_median(df: DataFrame, x: str, y: str, width: float = 0.25, min_n: int = 15) -> DataFrame:
    """Median of y per bin of x, bins with at least ``min_n`` rows."""
    d = df.filter(F.col(x).isNotNull()).withColumn("bin", F.floor(F.col(x) / width))
    q = quantiles(d, ("bin",), y, (0.5,)).filter(F.col("n") >= min_n)
    return q.select(((F.col("bin") + 0.5) * width).alias("mid"), "n", F.col("q")[0].alias("median"))


def prominence_sweep(candidates: DataFrame, thresholds: Sequence[float], cap: float = 8.0, prom: str = "prom", diff: str = "diff") -> DataFrame:
    """Per threshold: number of candidates with threshold <= prom <= cap, and the robust block of their differences."""
    ts = F.array(*[F.lit(float(t)) for t in thresholds])
    d = candidates.filter(F.col(prom) <= cap)
    # a row is copied once per threshold it passes (a short literal list)
    d = d.select(F.explode(F.filter(ts, lambda t: t <= F.col(prom))).alias("threshold"), F.col(diff).alias("_d"))
    return robust_block(d, "_d", ("threshold",), [F.count(F.lit(1)).alias("n_selected")])


def threshold_flags(candidates: DataFrame, thresholds: Sequence[float], cap: float = 8.0, prom: str = "prom") -> DataFrame:
    """One boolean column ``sel_###`` per threshold."""
    return candidates.withColumns({
        f"sel_{round(t * 100):03d}": F.coalesce(F.col(prom).between(float(t), cap), F.lit(False)) for t in thresholds})


def height_summary(points: DataFrame, col: str = "h_te_ortho", by: Sequence[str] = ()) -> DataFrame:
    return points.groupBy(*by).agg(F.count(col).alias("n"), F.min(col).alias("h_min"), F.max(col).alias("h_max"),
                                   F.avg(col).alias("h_mean"), F.stddev_samp(col).alias("h_std"))


def key_coverage(df: DataFrame, key: str, id_col: str, sample: int = 5) -> DataFrame:
    """Rows with and without a key, and the first few ids without one (a report)."""
    counts = df.agg(F.count(F.lit(1)).alias("n_total"), F.count(key).alias("n_with"),
                    F.count_if(F.col(key).isNull()).alias("n_missing"))
    first = df.filter(F.col(key).isNull()).select(F.col(id_col).alias("_i")).orderBy("_i").limit(sample)
    ids = first.agg(F.array_join(F.sort_array(F.collect_list("_i")), ",").alias("sample_ids"))
    return counts.crossJoin(ids)  # one row each


def basin_report(segments: DataFrame, reaches: DataFrame, basins: DataFrame, min_uparea: float = 2000.0) -> DataFrame:
    """Per basin: segments, large reaches, km of line and the outlet position, largest first.

    segments: basin_id, length_m; reaches: comid, uparea, x, y; basins: comid, basin_id.
    """
    seg = segments.groupBy("basin_id").agg(F.count(F.lit(1)).alias("n_positive_segments"),
                                           F.round(F.sum("length_m") / 1000.0, 1).alias("levee_length_km"))
    big = (reaches.filter(F.col("uparea") >= min_uparea).select("comid").join(basins, "comid")
           .groupBy("basin_id").agg(F.count(F.lit(1)).alias("n_reaches")))
    out = reaches.select(F.col("comid").alias("basin_id"), F.round("x", 1).alias("outlet_x"), F.round("y", 1).alias("outlet_y"))
    r = seg.join(big, "basin_id", "left").join(out, "basin_id", "left")
    r = r.withColumn("n_reaches_ge_thresh", F.coalesce("n_reaches", F.lit(0))).drop("n_reaches")
    return r.orderBy(F.desc("n_positive_segments"), "basin_id")
