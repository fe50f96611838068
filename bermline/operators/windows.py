"""Along-track and planar windows, hourly differences, chainage and running ids."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from bermline.operators.cells import point_pairs
from bermline.operators.ordered import (bucket_count, literal_table, order_splits, previous_values, quantiles, row_numbers,
                                        running_totals)
from bermline.session import cut_lineage


def along_track_distance(points: DataFrame, track: Sequence[str], order: Sequence[str], out: str = "d",
                         x: str = "x", y: str = "y") -> DataFrame:
    """Cumulative distance along each track; a track may be of any length."""
    splits = order_splits(points, order[0], bucket_count(points))
    p = previous_values(points, track, order, {"_px": x, "_py": y}, splits=splits)
    step = F.coalesce(F.hypot(F.col(x) - F.col("_px"), F.col(y) - F.col("_py")), F.lit(0.0))
    return running_totals(p.withColumn("_step", step), track, order, {out: "_step"}, splits=splits).drop("_px", "_py", "_step")


def array_median(arr: Column) -> Column:
    s = F.array_sort(arr)
    n = F.size(arr)
    return (F.element_at(s, F.floor((n - 1) / 2).cast("int") + 1) + F.element_at(s, F.ceil((n - 1) / 2).cast("int") + 1)) / 2


def along_track_prominence(points: DataFrame, track: Sequence[str] = ("track",), d: str = "d", h: str = "h",
                           r_in: float = 40.0, r_out: float = 300.0, min_n: int = 4, near: str | None = None) -> DataFrame:
    """Add ``prominence`` = height minus the median of neighbours with r_in <= |distance| <= r_out.

    Every row is returned; ``prominence`` is NULL with fewer than ``min_n`` neighbours or where ``near`` is false, and a
    row without a distance is nobody's neighbour and has none. A neighbour without a height doesn't count. Tracks
    are cut into pieces of length r_out; each row is also copied to the two
    neighbouring pieces, so a frame never needs a whole track in one task.
    """
    own = F.floor(F.col(d) / r_out)
    nowhere = points.filter(F.col(d).isNull()).withColumn("n_neighbours", F.lit(0).cast("long")).withColumn("prominence", F.lit(None).cast("double"))
    p = points.filter(F.col(d).isNotNull()).withColumn("_piece", F.explode(F.array(own - 1, own, own + 1))).withColumn("_own", F.col("_piece") == own)
    keys = ", ".join([*track, "_piece"])
    frame = f"OVER (PARTITION BY {keys} ORDER BY {d} RANGE BETWEEN {{}} AND {{}})"
    before = F.expr(f"collect_list({h}) " + frame.format(f"{float(r_out)}D PRECEDING", f"{float(r_in)}D PRECEDING"))
    after = F.expr(f"collect_list({h}) " + frame.format(f"{float(r_in)}D FOLLOWING", f"{float(r_out)}D FOLLOWING"))
    # pieces that hold no own row are not needed
    p = p.withColumn("_nb", F.concat(before, after)).filter("_own")
    ok = F.size("_nb") >= min_n
    if near:
        ok = ok & F.col(near)
    p = (p.withColumn("n_neighbours", F.size("_nb").cast("long"))
         .withColumn("prominence", F.when(ok, F.col(h) - array_median(F.col("_nb"))).cast("double")).drop("_nb", "_piece", "_own"))
    return p.unionByName(nowhere)


def planar_prominence(candidates: DataFrame, refs: DataFrame, h: str = "h", r_in: float = 50.0, r_out: float = 200.0,
                      min_n: int = 10, cap: float | None = 8.0) -> DataFrame:
    """Add ``prominence`` = height minus the median reference height in the ring, and ``n_ref``.

    Equal references are merged with a weight and equal candidate positions are
    searched once, so copies do not multiply. Values above ``cap`` become NULL.
    """
    r = refs.groupBy("x", "y", F.col(h).alias("_rh")).agg(F.count(F.lit(1)).alias("_w"))
    pairs = point_pairs(candidates.select("x", "y").distinct(), r, r_out, r_in)
    ring = pairs.groupBy("x", "y").agg(F.percentile("_rh", 0.5, F.col("_w")).alias("_med"), F.sum("_w").alias("_n"))
    out = candidates.join(ring, ["x", "y"], "left")
    prom = F.when(F.col("_n") >= min_n, F.col(h) - F.col("_med"))
    if cap is not None:
        prom = F.when(prom <= cap, prom)
    return out.withColumn("n_ref", F.coalesce("_n", F.lit(0))).withColumn("prominence", prom).drop("_med", "_n")


def best_row(df: DataFrame, keys: Sequence[str], order: Sequence[str], descending: bool = True) -> DataFrame:
    """One row per key, the best by ``order`` (name a unique last column for ties)."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if descending else F.min_by
    b = df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("_m"))
    return b.select(*keys, *[F.col(f"_m.{c}").alias(c) for c in rest])


def hourly_volume_change(series: DataFrame, inflow: DataFrame | None = None) -> DataFrame:
    """Add dV_dt_m3s and dV_dt_pct_inflow per run; a run has one row per simulated hour."""
    w = W.partitionBy("run").orderBy("hour")
    d = series.withColumn("dV_dt_m3s", (F.col("volume_mil_m3") - F.lag("volume_mil_m3").over(w)) * 1e6 / 3600.0)
    if inflow is None:
        return d.withColumn("dV_dt_pct_inflow", F.lit(None).cast("double"))
    return d.join(inflow.select("run", "q_in"), "run", "left").withColumn(
        "dV_dt_pct_inflow", F.col("dV_dt_m3s") / F.nullif(F.col("q_in"), F.lit(0.0)) * 100).drop("q_in")


def hourly_level_change(cells: DataFrame, min_depth: float = 0.05, keys: Sequence[str] = ("row", "col")) -> DataFrame:
    """Median and maximum |level change| per run and hour over cells wet (> min_depth) in either hour."""
    w = W.partitionBy("run", *keys).orderBy("hour")  # one cell: one row per hour
    d = cells.withColumn("_p", F.lag("zs").over(w))
    wet = (F.col("zs") - F.col("zb") > min_depth) | (F.col("_p") - F.col("zb") > min_depth)
    d = d.filter(F.col("_p").isNotNull() & wet).select("run", "hour", F.abs(F.col("zs") - F.col("_p")).alias("_dz"))
    d = cut_lineage(d)  # the quantiles read it more than once; the lag over all cells is done once
    q = quantiles(d, ("run", "hour"), "_dz", (0.5,), extra=[F.max("_dz").alias("dz_max_m")])
    return q.select("run", "hour", F.col("n").alias("n_cells"), F.col("q")[0].alias("dz_median_m"), "dz_max_m")


def steady_state(series: DataFrame, pct: float = 1.0, dz: float = 0.05) -> DataFrame:
    """Last hour per run with flags: |dV/dt| below ``pct`` percent of inflow, else level change below ``dz``."""
    last = best_row(series.select("run", "hour", "dz_max_m", "dV_dt_m3s", "dV_dt_pct_inflow"), ["run"], ["hour"])
    by_level = F.col("dz_max_m") < dz
    return (last.withColumn("steady", F.coalesce(F.abs("dV_dt_pct_inflow") < pct, by_level))
            .withColumn("steady_cellmax", by_level))


def level_drift(cells: DataFrame, frac: float = 0.75, keys: Sequence[str] = ("row", "col"), dz: float = 0.05) -> DataFrame:
    """|level at the end - level at ``frac`` of the run|: median, maximum and a steady flag per run."""
    n = cells.groupBy("run").agg(F.max("hour").alias("_last"))
    n, few = literal_table(n)
    # a shuffle by run would read all cells of a run in one task
    d = (cells.join(F.broadcast(n), "run") if few else cells.join(n, "run")).withColumn("_at", F.bround(F.col("_last") * F.lit(frac), 0).cast("long"))
    d = d.filter((F.col("hour") == F.col("_last")) | (F.col("hour") == F.col("_at")))
    d = d.groupBy("run", *keys).agg(F.abs(F.max(F.when(F.col("hour") == F.col("_last"), F.col("zs")))
                                          - F.max(F.when(F.col("hour") == F.col("_at"), F.col("zs")))).alias("_d"))
    d = cut_lineage(d.select("run", "_d"))  # the quantiles read it more than once
    q = quantiles(d, ("run",), "_d", (0.5,), extra=[F.max("_d").alias("drift_max")])
    return q.select("run", F.col("n").alias("n_cells"), F.col("q")[0].alias("drift_median"), "drift_max", (F.col("drift_max") < dz).alias("steady"))


def suffix_sum(df: DataFrame, order: Sequence[str], cols: dict[str, str], by: Sequence[str] = ()) -> DataFrame:
    """Sums from each row to the end of the order."""
    return running_totals(df, by, order, cols, descending=True)


def running_id(df: DataFrame, prefix: str, order: Sequence[str], width: int = 7, out: str = "patch_id") -> DataFrame:
    """Ids ``prefix0000000`` ... in the stated order (first order column numeric)."""
    return row_numbers(df, [], order, "_rn").withColumn(out, F.format_string(f"{prefix}%0{width}d", F.col("_rn") - 1)).drop("_rn")


def chainage(segments: DataFrame, line: str = "levee_id", order: Sequence[str] = ("k",), length: str = "length_m") -> DataFrame:
    """Start and end distance of each segment along its line."""
    d = running_totals(segments, [line], order, {"chain1": length})
    return d.withColumn("chain0", F.col("chain1") - F.col(length))


def profile_prominence(profile: Column, margin: int = 5) -> Column:
    """Height at the middle sample minus the lower of the two flank minima, ``margin`` samples left out on each side."""
    n = F.size(profile)
    mid = F.floor(n / 2).cast("int")
    left = F.when(mid > margin, F.array_min(F.slice(profile, F.lit(1), F.greatest(mid - margin, F.lit(0)))))
    right = F.when(mid + margin < n, F.array_min(F.slice(profile, mid + margin + 1, F.greatest(n - mid - margin, F.lit(0)))))
    return F.element_at(profile, mid + 1) - F.least(left, right)  # least skips a missing flank


def profile_visibility(profiles: DataFrame, margin: int = 5, marks: Sequence[float] = (1.0, 2.0, 3.0), col: str = "profile",
                       by: Sequence[str] = ()) -> DataFrame:
    """Median, mean, range and shares above the marks of profile prominences, and a verdict on the first mark."""
    d = profiles.withColumn("_p", profile_prominence(F.col(col), margin)).filter(F.col("_p").isNotNull())
    extra = [F.avg("_p").alias("mean"), F.min("_p").alias("lo"), F.max("_p").alias("hi")]
    extra += [F.avg(F.when(F.col("_p") > m, 1.0).otherwise(0.0)).alias(f"share_{k}") for k, m in enumerate(marks, 1)]
    q = quantiles(d, by, "_p", (0.5,), extra=extra)
    med = F.col("q")[0]
    return q.withColumn("median", med).withColumn("verdict", F.when(med > marks[0], "GO").otherwise("CONSIDER")).drop("q")
