"""Exact ordered computations that never put one whole group into one task.

A plain window ``PARTITION BY key ORDER BY t`` sends every row of a key to one
task. The helpers here cut the order into buckets first, work inside
(key, bucket) and carry bucket totals over, so a key that holds a third of all
rows is spread like any other:

* ``running_totals``  prefix sums (and, with a column of ones, row numbers)
* ``previous_values`` the value of the preceding row
* ``hashed_rank``     row number in a pseudo-random order
* ``quantiles``       exact interpolated quantiles
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

SKETCH_ACCURACY = 20_000     # rank error of percentile_approx is at most n / accuracy
BRACKET = 4 / SKETCH_ACCURACY  # half width, in rank share, of the exact search range: four times that error
SMALL_GROUP = 10_000         # groups up to this size are searched whole
MAX_LITERAL_GROUPS = 4_096   # group tables up to this many rows are broadcast


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` with NULL equal to NULL; the left key columns are kept."""
    keys = list(keys)
    renamed = right
    for k in keys:
        renamed = renamed.withColumnRenamed(k, f"_r_{k}")
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(renamed, cond, how).drop(*[f"_r_{k}" for k in keys])


def bucket_count(df: DataFrame, least: int = 16) -> int:
    """The first power of two from ``least`` on that reaches the shuffle width of the session."""
    want = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    n = least
    while n < want:
        n *= 2
    return n


def order_splits(df: DataFrame, col: str, buckets: int) -> list[float]:
    """Equal-depth split points of a numeric column (one bounded row of sketch output)."""
    probs = [k / buckets for k in range(1, buckets)]
    row = df.agg(F.percentile_approx(F.col(col).cast("double"), probs, max(SKETCH_ACCURACY, 8 * buckets))).first()
    return list(row[0]) if row and row[0] else []


def bucket_of(value: Column, splits: list[float]) -> Column:
    """Number of splits that are <= value: a binary search over a literal array."""
    if not splits:
        return F.lit(0)
    arr = F.array(*[F.lit(float(s)) for s in splits])
    step, steps = (len(splits) + 1) // 2, []
    while step >= 1:
        steps.append(F.lit(step))
        step //= 2
    v = value.cast("double")
    return F.aggregate(
        F.array(*steps), F.lit(0),
        lambda pos, s: F.when(F.element_at(arr, pos + s) <= v, pos + s).otherwise(pos),
    )


def _bucketed(df: DataFrame, order: Sequence[str], buckets: int | None, splits: list[float] | None = None) -> DataFrame:
    if splits is None:
        splits = order_splits(df, order[0], buckets or bucket_count(df))
    return df.withColumn("_b", bucket_of(F.col(order[0]), splits))


def _direction(cols: Sequence[str], descending: bool) -> list[Column]:
    return [F.col(c).desc() if descending else F.col(c).asc() for c in cols]


def running_totals(
    df: DataFrame, by: Sequence[str], order: Sequence[str], totals: dict[str, str],
    descending: bool = False, buckets: int | None = None, splits: list[float] | None = None,
) -> DataFrame:
    """Add prefix sums ``{out: column}`` within ``by`` along ``order``, the row included.

    The first order column must be numeric; the others break ties. ``splits``
    passes split points computed before, so that two calls share one sketch.
    """
    by = list(by)
    d = _bucketed(df, order, buckets, splits)
    inside = (W.partitionBy(*by, "_b").orderBy(*_direction(order, descending))
              .rowsBetween(W.unboundedPreceding, W.currentRow))
    before = (W.partitionBy(*by).orderBy(*_direction(["_b"], descending))
              .rowsBetween(W.unboundedPreceding, -1))
    offsets = d.groupBy(*by, "_b").agg(*[F.sum(c).alias(f"_t_{o}") for o, c in totals.items()])
    offsets = offsets.select(*by, "_b", *[
        F.coalesce(F.sum(f"_t_{o}").over(before), F.lit(0)).alias(f"_t_{o}") for o in totals])
    for o, c in totals.items():
        d = d.withColumn(o, F.coalesce(F.sum(c).over(inside), F.lit(0)))
    joined = null_safe_join(d, offsets, [*by, "_b"])
    for o in totals:
        joined = joined.withColumn(o, F.col(o) + F.col(f"_t_{o}"))
    return joined.drop("_b", *[f"_t_{o}" for o in totals])


def row_numbers(df: DataFrame, by: Sequence[str], order: Sequence[str], out: str = "rn",
                descending: bool = False, buckets: int | None = None) -> DataFrame:
    """1-based exact row number within ``by`` (all rows when empty)."""
    d = running_totals(df.withColumn("_one", F.lit(1).cast("long")), by, order, {out: "_one"},
                       descending, buckets)
    return d.drop("_one")


def previous_values(df: DataFrame, by: Sequence[str], order: Sequence[str], cols: dict[str, str],
                    buckets: int | None = None, splits: list[float] | None = None) -> DataFrame:
    """Add ``{out: column}`` holding the value of the preceding row within ``by``."""
    by = list(by)
    d = _bucketed(df, order, buckets, splits)
    inside = W.partitionBy(*by, "_b").orderBy(*order)
    last = d.groupBy(*by, "_b").agg(
        F.max_by(F.struct(*cols.values()), F.struct(*order)).alias("_last"))
    last = last.select(*by, "_b", F.lag("_last").over(W.partitionBy(*by).orderBy("_b")).alias("_prev"))
    d = d.withColumn("_rn", F.row_number().over(inside))
    for o, c in cols.items():
        d = d.withColumn(o, F.lag(c).over(inside))
    joined = null_safe_join(d, last, [*by, "_b"])
    for o, c in cols.items():
        joined = joined.withColumn(o, F.when(F.col("_rn") == 1, F.col("_prev")[c]).otherwise(F.col(o)))
    return joined.drop("_b", "_rn", "_prev")


def uniform_hash(*cols, seed: int = 42) -> Column:
    """A repeatable pseudo-random number in [0, 1) from the key columns."""
    return F.shiftrightunsigned(F.xxhash64(*cols, F.lit(seed)), 11) / F.lit(float(2 ** 53))


def hashed_rank(df: DataFrame, by: Sequence[str], u: str, tie: Sequence[str],
                out: str = "rank", total: str = "total", buckets: int | None = None) -> DataFrame:
    """Row number within ``by`` in the order of the uniform column ``u``, and the group size.

    ``u`` is uniform in [0, 1), so equal-width buckets are equally filled and
    even one dominant group is split ``buckets`` ways (by default 1,024, more
    when the session shuffles wider).
    """
    by, buckets = list(by), buckets or bucket_count(df, 1024)
    d = df.withColumn("_b", F.floor(F.col(u) * buckets))
    inside = W.partitionBy(*by, "_b").orderBy(u, *tie)
    sizes = d.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_n"))
    group = W.partitionBy(*by)
    sizes = sizes.select(
        *by, "_b",
        F.coalesce(F.sum("_n").over(group.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)),
                   F.lit(0)).alias("_before"),
        F.sum("_n").over(group).alias(total))
    d = d.withColumn("_rn", F.row_number().over(inside))
    return (null_safe_join(d, sizes, [*by, "_b"])
            .withColumn(out, F.col("_before") + F.col("_rn")).drop("_b", "_rn", "_before"))


def literal_table(df: DataFrame, limit: int = MAX_LITERAL_GROUPS) -> tuple[DataFrame, bool]:
    """Bring a table of at most ``limit`` rows to literals so that it may be broadcast.

    Returns ``(table, True)`` when the size check holds, else ``(df, False)``.
    """
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        return df, False
    return df.sparkSession.createDataFrame(rows, df.schema), True  # the rows of a checked, bounded table


def quantiles(df: DataFrame, by: Sequence[str], col: str, probs: Sequence[float], out: str = "q",
              extra: Sequence[Column] = (), bounded: bool = False) -> DataFrame:
    """Exact linear-interpolated quantiles per group: columns ``by, n, out ARRAY, extra...``.

    NULL values are skipped. Groups of at most SMALL_GROUP values (all groups
    when the caller states a structural limit with ``bounded=True``: one patch,
    one window) go through the built-in ``percentile``. Larger ones are found by
    a plain count and never gathered:

    1. a mergeable sketch per group gives a narrow value range around each rank;
    2. one aggregation with map-side combine counts what lies between the
       ranges and keeps only the distinct values inside them;
    3. the wanted ranks are read from the running counts of that small table.
    """
    by, probs = list(by), [float(p) for p in probs]
    data = df.withColumn("_v", F.col(col).cast("double"))

    def direct(d: DataFrame) -> DataFrame:
        arr = F.array(*[F.lit(p) for p in probs])
        return d.groupBy(*by).agg(F.count("_v").alias("n"), F.percentile("_v", arr).alias(out), *extra)

    if bounded:
        return direct(data)
    hot = data.groupBy(*by).agg(F.count("_v").alias("n")).filter(F.col("n") > SMALL_GROUP)
    hot, few = literal_table(hot)
    if few and hot.isEmpty():
        return direct(data)
    if not by:
        return _large_quantiles(data, by, probs, out, extra, few)
    marks = F.broadcast(hot.select(*by)) if few else hot.select(*by)
    small = null_safe_join(data, marks, by, "left_anti")
    large = null_safe_join(data, marks, by, "left_semi")
    return direct(small).unionByName(_large_quantiles(large, by, probs, out, extra, few))


def _large_quantiles(data: DataFrame, by: list[str], probs: list[float], out: str, extra: Sequence[Column],
                     few: bool) -> DataFrame:
    """Quantiles of groups of any size over column ``_v``; ``few``: the number of groups was checked to be small."""
    order = sorted(set(probs))
    edges = [e for p in order for e in (max(p - BRACKET, 0.0), min(p + BRACKET, 1.0))]
    sketch = data.groupBy(*by).agg(
        F.count("_v").alias("n"),
        F.percentile_approx("_v", edges, SKETCH_ACCURACY).alias("_e"), *extra)
    small = few
    if few:
        sketch = literal_table(sketch)[0]
    whole = F.col("n") <= SMALL_GROUP
    ranges = sketch.withColumn("_lo", F.when(whole, F.array(F.lit(float("-inf")))).otherwise(F.array(*[
        F.lit(float("-inf")) if p - BRACKET <= 0 else F.col("_e")[2 * k] for k, p in enumerate(order)])))
    ranges = ranges.withColumn("_hi", F.when(whole, F.array(F.lit(float("inf")))).otherwise(F.array(*[
        F.lit(float("inf")) if p + BRACKET >= 1 else F.col("_e")[2 * k + 1] for k, p in enumerate(order)])))
    lookup = ranges.select(*by, "_lo", "_hi")

    values = data.filter(F.col("_v").isNotNull()).select(*by, "_v")
    lookup = F.broadcast(lookup) if small else lookup
    hit = null_safe_join(values, lookup, by) if by else values.crossJoin(lookup)
    placed = hit.select(
        *by,
        F.size(F.filter("_lo", lambda a: a <= F.col("_v"))).alias("_pos"),
        F.when(F.exists(F.arrays_zip("_lo", "_hi"),
                        lambda r: (r["_lo"] <= F.col("_v")) & (F.col("_v") <= r["_hi"])),
               F.col("_v")).alias("_in"))
    counts = placed.groupBy(*by, "_pos", "_in").agg(F.count(F.lit(1)).alias("_c"))
    line = W.partitionBy(*by).orderBy(F.col("_pos"), F.col("_in").asc_nulls_last())
    counts = counts.withColumn("_cum", F.sum("_c").over(line.rowsBetween(W.unboundedPreceding, 0)))
    last = F.col("n") - 1
    literal = F.array(*[F.lit(p) for p in order])
    # ranks needed per group, computed once per group: two per quantile
    need = F.flatten(F.transform(literal, lambda p, k: F.array(
        F.struct(F.floor(p * last).alias("i"), k.alias("k"), F.lit(0).alias("w")),
        F.struct(F.least(F.floor(p * last) + 1, last).alias("i"), k.alias("k"), F.lit(1).alias("w")))))
    sized = sketch.select(*by, need.alias("_need"))
    sized = F.broadcast(sized) if small else sized
    counts = null_safe_join(counts, sized, by) if by else counts.crossJoin(sized)
    picked = counts.select(*by, "_in", F.explode(F.filter(
        "_need", lambda t: (t["i"] >= F.col("_cum") - F.col("_c")) & (t["i"] < F.col("_cum")))).alias("_t"))
    picked = picked.select(*by, F.struct(
        F.col("_t.k").alias("k"), F.col("_t.w").alias("w"),
        F.coalesce("_in", F.raise_error(F.lit("quantile rank outside its search range")).cast("double"))
        .alias("v")).alias("_s"))
    found = picked.groupBy(*by).agg(F.sort_array(F.collect_list("_s")).alias("_a"))  # 2 entries per quantile
    result = (null_safe_join(sketch, found, by, "left") if by
              else sketch.join(found, F.lit(True), "left"))

    def interpolated(k):
        at = F.element_at(literal, k + 1) * last
        lo, hi = F.col("_a")[2 * k]["v"], F.col("_a")[2 * k + 1]["v"]
        return lo + (hi - lo) * (at - F.floor(at))

    where = F.array(*[F.lit(order.index(p)) for p in probs])
    result = result.withColumn(out, F.when(F.col("n") > 0, F.transform(where, interpolated)))
    return result.select(*by, "n", out, *[c for c in sketch.columns if c not in (*by, "n", "_e")])
