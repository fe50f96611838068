"""A bounded sample of rows per class for fitting a model."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def held_out(id: Column) -> Column:
    """One fifth of the ids: crc32 of the id as text, modulo 5, is 0. A null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(id.cast("string")), F.lit(5)) == 0, F.lit(False))


def bounded_sample(rows: DataFrame, by: str, most: int, key: str) -> DataFrame:
    """At most ``most`` rows for each value of ``by``, drawn by a hash of ``key``; the same rows on every run.

    Counts are taken first; each class is then thinned by a hash threshold that leaves about 1.2 times the bound, and
    only this remainder is ranked, so no class meets whole in one task.
    """
    counts = rows.groupBy(by).agg(F.count(F.lit(1)).alias("_n"))
    h = F.pmod(F.xxhash64(F.col(key)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    thin = rows.join(F.broadcast(counts), by).filter(h <= 1.2 * most / F.col("_n") + 50 / F.col("_n"))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.xxhash64(key), key))
    return thin.withColumn("_rank", rank).filter(F.col("_rank") <= most).drop("_rank", "_n")
