"""Joins that keep wide rows in place where the other side is small enough to be known everywhere."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS_BOUND = 1_000_000  # distinct keys (8 bytes each) that may be broadcast


def split_by_keys(rows: DataFrame, key: str, keys: DataFrame, bound: int = KEYS_BOUND) -> tuple[DataFrame, DataFrame | None]:
    """``rows`` that may have their ``key`` among the distinct ``keys``, and those that surely have not.

    Up to ``bound`` keys are broadcast, so that only rows that find a partner need a shuffle in the join that follows.
    Beyond it all rows are returned as the first part (and None as the second): that join is right for any row.
    """
    if keys.limit(bound + 1).count() > bound:
        return rows, None
    known = F.broadcast(keys.select(F.col(keys.columns[0]).alias("_among")))
    return rows.join(known, rows[key] == F.col("_among"), "left_semi"), rows.join(known, rows[key] == F.col("_among"), "left_anti")
