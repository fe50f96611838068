"""Mixing sources to target weights by cube-method balanced sampling.

A source whose target is r times its size gives every document floor(r) times, and once more with the fractional
probability r - floor(r). These probabilities are moved through the null space of the balancing constraints (words and
documents of the source) until each is 0 or 1: three documents at a time have a direction that changes neither sum, and
a step along it fixes at least one of them. At most two documents of a group stay fractional. Groups are blocks of a
source dealt by hash; what stays open in the blocks of a source is balanced again, block of blocks by block of blocks,
until one block is left, whose last two documents are landed.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bermline.llm.text import SPACED
from bermline.session import cut_lineage

BLOCK_ROWS = 4096
WEIGHTS = (3, 1, 2)
TOTAL, MOST = 1.5, 2.0
MOST_SOURCES = 100_000  # source rows that are broadcast; more are joined by a shuffle


def flight(size: np.ndarray, p: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Move probabilities along the null space of (sum of p, sum of size * p) until at most two are fractional.

    ``u`` (0 to 1, one number a row) decides each step's direction, so that expected values are kept.
    """
    p = p.astype(float).tolist()
    s, u = size.astype(float).tolist(), u.tolist()
    eps = 1e-9
    active: list[int] = []
    for i in range(len(p)):
        if eps < p[i] < 1 - eps:
            active.append(i)
        else:
            p[i] = float(round(p[i]))
        while len(active) == 3:
            a, b, c = active
            d = (s[b] - s[c], s[c] - s[a], s[a] - s[b])
            if d == (0.0, 0.0, 0.0):
                d = (1.0, -1.0, 0.0)
            up = min((1 - p[k]) / x if x > 0 else p[k] / -x for k, x in zip(active, d) if x)
            down = min(p[k] / x if x > 0 else (1 - p[k]) / -x for k, x in zip(active, d) if x)
            step = up if u[i] * (up + down) < down else -down
            for k, x in zip(active, d):
                p[k] = min(1.0, max(0.0, p[k] + step * x))
                if p[k] < eps or p[k] > 1 - eps:
                    p[k] = float(round(p[k]))
            left = [k for k in active if 0.0 < p[k] < 1.0]
            if len(left) == 3:  # rounding kept all three open: fix the one nearest to a bound
                k = min(left, key=lambda k: min(p[k], 1 - p[k]))
                p[k] = float(round(p[k]))
                left.remove(k)
            active = left
    return np.array(p)


def land(size: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Fix the last fractional documents (two at most): the choice whose words come nearest to the expected ones."""
    open_ = np.flatnonzero((p > 0) & (p < 1))
    if len(open_) == 0:
        return p
    want = (size[open_] * p[open_]).sum()
    options = [np.array([(k >> j) & 1 for j in range(len(open_))], float) for k in range(1 << len(open_))]
    gap = [abs((size[open_] * x).sum() - want) + 1e-6 * abs(x.sum() - p[open_].sum()) for x in options]
    p = p.copy()
    p[open_] = options[int(np.argmin(gap))]
    return p


_ROW = "_id string, _source string, _size long, _key long, _u double, _p double"


def _balance(pdf: pd.DataFrame) -> pd.DataFrame:
    """One block, in the order of its hash; the only block of its source is landed."""
    pdf = pdf.sort_values(["_u", "_key"], kind="stable")
    size = pdf["_size"].to_numpy(float)
    p = flight(size, pdf["_p"].to_numpy(float), pdf["_u"].to_numpy(float))
    if pdf["_blocks"].iloc[0] == 1:
        p = land(size, p)
    return pdf.assign(_p=p)[["_id", "_source", "_size", "_key", "_u", "_p"]]


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """``_source, source_size, target`` from ``_source, _size`` rows: one row for each source.

    Sources in order of code points, null last, weigh ``weights`` in turn and share ``total`` times all words. A target
    stops at ``most`` times its source; the excess is shared anew by weight among the others until none is above.
    """
    rows = sizes.groupBy("_source").agg(F.sum("_size").alias("n")).toPandas()  # a row for each source
    names = rows["_source"].tolist()
    order = sorted(range(len(names)), key=lambda i: (names[i] is None, (names[i] or "").encode()))
    size = np.array([float(rows["n"].iloc[i]) for i in order])
    weight = np.array([float(weights[k % len(weights)]) for k in range(len(order))])
    target, full = np.zeros(len(order)), np.zeros(len(order), bool)
    while not full.all():
        rest = total * size.sum() - most * size[full].sum()
        share = rest * weight / weight[~full].sum()
        over = ~full & (share > most * size)
        if not over.any():
            target[~full] = share[~full]
            break
        full |= over
    target[full] = most * size[full]
    return sizes.sparkSession.createDataFrame([(names[i], int(n), float(t)) for i, n, t in zip(order, size, target)], "_source string, source_size long, target double")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, most: float = MOST,
                id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row for each row of ``docs``: ``<id>, <source>, size, source_size, target, copies, taken``.

    ``size`` counts words without white space (null and empty texts: 0), ``copies`` is how often the mix takes the
    document (at most ``most``, rounded up), ``taken`` = size * copies. The taken words of a source differ from its target
    by about half a document. Reruns agree: draws are hashes of id, text and source. A null source is a source of its own
    and comes last; null ids and repeated rows are documents like any other. Other columns are ignored.

    The driver holds one row for each source. Texts are read once and never shuffled.
    """
    if total > most:
        raise ValueError("total may not exceed most")
    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(id).cast("string").alias("_id"), F.col(source).cast("string").alias("_source"), F.xxhash64(content).alias("_hash"),
                       F.regexp_count(content, F.lit(SPACED)).cast("long").alias("_size"))
    same = Window.partitionBy("_id", "_hash", "_source").orderBy("_size")  # repeated rows are alike: any order of them will do
    rows = cut_lineage(rows.withColumn("_key", F.xxhash64("_id", "_hash", "_source", F.row_number().over(same))).drop("_hash"))
    targets = source_targets(rows, weights, total, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    known = targets.select(F.col("_source").alias("_s"), F.floor(rate + 1e-12).alias("_base"), F.greatest(rate - F.floor(rate + 1e-12), F.lit(0.0)).alias("_p"))
    known = F.broadcast(known) if targets.count() <= MOST_SOURCES else known
    unit = F.shiftrightunsigned(F.xxhash64("_key"), 11) / F.lit(float(1 << 53))
    open_ = rows.join(known, rows["_source"].eqNullSafe(known["_s"])).select("_id", "_source", "_size", "_key", unit.alias("_u"), "_p")
    settled = []
    while True:
        blocks = open_.groupBy("_source").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("_blocks")).withColumnRenamed("_source", "_s")
        block = F.pmod(F.xxhash64("_key", F.lit(len(settled))), F.col("_blocks"))
        moved = cut_lineage(open_.join(blocks, open_["_source"].eqNullSafe(blocks["_s"])).withColumn("_block", block).groupBy("_source", "_block").applyInPandas(_balance, _ROW))
        settled.append(moved.filter("_p = 0 OR _p = 1"))
        open_ = moved.filter("_p > 0 AND _p < 1")
        if open_.isEmpty():
            break
    done = settled[0]
    for part in settled[1:]:
        done = done.unionByName(part)
    again = targets.select(F.col("_source").alias("_s"), "source_size", "target", F.floor(rate + 1e-12).alias("_base"))
    again = F.broadcast(again) if targets.count() <= MOST_SOURCES else again
    copies = (F.col("_base") + F.col("_p")).cast("long")
    return done.join(again, done["_source"].eqNullSafe(again["_s"])).select(
        F.col("_id").cast(docs.schema[id].dataType).alias(id), F.col("_source").alias(source), F.col("_size").alias("size"), "source_size", "target",
        copies.alias("copies"), (F.col("_size") * copies).alias("taken"))
