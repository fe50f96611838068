"""Quality classifier: logistic regression over hashed word n-grams, fitted by follow-the-regularised-leader.

Tokens are words, and runs of signs, as they stand in the text; features are hashed n-grams of one and two tokens,
hashed word shapes, and a few hashed bins of whole-text ratios, all binary. A score is a sparse dot product with the
weights, which the update keeps sparse by its L1 term.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bermline.llm.sampling import bounded_sample, held_out
from bermline.llm.text import lists, mix, slices, spans
from bermline.session import cut_lineage

BITS = 18
FEATURE_BYTES = 1 << 18  # text that is turned into features at once; its temporaries are some 70 times as large
SAMPLE = 6000  # labelled rows of each label that are learned from at most
EPOCHS = 6
ALPHA, BETA, L1, L2 = 3.0, 1.0, 0.3, 1.0
THRESHOLD = 0.3

_b = np.arange(256)
_UPPER, _LOWER, _DIGIT = (_b >= 65) & (_b <= 90), ((_b >= 97) & (_b <= 122)) | (_b >= 128), (_b >= 48) & (_b <= 57)
_SPACE = (_b == 32) | ((_b >= 9) & (_b <= 13))
# 0 white space, 1 sign, 2 upper, 3 lower, 4 digit
_CLASS = np.where(_SPACE, 0, np.where(_UPPER, 2, np.where(_LOWER, 3, np.where(_DIGIT, 4, 1)))).astype(np.uint8)
_KIND = np.array([0, 1, 2, 2, 2], np.uint8)
_SALT = mix(np.arange(1, 9, dtype=np.uint64))
_TABLE = mix(np.arange(500, 756, dtype=np.uint64))


def _bins(name: int, x: np.ndarray, edges) -> np.ndarray:
    return mix(np.searchsorted(np.asarray(edges), x).astype(np.uint64) + np.uint64(1000 * name) + _SALT[7])


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature indices of each row, and their numbers."""
    rows = len(offsets) - 1
    cls = _CLASS[data]
    kind = _KIND[cls]
    opens = np.ones(len(data), bool)
    opens[1:] = kind[1:] != kind[:-1]
    opens[offsets[(offsets < len(data))]] = True
    at = np.flatnonzero(opens)
    end = np.append(at[1:], len(data))
    keep = kind[at] != 0
    at, end = at[keep], end[keep]
    first = np.searchsorted(at, offsets)
    count = np.diff(first)
    row = np.repeat(np.arange(rows), count)
    low = np.where(_UPPER[data], data + 32, data).astype(np.uint8)
    h = spans(_TABLE[low], at, end)
    starts, sums = at, {}
    for c in (1, 2, 3, 4):
        p = np.concatenate([[0], np.cumsum(cls == c)])
        sums[c] = p[end] - p[starts]
    length = end - at
    shape = mix((np.minimum(length, 12) + 16 * np.minimum(sums[2], 3) + 64 * np.minimum(sums[4], 3) + 256 * (kind[at] == 1)).astype(np.uint64) + _SALT[1])
    pair = np.flatnonzero(row[1:] == row[:-1]) if len(row) > 1 else np.zeros(0, np.int64)
    repeated = h[pair] == h[pair + 1]
    two = mix(h[pair] * np.uint64(3) + h[pair + 1] + _SALT[2])
    two_shapes = mix(shape[pair] * np.uint64(3) + shape[pair + 1] + _SALT[3])
    n = np.maximum(count, 1)
    per = lambda x: np.bincount(row, x, rows)
    words = np.maximum(per((kind[at] == 2).astype(float)), 1)
    letters = np.maximum(per((sums[2] + sums[3]).astype(float)), 1)
    ratios = [
        (1, np.log2(1 + count), np.arange(0, 16, 1)),
        (2, per((kind[at] == 1).astype(float)) / n, (0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5)),
        (3, per(sums[2].astype(float)) / letters, (0.02, 0.05, 0.1, 0.2, 0.4, 0.7, 0.9)),
        (4, np.bincount(row[pair], repeated, rows) / n, (0.005, 0.02, 0.05, 0.1, 0.2, 0.4, 0.7)),
        (5, per(length * (kind[at] == 2)) / words, (2, 3, 4, 5, 6, 8, 12)),
        (6, per(sums[4].astype(float)) / letters, (0.001, 0.01, 0.05, 0.2)),
    ]
    order = np.lexsort((h, row))
    distinct = np.ones(len(h), bool)
    distinct[1:] = (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])
    variety = np.bincount(row[order][distinct], minlength=rows) / n
    ratios.append((7, variety * np.log2(2 + count), (0.5, 1, 1.5, 2, 3, 4, 5, 6, 7, 8)))
    every, owner = [h, shape, two, two_shapes, np.full(int(repeated.sum()), _SALT[4])], [row, row, row[pair], row[pair], row[pair][repeated]]
    bins = [_bins(k, x, e) for k, x, e in ratios]
    for k, x in enumerate(bins):
        every += [x] + [mix(x + np.uint64(7) * y) for y in bins[k + 1 :]]
        owner += [np.arange(rows)] * (len(bins) - k)
    index = (np.concatenate(every) >> np.uint64(64 - BITS)).astype(np.int64)
    key = np.unique(np.concatenate(owner).astype(np.int64) << BITS | index)
    return (key & ((1 << BITS) - 1)).astype(np.int32), np.bincount(key >> BITS, minlength=rows)


def follow_leader(rows: list[np.ndarray], labels: np.ndarray, importance: np.ndarray | None = None, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """Weights of a logistic regression after passes over binary sparse rows: indices and values of those not zero.

    ``importance`` multiplies a row's gradient. The state is averaged over the last pass, so the rows that happen to come
    last don't outweigh the others.
    """
    z, n, late = np.zeros(1 << BITS), np.zeros(1 << BITS), np.zeros(1 << BITS)
    importance = np.ones(len(rows)) if importance is None else importance
    for epoch in range(epochs):
        for step, (x, y, c) in enumerate(zip(rows, labels, importance)):
            zi, ni = z[x], n[x]
            w = np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))
            scale = np.sqrt(len(x) or 1)
            g = c * (1 / (1 + np.exp(-np.clip(w.sum() / scale, -30, 30))) - y) / scale
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA
            change = g - sigma * w
            z[x] += change
            n[x] += g * g
            if epoch == epochs - 1:
                late[x] += step * change  # a change made at step t is missing in t of the states after each step
    z -= late / max(len(rows), 1)
    w = np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    at = np.flatnonzero(w)
    return at, w[at]


def _indices(batches):
    """Distinct feature indices of each text, the last column, in its place."""
    for b in batches:
        made = [features(data, offsets) for _, _, data, offsets in slices(b.column(b.num_columns - 1), FEATURE_BYTES)]
        if made:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], lists(np.concatenate([x for x, _ in made]), np.concatenate([c for _, c in made]), pa.int32())],
                                             names=[*b.schema.names[:-1], "_index"])


def _fit_group(importance: dict[int, float]):
    """All rows of the bounded sample, in an order that has nothing to do with how they were drawn."""
    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(_bytes=[np.asarray(x, np.int32).tobytes() for x in pdf["_index"]]).sort_values(["_order", "_id", "_label", "_bytes"])
        rows = [np.frombuffer(x, np.int32) for x in pdf["_bytes"]]
        at, w = follow_leader(rows, pdf["_label"].to_numpy(float), pdf["_label"].map(importance).to_numpy(float))
        return pd.DataFrame({"index": at, "weight": w})
    return fit


def fit_quality(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality", most: int = SAMPLE) -> np.ndarray:
    """Weights (2**BITS numbers) from rows of ``docs`` whose id has a label of 0 or 1 and is not held out.

    Learns from at most ``most`` rows of each label, drawn by a hash of the id: this documented bound lets one task fit
    them, and only feature indices are sent there. A label that the bound thins counts for all its rows, so scores follow
    the shares of the labels in the whole table. An id with both labels counts under both; repeated labels count once.
    Without such rows all weights are 0.
    """
    known = labels.filter(F.col(label).isin(0, 1) & F.col(id).isNotNull() & ~held_out(F.col(id))).select(F.col(id).alias("_id"), F.col(label).cast("int").alias("_label")).distinct()
    present = docs.select(F.col(id).alias("_id")).distinct()
    labelled = cut_lineage(known.join(present, "_id", "left_semi"))
    there = {r["_label"]: r["n"] for r in labelled.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).collect()}
    taken = {k: min(n, most) for k, n in there.items()}
    share = sum(taken.values()) / max(sum(there.values()), 1)
    importance = {k: there[k] / taken[k] * share for k in there}
    ids = bounded_sample(labelled, "_label", most, "_id")
    rows = docs.select(F.col(id).alias("_id"), F.col(text).cast("string").alias("_text"))
    # the draw takes the smallest hashes of the id; another seed keeps the order of the passes free of it
    sample = rows.join(F.broadcast(ids), "_id").select("_id", "_label", F.xxhash64(F.lit("pass"), "_id").alias("_order"), "_text")
    kinds = {f.name: f.dataType.simpleString() for f in sample.schema.fields}
    indexed = sample.mapInArrow(_indices, f"_id {kinds['_id']}, _label int, _order long, _index array<int>")
    model = indexed.withColumn("_all", F.lit(1)).groupBy("_all").applyInPandas(_fit_group(importance), "index long, weight double").toPandas()
    w = np.zeros(1 << BITS)
    w[model["index"].to_numpy(np.int64)] = model["weight"].to_numpy()
    return w


def _score(weights: np.ndarray, name: str, text_at: int, kept: int):
    at = np.flatnonzero(weights).astype(np.int32)
    values = weights[at].astype(np.float64)

    def run(batches):
        w = np.zeros(1 << BITS)
        w[at] = values
        for b in batches:
            told = []
            for _, _, data, offsets in slices(b.column(text_at), FEATURE_BYTES):
                index, counts = features(data, offsets)
                row = np.repeat(np.arange(len(counts)), counts)
                told.append(1 / (1 + np.exp(-np.clip(np.bincount(row, w[index], len(counts)) / np.sqrt(np.maximum(counts, 1)), -30, 30))))
            yield pa.RecordBatch.from_arrays([*b.columns[:kept], pa.array(np.concatenate(told) if told else np.zeros(0))], names=[*b.schema.names[:kept], name])
    return run


def score_quality(docs: DataFrame, weights: np.ndarray, text: str = "text", keep: list[str] | None = None, out: str = "score") -> DataFrame:
    """The columns ``keep`` (default: all but the text) with ``out`` from 0 to 1; higher: label 1 is likelier.

    Only the whole text is looked at. A null text scores as an empty one. An input column named ``out`` is replaced.
    """
    keep = [c for c in (keep if keep is not None else docs.columns) if c != out and (keep is not None or c != text)]
    sent = text in keep and isinstance(docs.schema[text].dataType, T.StringType)  # then the text goes to Python once
    slim = docs.select(*keep) if sent else docs.select(*keep, F.col(text).cast("string").alias("_scored"))
    at = keep.index(text) if sent else len(keep)
    return slim.mapInArrow(_score(weights, out, at, len(keep)), T.StructType([*slim.schema.fields[: len(keep)], T.StructField(out, T.DoubleType())]))
