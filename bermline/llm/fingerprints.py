"""Document fingerprints by closed syncmers.

Of all pieces of K characters those are anchors whose smallest inner piece of S characters lies at their front or back
edge. Whether a piece is an anchor depends on its own characters alone, so an edit only disturbs the anchors it touches
and equal passages keep theirs wherever they stand. Only a text of at least SURE characters is sure to have one, so in a
text shorter than twice that every inner piece is an anchor as well; the top bit of its hash is set. A fingerprint lists
the anchors in text order: 8 hex digits of the hash, then the distance from the anchor before in base 36, closed by a dot.

Two fingerprints are compared on their inner pieces if both have some, else on their syncmers, and by position: common anchors are paired in order of occurrence, and the longest chain of
pairs that runs forward in both counts. Likeness = 2 * chain / (anchors of both).
"""
from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bermline.llm.text import mix
from bermline.operators.ordered import bucket_of, order_splits

K, S = 30, 6
SURE = 2 * K - S  # one more than needed: of K - S pieces of K characters in a row one is a closed syncmer
_PIECE = np.uint32(1 << 31)
_POWERS = [pow(0x9E3779B97F4A7C15, e, 1 << 64) for e in range(S)]
_JOIN = mix(np.arange(1, K // S + 1, dtype=np.uint64)) | np.uint64(1)


def anchors(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (32 bits, the top one tells inner pieces from syncmers) and positions of the anchors of a text, in order.

    Texts shorter than 2 * SURE characters have their inner pieces, those shorter than S the whole as one; texts of K
    characters or more have their closed syncmers. The empty text alone has no anchor.
    """
    if not text:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(c) < S:
        whole = mix(np.array([sum((int(x) + 1) * pow(0x9E3779B97F4A7C15, i, 1 << 64) for i, x in enumerate(c)) % (1 << 64)], np.uint64))
        return (whole >> np.uint64(32)).astype(np.uint32) | _PIECE, np.zeros(1, np.int64)
    n = len(c) - S + 1
    inner = np.zeros(n, np.uint64)
    for e in range(S):
        inner += c[e : e + n] * np.uint64(_POWERS[e])
    inner = mix(inner)
    pieces = (inner >> np.uint64(32)).astype(np.uint32) | _PIECE
    if len(c) < K:
        return pieces, np.arange(n)
    width = K - S + 1
    low, span = inner, 1
    while span * 2 <= width:
        low = np.minimum(low[: len(low) - span], low[span:])
        span *= 2
    low = np.minimum(low[: n - width + 1], low[width - span : width - span + n - width + 1])
    m = n - width + 1
    at = np.flatnonzero((inner[:m] == low) | (inner[width - 1 : width - 1 + m] == low))
    h = np.zeros(len(at), np.uint64)
    for j in range(K // S):
        h += inner[at + j * S] * _JOIN[j]
    h = (mix(h) >> np.uint64(32)).astype(np.uint32) & ~_PIECE
    if len(c) >= 2 * SURE:
        return h, at
    h, at = np.concatenate([pieces, h]), np.concatenate([np.arange(n), at])
    order = np.argsort(at, kind="stable")
    return h[order], at[order]


_DIGITS = "0123456789abcdefghijklmnopqrstuvwxyz"


def _base36(x: int) -> str:
    out = ""
    while True:
        x, r = divmod(x, 36)
        out = _DIGITS[r] + out
        if not x:
            return out


_SMALL = [_base36(x) for x in range(256)]


def fingerprint(h: np.ndarray, at: np.ndarray) -> str:
    gaps = np.diff(at, prepend=0).tolist()
    return "".join([f"{x:08x}{_SMALL[g] if g < 256 else _base36(g)}." for x, g in zip(h.tolist(), gaps)])


def parse(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Anchors of a fingerprint."""
    parts = text.split(".")[:-1]
    return np.array([int(p[:8], 16) for p in parts], np.uint32), np.cumsum([int(p[8:], 36) for p in parts]).astype(np.int64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of anchors on the longest common forward chain of two anchor sequences, 0 to 1; 1 if both are empty.

    Inner pieces count if both sequences have some, else the syncmers: of texts whose lengths differ by less than the
    factor 2 one kind is in both.
    """
    if not len(a) and not len(b):
        return 1.0
    fine, other = a >= _PIECE, b >= _PIECE
    both = fine.any() and other.any()
    a, b = a[fine == both], b[other == both]
    if not len(a) or not len(b) or not np.isin(a, b).any():
        return 0.0
    same = 0  # a common start needs no search
    m = min(len(a), len(b))
    diff = np.flatnonzero(a[:m] != b[:m])
    same = int(diff[0]) if len(diff) else m
    places = defaultdict(list)
    for j, x in enumerate(b[same:].tolist()):
        places[x].append(j)
    used, tails = defaultdict(int), []
    for x in a[same:].tolist():
        k = used[x]
        if k < len(places.get(x, ())):
            used[x] = k + 1
            j = places[x][k]
            t = bisect_left(tails, j)
            if t == len(tails):
                tails.append(j)
            else:
                tails[t] = j
    return 2 * (same + len(tails)) / (len(a) + len(b))


_RESULT = {"_doc_id": pa.int64(), "n_chars": pa.int64(), "edited_text": pa.string(), "fingerprint": pa.string(), "edited_fingerprint": pa.string(),
           "near_edited": pa.float64(), "near_next": pa.float64()}
_CHUNK = 1 << 22  # characters of texts that are given back at once


def _neighbours(batches):
    """Rows (bucket, guard, id, text), sorted: one result for each row but guards, which only are the next row of the last one."""
    out = {k: [] for k in _RESULT}
    held, before = 0, None
    batch = lambda: pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), _RESULT.values())], names=list(out))
    for b in batches:
        for bucket, guard, id, text in zip(*(b.column(i).to_pylist() for i in range(4))):
            h, at = anchors(text)
            if before is not None and before[0] == bucket and not before[1]:
                mine, own, oh, oat = before[2:]
                m = len(own) // 4
                edited = own[: len(own) - m] + text[:m] if m else own
                eh, eat = anchors(edited) if m else (oh, oat)
                for v, x in zip(out.values(), (mine, len(own), edited, fingerprint(oh, oat), fingerprint(eh, eat), likeness(oh, eh), likeness(oh, h))):
                    v.append(x)
                held += len(own)
                if held > _CHUNK:
                    yield batch()
                    held, out = 0, {k: [] for k in _RESULT}
            before = (bucket, guard, id, text, h, at)
    yield batch()


def fingerprint_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Every row with its ``fingerprint``; null counts as empty. An input column of that name is replaced."""
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([fingerprint(*anchors(x or "")) for x in b.column(b.num_columns - 1).to_pylist()], pa.string())],
                                             names=[*b.schema.names[:-1], "fingerprint"])
    keep = docs.drop("fingerprint")
    return keep.select("*", F.col(text).cast("string").alias("_fingerprinted")).mapInArrow(run, T.StructType([*keep.schema.fields, T.StructField("fingerprint", T.StringType())]))


BUCKET_ROWS, MOST_BUCKETS = 4000, 8192  # rows of an id range that are aimed at; ranges at most (then they hold more rows)


def compare_neighbours(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document against its edited self and the next document: ``<id>, n_chars, edited_text, fingerprint,
    edited_fingerprint, near_edited, near_next``.

    The edited text has its last quarter (rounded down, in code points) replaced by as many of the first characters of
    the next document in order of (id, text), or all it has; the first document follows the last, a single one follows
    itself. Ids are whole numbers, null ids come first; null texts are empty. Repeated rows are documents of their own.
    Other columns are ignored.

    Documents are dealt to id ranges by a bounded sketch of the ids, and the first id of a range goes to the range before
    as well. Texts are shuffled once and read in order, a pair at a time. Rows of one id share a range.
    """
    rows = docs.select(F.col(id).cast("long").alias("_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    rows = rows.withColumn("_key", F.coalesce("_id", F.lit(-(2**63))))
    wanted = min(MOST_BUCKETS, rows.count() // BUCKET_ROWS + 1)
    splits = sorted(set(order_splits(rows, "_key", wanted))) if wanted > 1 else []
    rows = rows.withColumn("_bucket", bucket_of(F.col("_key"), splits))
    first = sorted(tuple(r) for r in rows.groupBy("_bucket").agg(F.min("_key")).collect())  # a row for each range
    guards = [(first[k - 1][0], key) for k, (_, key) in enumerate(first)]
    seen = docs.sparkSession.createDataFrame(guards, "_before int, _first long")
    ends = rows.join(F.broadcast(seen), rows["_key"] == seen["_first"]).select("_id", "_text", "_key", F.col("_before").alias("_bucket"))
    dealt = rows.withColumn("_guard", F.lit(0)).unionByName(ends.withColumn("_guard", F.lit(1)))
    dealt = dealt.repartition("_bucket").sortWithinPartitions("_bucket", "_guard", "_key", "_text").select("_bucket", "_guard", "_id", "_text")
    return dealt.mapInArrow(_neighbours, "_doc_id long, n_chars long, edited_text string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
                            ).withColumnRenamed("_doc_id", id)
