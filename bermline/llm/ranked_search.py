"""Ranked lexical search by presence-mask grouping.

Documents stay where they are read. In a block of documents each query term has a bitmap of the documents that hold it.
For an item the bitmaps of its terms are turned into one mask a document; documents with equal masks form a group, and
the largest score a mask allows is the sum of its terms' weights times their largest factors in the block. Groups are
scored by descending bound until the bound falls below the last score that is still listed, so most documents are never
scored. A task keeps the best of each item over all its blocks; the lists of the tasks are merged at the end.
"""
from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bermline.llm.text import slices, split_words

TOP = 10
BLOCK_ROWS = 8192
PASS_BYTES = 8_000_000  # item text whose terms are sent to all tasks in one pass over the documents; more items take more passes
CELLS = 1 << 22  # terms times documents of one bitmap
TOGETHER = 64  # documents of several masks that are scored in one step
B_PERCENT = 75


class Items:
    """Terms of a bounded set of items: ``vocabulary`` sorted by hash, and for each item its terms and repeats."""

    def __init__(self, texts: list[str | None]):
        found = []
        for t in texts:
            raw = np.frombuffer((t or "").encode("utf-8", "surrogatepass"), np.uint8)
            found.append(split_words(raw, np.array([0, len(raw)]), alnum=True).hash)
        self.vocabulary = np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)
        self.terms, self.repeats = [], []
        for h in found:
            t, n = np.unique(h, return_counts=True)
            self.terms.append(np.searchsorted(self.vocabulary, t))
            self.repeats.append(n.astype(np.int64))


class Block:
    """Postings of the vocabulary in some documents: sorted keys term * rows + row, their counts, words of each document."""

    def __init__(self, vocabulary: np.ndarray, texts: pa.Array):
        rows, lengths, keys = len(texts), [], []
        for r0, _, data, offsets in slices(texts):
            w = split_words(data, offsets, alnum=True)
            lengths.append(w.counts)
            at = np.minimum(np.searchsorted(vocabulary, w.hash), len(vocabulary) - 1)
            known = np.flatnonzero(vocabulary[at] == w.hash) if len(vocabulary) else np.zeros(0, np.int64)
            keys.append(at[known].astype(np.int64) * rows + (w.row()[known] + r0))
        self.rows, self.vocabulary = rows, len(vocabulary)
        self.lengths = np.concatenate(lengths).astype(np.int64) if lengths else np.zeros(0, np.int64)
        self.keys, self.tf = np.unique(np.concatenate(keys), return_counts=True) if keys else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.bounds = np.searchsorted(self.keys, np.arange(self.vocabulary + 1) * rows)

    def factors(self, n_docs: int, n_terms: int) -> None:
        m = 100 - B_PERCENT + (B_PERCENT * self.lengths * n_docs) // max(n_terms, 1)
        tf = self.tf.astype(np.int64)
        self.factor = (1_000_000_000 * tf) // (1000 * tf + 8 * m[self.keys % max(self.rows, 1)])
        full = np.flatnonzero(np.diff(self.bounds))
        self.most = np.zeros(self.vocabulary, np.int64)
        if len(full):
            self.most[full] = np.maximum.reduceat(self.factor, self.bounds[full])

    def masks(self, terms: np.ndarray, a: int, b: int) -> np.ndarray:
        """One mask of terms for each document from a to b, as rows of bytes."""
        present = np.zeros((len(terms), b - a), bool)
        for i, t in enumerate(terms):
            rows = self.keys[self.bounds[t] : self.bounds[t + 1]] - t * self.rows
            if a or b < self.rows:
                rows = rows[(rows >= a) & (rows < b)] - a
            present[i, rows] = True
        packed = np.packbits(present, axis=0)  # bit i of a column: the document has term i
        return np.ascontiguousarray(np.pad(packed, ((0, -len(packed) % 8), (0, 0))).T)

    def scores(self, terms: np.ndarray, weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
        key = terms[:, None] * self.rows + rows[None, :]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return (np.where(self.keys[at] == key, self.factor[at], 0) * weights[:, None]).sum(axis=0)


class Best:
    """The best documents of one item so far."""

    def __init__(self, top: int):
        self.top, self.score, self.id, self.null = top, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    @property
    def least(self) -> int:
        """A score that could still be listed must reach this."""
        return int(self.score[-1]) if len(self.score) == self.top else 1

    def add(self, score: np.ndarray, id: np.ndarray, null: np.ndarray) -> None:
        keep = score >= self.least
        s, i, n = (np.concatenate([x, y[keep]]) for x, y in ((self.score, score), (self.id, id), (self.null, null)))
        order = np.lexsort((i, n, -s))[: self.top]
        self.score, self.id, self.null = s[order], i[order], n[order]


def search_block(block: Block, terms: np.ndarray, weights: np.ndarray, best: Best, ids: np.ndarray, nulls: np.ndarray) -> int:
    """Adds the block's documents to ``best``; returns how many were scored."""
    bound = weights * block.most[terms]
    some = bound > 0
    terms, weights, bound, scored = terms[some], weights[some], bound[some], 0
    if not len(terms) or bound.sum() < best.least:
        return 0
    step = max(64, CELLS // len(terms))
    for a in range(0, block.rows, step):
        masks = block.masks(terms, a, min(a + step, block.rows))
        width = masks.shape[1]
        kinds, group = np.unique(masks.view(np.uint64).ravel() if width == 8 else masks.view(np.dtype((np.void, width))).ravel(), return_inverse=True)
        bits = np.unpackbits(kinds.view(np.uint8).reshape(len(kinds), width), axis=1)[:, : len(terms)]
        allowed = bits.astype(np.int64) @ bound
        order = np.argsort(-allowed, kind="stable")
        members = np.argsort(group, kind="stable")
        count = np.bincount(group, minlength=len(kinds))
        ends, size = np.cumsum(count), np.cumsum(count[order])
        at = 0
        while at < len(order) and allowed[order[at]] >= best.least:
            # small groups are scored together, a large one only after all before it
            next_ = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + TOGETHER, "right")))
            rows = np.concatenate([members[ends[k] - count[k] : ends[k]] for k in order[at:next_]]) + a
            for r0 in range(0, len(rows), step):
                rows_now = rows[r0 : r0 + step]
                best.add(block.scores(terms, weights, rows_now), ids[rows_now], nulls[rows_now])
            scored += len(rows)
            at = next_
    return scored


def _blocks(batches):
    for b in batches:
        for a in range(0, b.num_rows, BLOCK_ROWS):
            yield b.slice(a, BLOCK_ROWS)


def _statistics(vocabulary: np.ndarray):
    """Documents of each term; -1: documents with a term, -2: terms of all documents. One row each for a task."""
    def run(batches):
        df, docs, terms = np.zeros(len(vocabulary), np.int64), 0, 0
        for b in _blocks(batches):
            block = Block(vocabulary, b.column(0))
            df += np.diff(block.bounds)
            docs += int((block.lengths > 0).sum())
            terms += int(block.lengths.sum())
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([at, [-1, -2]])), pa.array(np.concatenate([df[at], [docs, terms]]))], names=["_term", "_n"])
    return run


def _search(items: Items, weights: np.ndarray, n_docs: int, n_terms: int, top: int):
    def run(batches):
        best = [Best(top) for _ in items.terms]
        useful = [(t, weights[t] * r) for t, r in zip(items.terms, items.repeats)]
        for b in _blocks(batches):
            block = Block(items.vocabulary, b.column(1))
            if not len(block.keys):
                continue
            block.factors(n_docs, n_terms)
            nulls = np.asarray(b.column(0).is_null())
            ids = np.asarray(pc.fill_null(b.column(0), 0))
            for (t, w), x in zip(useful, best):
                search_block(block, t, w, x, ids, nulls)
        n = [len(x.score) for x in best]
        cat = lambda f, kind: np.concatenate([f(x) for x in best]) if best else np.zeros(0, kind)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(best), dtype=np.int32), n)), pa.array(cat(lambda x: x.id, np.int64), mask=cat(lambda x: x.null, bool)),
                                          pa.array(cat(lambda x: x.score, np.int64))], names=["_item", "_doc", "score"])
    return run


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def rank_documents(docs: DataFrame, items: DataFrame, top: int = TOP, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
                   pass_bytes: int = PASS_BYTES) -> DataFrame:
    """``<item>, rank, <id>, score``: the ``top`` best documents of each item with a score above 0.

    Terms are the words of the whole text, only A-Z lower-cased; statistics are of all documents with a term. Equal
    scores go by ascending id, a null id last; repeated documents are ranked each. Ids of documents are whole numbers.
    Null and empty texts have no terms; an item without terms, or none that a document has, gives no rows. Equal rows of
    an item count once; different texts under one item id are ranked each on its own. Other columns are ignored.

    Items are dealt to passes of bounded text, and each pass reads the documents twice, for the statistics and for the
    search, without a shuffle of texts or postings. A task returns at most ``top`` rows an item.
    """
    spark = docs.sparkSession
    asked = items.select(F.col(item).alias("_id"), F.col(item_text).cast("string").alias("_text")).distinct()
    asked_bytes = asked.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    passes = max(1, -(-asked_bytes // pass_bytes))
    slim = docs.select(F.col(id).cast("long").alias("_doc"), F.col(text).cast("string").alias("_text"))
    kind, out = docs.schema[id].dataType, None
    named = T.StructType([T.StructField("_item", T.IntegerType()), T.StructField("_id", items.schema[item].dataType)])
    for p in range(passes):
        rows = asked.filter(F.pmod(F.xxhash64("_id", "_text"), F.lit(passes)) == p).collect()
        told = Items([r["_text"] for r in rows])
        counts = {r["_term"]: r["_n"] for r in slim.select("_text").mapInArrow(_statistics(told.vocabulary), "_term long, _n long").groupBy("_term").agg(F.sum("_n").alias("_n")).collect()}
        n_docs, n_terms = counts.get(-1, 0), counts.get(-2, 0)
        weights = np.array([term_weight(n_docs, counts[t]) if t in counts else 0 for t in range(len(told.vocabulary))], np.int64)
        found = slim.mapInArrow(_search(told, weights, n_docs, n_terms, top), "_item int, _doc long, score long")
        place = F.row_number().over(Window.partitionBy("_item").orderBy(F.desc("score"), F.col("_doc").asc_nulls_last()))
        best = found.withColumn("rank", place).filter(F.col("rank") <= top)
        known = F.broadcast(spark.createDataFrame([(i, r["_id"]) for i, r in enumerate(rows)], named))
        best = best.join(known, "_item").select(F.col("_id").alias(item), "rank", F.col("_doc").cast(kind).alias(id), "score")
        out = best if out is None else out.unionByName(best)
    return out
