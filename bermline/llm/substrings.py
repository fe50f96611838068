"""Substring dedup: words inside long passages that an earlier document already has.

Method: difference-cover anchors. The residues ``COVER`` modulo ``PERIOD`` hold a pair for every difference, so for
any two positions there is a shift below PERIOD that moves both onto the cover. A common run of ``window`` words
therefore shares an anchor of ``window - PERIOD + 1`` words that starts on a cover position in both documents. Only
these anchors are shuffled; where one occurs in two different texts, the windows around it are hashed whole and
compared (the extension), so the decision is about exact windows.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bermline.llm.joins import split_by_keys
from bermline.llm.text import list_values, rolling, signed, slices, spans, split_words
from bermline.session import cut_lineage

PERIOD = 31
COVER = (0, 1, 3, 8, 12, 18)  # a perfect difference set: every difference modulo 31 occurs


def _passages(window: int):
    """Per row with a window: hash of all its words, and its anchors."""
    size = window - PERIOD + 1
    cover = np.isin(np.arange(PERIOD), COVER)

    def run(batches):
        for b in batches:
            for r0, r1, data, offsets in slices(b.column(1)):
                w = split_words(data, offsets, alnum=False)
                counts = w.counts
                whole = spans(w.hash, w.first[:-1], w.first[1:])
                at = w.starts_of(size)
                row = w.row()[at]
                pos = at - w.first[row]
                keep = cover[pos % PERIOD] & (counts[row] >= window)
                at, row, pos = at[keep], row[keep], pos[keep]
                yield pa.RecordBatch.from_arrays([pa.array(signed(rolling(w.hash, size)[at])), pa.array(signed(whole[row])), pa.array(pos.astype(np.int32))],
                                                 names=["_anchor", "_whole", "_pos"])
    return run


def _wholes(window: int):
    def run(batches):
        for b in batches:
            for r0, r1, data, offsets in slices(b.column(1)):
                w = split_words(data, offsets, alnum=False)
                row = np.flatnonzero(w.counts >= window)
                both = [pa.array(signed(spans(w.hash, w.first[:-1], w.first[1:], base)[row])) for base in (0, 1)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(r0, r1 - r0).take(pa.array(row)), *both], names=["_id", "_whole", "_whole2"])
    return run


def _windows(window: int):
    """Hashes of the windows that hold a marked anchor. Input: id, text, hash of the marked text, anchor positions."""
    reach = PERIOD - 1

    def run(batches):
        for b in batches:
            marks, bounds = list_values(b.column(3))
            wanted = np.asarray(b.column(2))
            for r0, r1, data, offsets in slices(b.column(1)):
                w = split_words(data, offsets, alnum=False)
                whole = signed(spans(w.hash, w.first[:-1], w.first[1:]))
                near = np.zeros(len(w.start) + 1, np.int64)
                for i in range(r1 - r0):
                    if whole[i] != wanted[r0 + i]:  # another text under the same id
                        continue
                    p = marks[bounds[r0 + i] : bounds[r0 + i + 1]]
                    last = w.first[i + 1] - w.first[i] - window
                    lo, hi = np.maximum(p - reach, 0), np.minimum(p, last) + 1
                    ok = lo < hi
                    np.add.at(near, w.first[i] + lo[ok], 1)
                    np.add.at(near, w.first[i] + hi[ok], -1)
                at = np.flatnonzero(np.cumsum(near[:-1]) > 0)
                row = w.row()[at]
                ids = b.column(0).slice(r0, r1 - r0).take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(rolling(w.hash, window)[at])), pa.array(signed(rolling(w.hash, window, 1)[at])), ids, pa.array(whole[row]),
                     pa.array((at - w.first[row]).astype(np.int32))], names=["_w1", "_w2", "_id", "_whole", "_pos"])
    return run


def _kept(window: int, text_at: int, columns: list[str]):
    """Words that stay. Last column: (whole, starts of removed windows or null for a whole copy) of the row's id."""
    def run(batches):
        for b in batches:
            acts = b.column(b.num_columns - 1)
            for r0, r1, data, offsets in slices(b.column(text_at)):
                n_words, n_removed, kept = [], [], []
                raw = data.tobytes()
                hashes = None
                for i in range(r1 - r0):
                    ws = raw[offsets[i] : offsets[i + 1]].split()
                    n = len(ws)
                    act = acts[r0 + i].as_py() if n >= window and acts[r0 + i].is_valid else None
                    if act:
                        if hashes is None:
                            w = split_words(data, offsets, alnum=False)
                            hashes = signed(spans(w.hash, w.first[:-1], w.first[1:]))
                        for a in act:
                            if a["_whole"] != hashes[i]:
                                continue
                            if a["_starts"] is None:
                                ws = []
                                break
                            out = np.zeros(n + 1, np.int32)
                            starts = np.asarray(a["_starts"])
                            np.add.at(out, starts, 1)
                            np.add.at(out, starts + window, -1)
                            stays = np.cumsum(out[:-1]) == 0
                            ws = [x for x, s in zip(ws, stays.tolist()) if s]
                    n_words.append(n)
                    n_removed.append(n - len(ws))
                    kept.append(b" ".join(ws))
                part = b.slice(r0, r1 - r0).columns[:-1]
                yield pa.RecordBatch.from_arrays([*part, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                                                  pa.array(kept, pa.binary()).cast(pa.string())], names=[*columns, "n_words", "n_removed", "kept_text"])
    return run


def remove_repeats(docs: DataFrame, window: int = 50, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row with ``n_words``, ``n_removed`` and ``kept_text`` (kept words joined by one space).

    Words are runs without white space. A word goes if it is covered by a window of ``window`` consecutive words whose
    sequence also starts in a row with a smaller id; windows are judged on the input. Ids are whole numbers; rows that
    share an id don't remove each other's words, and a null id counts as the largest possible one. Null and empty texts
    have no words. Input columns named like the three results are replaced; all others pass.

    Windows and whole texts are compared by 128 bits of hash. Copies of one text count once: a copy of a smaller id's text goes whole.
    A passage that many documents share is one aggregated row per task and a join that AQE splits. Whole texts are
    shuffled only for documents that have something to compare or to lose.
    """
    if window < PERIOD:
        raise ValueError(f"window must be at least {PERIOD}")
    key = F.coalesce(F.col(id).cast("long"), F.lit(2**63 - 1)).alias("_id")
    slim = docs.select(key, F.col(text).cast("string").alias("_text"))
    anchors = slim.mapInArrow(_passages(window), "_anchor long, _whole long, _pos int")
    # the few repeated keys are written first, so that the join's own shuffle stands alone and AQE can split a hot key
    shared = cut_lineage(anchors.groupBy("_anchor").agg(F.min("_whole").alias("_a"), F.max("_whole").alias("_b")).filter("_a <> _b").select("_anchor"))
    wholes = slim.mapInArrow(_wholes(window), "_id long, _whole long, _whole2 long")
    earliest = cut_lineage(wholes.groupBy("_whole", "_whole2").agg(F.min("_id").alias("_id"), F.max("_id").alias("_last")))
    # one row for a text, however many copies it has; texts that agree in the first hash only are marked alike
    marks = anchors.join(shared, "_anchor").groupBy("_whole").agg(F.collect_set("_pos").alias("_marks"))
    marks = cut_lineage(marks.join(earliest.select("_whole", "_id"), "_whole"))
    marked, _ = split_by_keys(slim, "_id", marks.select("_id").distinct())
    windows = marked.join(marks, "_id").select("_id", "_text", "_whole", "_marks").mapInArrow(_windows(window), "_w1 long, _w2 long, _id long, _whole long, _pos int")
    firsts = cut_lineage(windows.groupBy("_w1", "_w2").agg(F.min("_id").alias("_min"), F.max("_id").alias("_max")).filter("_min < _max").select("_w1", "_w2", "_min"))
    gone = windows.join(firsts, ["_w1", "_w2"]).filter("_id > _min").groupBy("_id", "_whole").agg(F.collect_set("_pos").alias("_starts"))
    copies = (wholes.join(earliest.filter("_id < _last").select("_whole", "_whole2", F.col("_id").alias("_min")), ["_whole", "_whole2"]).filter("_id > _min")
              .select("_id", "_whole", F.lit(None).cast("array<int>").alias("_starts")).distinct())
    # a whole copy has no windows of its own, so an id and a text have one action
    actions = cut_lineage(gone.unionByName(copies).groupBy("_id").agg(F.collect_list(F.struct("_whole", "_starts")).alias("_actions")))
    kept = docs.drop("n_words", "n_removed", "kept_text")
    own = {c: f"_own{c}" for c in kept.columns if c in ("_id", "_actions", "_among")}  # input columns with names that are needed here
    full = kept.withColumnsRenamed(own).withColumn("_id", F.coalesce(F.col(own.get(id, id)).cast("long"), F.lit(2**63 - 1)))
    touched, others = split_by_keys(full, "_id", actions.select("_id"))
    every = touched.join(actions, "_id", "left").select(*full.columns, "_actions")
    if others is not None:
        every = every.unionByName(others.withColumn("_actions", F.lit(None).cast(actions.schema["_actions"].dataType)))
    out = T.StructType([*full.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])
    done = every.mapInArrow(_kept(window, full.columns.index(own.get(text, text)), full.columns), out).drop("_id")
    return done.withColumnsRenamed({v: k for k, v in own.items()})
