"""Filter interaction audit: what each filter removes in every order in which the filters may be applied.

Texts are measured by a table-driven byte transducer: one table gives the class of each byte, another the action of
(state, class). One pass yields code points, capitals, symbols and word spans; the spans are inserted into an open
hash table, and a span counts as known only after its bytes were compared with those of the slot's owner.
"""
from __future__ import annotations

from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bermline.llm.joins import KEYS_BOUND
from bermline.llm.text import mix, slices, spans
from bermline.session import cut_lineage

SYMBOLS = "#$%&*|"
SPACE, CONTINUATION, CAPITAL, SYMBOL, OTHER = range(5)
OPEN, CLOSE, POINT, UPPER, SIGN = 1, 2, 4, 8, 16  # actions, may be joined
LONG_WORD = 64  # bytes from which two words are compared one by one

_b = np.arange(256)
_CLASS = np.full(256, OTHER, np.uint8)
_CLASS[(_b == 32) | ((_b >= 9) & (_b <= 13))] = SPACE
_CLASS[(_b >= 0x80) & (_b < 0xC0)] = CONTINUATION
_CLASS[(_b >= 65) & (_b <= 90)] = CAPITAL
_CLASS[[ord(c) for c in SYMBOLS]] = SYMBOL
# state 0: outside a word, 1: inside; rows: state before the byte, columns: class of the byte
_NEXT = np.array([0, 1, 1, 1, 1], np.uint8)  # the same from both states
_ACTION = np.array([[POINT, OPEN, OPEN | POINT | UPPER, OPEN | POINT | SIGN, OPEN | POINT], [CLOSE | POINT, 0, POINT | UPPER, POINT | SIGN, POINT]], np.uint8)
_BYTES = mix(np.arange(900, 1156, dtype=np.uint64))


def _same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether data[a:a+length] equals data[b:b+length], for many pairs; ``data`` has eight spare bytes at its end."""
    same = np.ones(len(a), bool)
    eight = np.ndarray((max(len(data) - 7, 0),), "<u8", data, 0, (1,))
    for off in range(0, LONG_WORD, 8):
        at = np.flatnonzero(same & (length > off) & (length <= LONG_WORD))
        if not len(at):
            break
        left = np.minimum(length[at] - off, 8).astype(np.uint64)
        same[at] = ((eight[a[at] + off] ^ eight[b[at] + off]) << (np.uint64(64) - np.uint64(8) * left)) == 0
    for i in np.flatnonzero(length > LONG_WORD):
        same[i] = np.array_equal(data[a[i] : a[i] + length[i]], data[b[i] : b[i] + length[i]])
    return same


def distinct_words(data: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray, rows: int, hashes: np.ndarray | None = None) -> np.ndarray:
    """Number of different words in each row, by insertion of all spans into one hash table with linear probing.

    ``hashes`` may be any numbers that are equal for equal words: words of equal hash are told apart by their bytes.
    """
    n, length = len(start), end - start
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    h = spans(_BYTES[data], start, end) if hashes is None else hashes.astype(np.uint64)
    h = mix(h + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    slots = np.full(1 << max(2 * n, 2).bit_length(), -1, np.int64)
    last = np.int64(len(slots) - 1)
    slot, pending, new = (h & np.uint64(last)).astype(np.int64), np.arange(n), np.zeros(n, bool)
    while len(pending):
        free = pending[slots[slot[pending]] < 0]
        slots[slot[free]] = free  # of several writers one stays
        owner = slots[slot[pending]]
        new[pending[owner == pending]] = True
        known = (h[owner] == h[pending]) & (row[owner] == row[pending]) & (length[owner] == length[pending])
        check = np.flatnonzero(known & (owner != pending))
        known[check] = _same_bytes(padded, start[owner[check]], start[pending[check]], length[pending[check]])
        pending = pending[~known]
        slot[pending] = (slot[pending] + 1) & last
    return np.bincount(row[new], minlength=rows)


def transduce(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Counts of each row data[offsets[i]:offsets[i+1]]: words, distinct words, code points, capitals, symbols."""
    rows = len(offsets) - 1
    kind = _CLASS[data]
    before = np.zeros(len(data), np.uint8)
    before[1:] = _NEXT[kind[:-1]]
    starts = offsets[:-1][offsets[:-1] < offsets[1:]]
    before[starts] = 0  # each row starts outside a word
    action = _ACTION[before, kind]
    place = lambda flag: np.flatnonzero(action & flag)
    count = lambda at: np.diff(np.searchsorted(at, offsets))
    start = place(OPEN)
    ends = offsets[1:][offsets[:-1] < offsets[1:]]
    close = np.sort(np.concatenate([place(CLOSE), ends[_NEXT[kind[ends - 1]] == 1]]))  # a word ends at white space or with its row
    words = count(start)
    row = np.repeat(np.arange(rows), words)
    return {"n_words": words, "n_distinct": distinct_words(data, start, close, row, rows), "n_chars": count(place(POINT)),
            "n_capitals": count(place(UPPER)), "n_symbols": count(place(SIGN))}


COUNTS = ("n_words", "n_distinct", "n_chars", "n_capitals", "n_symbols")


def _measured(batches):
    for b in batches:
        parts = [transduce(data, offsets) for _, _, data, offsets in slices(b.column(b.num_columns - 1))]
        if parts:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *[pa.array(np.concatenate([p[c] for p in parts]).astype(np.int64)) for c in COUNTS]],
                                             names=[*b.schema.names[:-1], *COUNTS])


def measure_texts(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: all but the text) and the five counts of the whole text; null is empty.

    Input columns named like a count are replaced.
    """
    keep = [c for c in (keep if keep is not None else docs.columns) if c not in COUNTS and (keep is not None or c != text)]
    slim = docs.select(*keep, F.col(text).cast("string").alias("_measured"))
    return slim.mapInArrow(_measured, T.StructType([*slim.schema.fields[: len(keep)], *[T.StructField(c, T.LongType()) for c in COUNTS]]))


def text_keys(text: Column) -> list[Column]:
    """128 bits that tell whole texts apart; null is the empty text."""
    whole = F.coalesce(text.cast("string"), F.lit(""))
    return [F.xxhash64(whole).alias("_t1"), F.xxhash64(F.lit(1), whole).alias("_t2")]


def earlier_copies(keyed: DataFrame, out: str) -> DataFrame:
    """``keyed`` (``_id, _t1, _t2``, others pass) with boolean ``out``: a row with a smaller id has the same text.

    Rows that share an id are not earlier than each other; a null id is later than every other. Only texts that occur
    more than once are joined; up to a bound of them are broadcast, so that a text that fills a third of the rows moves
    none of them, and beyond it a hot text is split by the skew join.
    """
    firsts = cut_lineage(keyed.groupBy(F.col("_t1").alias("_f1"), F.col("_t2").alias("_f2")).agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n"))
    if firsts.limit(KEYS_BOUND + 1).count() <= KEYS_BOUND:
        firsts = F.broadcast(firsts)
    met = keyed.join(firsts, (F.col("_t1") == F.col("_f1")) & (F.col("_t2") == F.col("_f2")), "left")
    later = F.col("_first").isNotNull() & (F.col("_id").isNull() | (F.col("_id") > F.col("_first")))
    return met.withColumn(out, F.coalesce(later, F.lit(False))).drop("_f1", "_f2", "_first")


def filter_interactions(rows: DataFrame, filters: dict[str, Column], part: Column, good: Column, toxic: Column) -> DataFrame:
    """One row for each part, order of the filters and step: ``part, filter_order, step, kept, removed, redundant,
    unique_fails, good_lost, toxic_lost, shapley`` (counts of rows).

    ``filters`` maps a one-letter name to the condition under which a row fails (null: it does not). All orders of at
    most six filters are listed. Rows are first counted by part and set of failed filters, so everything after that
    works on at most 2**n rows a part. ``shapley`` is the sum of ``removed`` of the step's filter over all orders: a row
    that fails s filters falls to each of them in 1/s of the orders. Null parts are the empty string. Without rows the
    result is empty.
    """
    names = list(filters)
    if not names or len(names) > 6 or any(len(x) != 1 for x in names) or len(set(names)) < len(names):
        raise ValueError("one to six filters with different one-letter names")
    n, flag = len(names), lambda c: F.coalesce(c.cast("boolean"), F.lit(False))
    fails = sum((F.when(flag(c), 1 << i).otherwise(0) for i, c in enumerate(filters.values())), F.lit(0))
    sets = rows.select(F.coalesce(part.cast("string"), F.lit("")).alias("part"), fails.alias("_fails"), flag(good).alias("_good"), flag(toxic).alias("_toxic")).groupBy("part", "_fails").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if("_good").alias("_good"), F.count_if("_toxic").alias("_toxic"))
    bit = lambda at: F.call_function("shiftleft", F.lit(1), F.instr(F.lit("".join(names)), F.substring("filter_order", at, F.lit(1))) - 1)
    orders = F.split(F.lit(",".join("".join(p) for p in permutations(names))), ",")
    steps = sets.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
    before = F.aggregate(F.sequence(F.lit(1), F.lit(n)), F.lit(0), lambda a, j: a + F.when(j < F.col("step"), bit(j)).otherwise(0))
    steps = steps.withColumns({"_own": bit(F.col("step")), "_before": before})
    here, own, earlier = F.col("_fails"), F.col("_own"), F.col("_before")
    fails_own, fails_before = here.bitwiseAND(own) != 0, here.bitwiseAND(earlier) != 0
    total = lambda condition, c="_n": F.sum(F.when(condition, F.col(c)).otherwise(0)).cast("long")
    removed = fails_own & ~fails_before
    return steps.groupBy("part", "filter_order", "step").agg(
        total(~fails_own & ~fails_before).alias("kept"), total(removed).alias("removed"), total(fails_own & fails_before).alias("redundant"), total(here == own).alias("unique_fails"),
        total(removed, "_good").alias("good_lost"), total(removed, "_toxic").alias("toxic_lost"),
        F.sum(F.when(fails_own, F.col("_n") * F.call_function("div", F.lit(factorial(n)), F.bit_count("_fails"))).otherwise(0)).cast("long").alias("shapley"))


def audit_documents(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """The audit of five filters over whole texts: too short (A), too little variety (B), too many capitals (C), symbols
    (D), copy of an earlier text (E); ``labels`` has ``<id>, quality, toxic``.

    An id with several labels is good (toxic) if one of them says so; a row without label, or with a null id, is
    neither. Other columns of both tables are ignored, whatever their names.
    """
    told = labels.groupBy(F.col(id).alias("_label_id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("_good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("_bad"))
    slim = docs.select(F.col(id).alias("_id"), F.col(part).alias("_part"), *text_keys(F.col(text)), F.col(text).cast("string").alias("_text"))
    w = {c: F.col(c) for c in COUNTS}
    fails = {"A": w["n_words"] < 200, "B": 100 * w["n_distinct"] < 50 * w["n_words"], "C": 100 * w["n_capitals"] > 3 * w["n_chars"], "D": w["n_symbols"] > 0}
    judged = measure_texts(slim, "_text").select("_id", "_part", "_t1", "_t2", *[c.alias(f"_fails_{k}") for k, c in fails.items()])
    judged = cut_lineage(judged)  # a few narrow columns a text; read again for the first of each text
    rows = earlier_copies(judged, "_fails_E").join(told, F.col("_id") == F.col("_label_id"), "left")
    return filter_interactions(rows, {k: F.col(f"_fails_{k}") for k in "ABCDE"}, F.col("_part"), F.col("_good"), F.col("_bad"))
