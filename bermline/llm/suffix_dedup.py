"""Suffix-array dedup: bytes inside strings of ``size`` bytes that start in more than one place.

Suffixes are dealt to tasks by a sparse set of anchors. The anchor of a string of ``size`` bytes is its ``gram`` bytes
with the smallest hash (leftmost if it repeats), so equal strings have equal anchors at equal offsets, and the strings
that share an anchor in one place are a short segment of text. An anchor that occurs once has no repeated string. Where
all segments around an anchor are equal, their suffixes are equal too. Where they differ, the distinct segments meet in
a task and their suffixes are put in order by a deep-shallow sort: multikey quicksort by eight bytes at a time to a
shallow depth, then blind tries for the groups that still have a common prefix. Neighbours in this order with a common
prefix of ``size`` bytes are repeats.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bermline.llm.joins import KEYS_BOUND, split_by_keys
from bermline.llm.text import mix, rolling, signed, slices, spans
from bermline.session import cut_lineage

SIZE = 200  # bytes of a repeated string
GRAM = 32  # bytes of an anchor
SHALLOW = 32  # bytes that the multikey quicksort looks at
GROUP_BOUND = 20_000  # different segments around one anchor that one task sorts (some 6 MB); the rest is counted by window, see below
PIECE = 1 << 18  # positions that are hashed at once
WINDOWS = 1 << 18  # suffixes that are sorted at once

_BYTES = mix(np.arange(1300, 1556, dtype=np.uint64))
_HIGH, _LOW = np.uint64(0xFFFFFFFF00000000), np.uint64(0xFFFFFFFF)


# --- anchors

def segments(data: np.ndarray, offsets: np.ndarray, size: int = SIZE, gram: int = GRAM):
    """For the rows data[offsets[i]:offsets[i+1]]: row, first place in the row, number of strings, offset of the anchor
    from that place, hash of the anchor, hash of the segment. Every string of ``size`` bytes is in one segment."""
    found = []
    for x in range(0, max(len(data) - size + 1, 0), PIECE):
        part = data[x : x + PIECE + size - 1]
        values = _BYTES[part]
        h = rolling(values, gram)
        least = (h & _HIGH) | np.arange(len(h), dtype=np.uint64)
        reach, width = 1, size - gram + 1
        while 2 * reach <= width:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        if reach < width:
            least = np.minimum(least[: len(least) - (width - reach)], least[width - reach :])
        starts = np.arange(len(least))
        row = np.searchsorted(offsets, starts + x, "right") - 1
        fits = np.flatnonzero(starts + x + size <= offsets[row + 1])
        if not len(fits):
            continue
        row, anchor = row[fits], (least[fits] & _LOW).astype(np.int64)
        cut = np.flatnonzero((anchor[1:] != anchor[:-1]) | (fits[1:] != fits[:-1] + 1) | (row[1:] != row[:-1])) + 1
        a, b = np.concatenate([[0], cut]), np.concatenate([cut, [len(fits)]]) - 1
        first, last, s = fits[a], fits[b], anchor[a]
        whole = mix(spans(values, first, last + size, 1) + (s - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        found.append((row[a], first + x - offsets[row[a]], last - first + 1, s - first, h[s], whole))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.view(np.uint64), none.view(np.uint64)
    return tuple(np.concatenate(c) for c in zip(*found))


def _anchors(size: int, gram: int):
    def run(batches):
        for b in batches:
            for _, _, data, offsets in slices(b.column(0)):
                _, _, _, _, anchor, whole = segments(data, offsets, size, gram)
                yield pa.RecordBatch.from_arrays([pa.array(signed(anchor)), pa.array(signed(whole))], names=["_anchor", "_segment"])
    return run


def _places(size: int, gram: int):
    def run(batches):
        for b in batches:
            for r0, r1, data, offsets in slices(b.column(2)):
                row, first, n, shift, anchor, whole = segments(data, offsets, size, gram)
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(r0, r1 - r0).take(at), b.column(1).slice(r0, r1 - r0).take(at), pa.array(signed(anchor)), pa.array(signed(whole)),
                                                  pa.array(first.astype(np.int64)), pa.array(n.astype(np.int32)), pa.array(shift.astype(np.int32))],
                                                 names=["_t1", "_t2", "_anchor", "_segment", "_first", "_n", "_shift"])
    return run


# --- order of suffixes

def _word(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Eight bytes from each place, as numbers in the order of the bytes."""
    return np.ndarray((len(data) - 7,), ">u8", data, 0, (1,))[at].astype(np.uint64)


def _common(x: np.ndarray) -> np.ndarray:
    """Equal leading bytes, given the exclusive or of two words; x is not 0."""
    n = np.zeros(len(x), np.int64)
    for bits, step in ((32, 4), (16, 2), (8, 1)):
        low = x < (np.uint64(1) << np.uint64(64 - bits))
        n[low] += step
        x = np.where(low, x << np.uint64(bits), x)
    return n


def deep_shallow_sort(data: np.ndarray, start: np.ndarray, size: int, bucket: np.ndarray | None = None, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings data[start:start+size] (of buckets one after another), and the length of the prefix that
    each has in common with the one before it (0 at the start of a bucket). ``size`` is at least 8."""
    n = len(start)
    bucket = np.zeros(n, np.int64) if bucket is None else bucket
    data = np.concatenate([data, np.zeros(8, np.uint8)])
    offs = [*range(0, size - 7, 8)] + ([size - 8] if size % 8 else [])
    order = np.argsort(bucket, kind="stable")
    common = np.zeros(n, np.int64)

    def split(at, group, key):
        """Sort the places ``at`` by key inside their groups; the rows of the new order, and where a new key starts inside a group."""
        o = np.lexsort((key, group))
        order[at] = order[at[o]]
        inside = np.zeros(len(at), bool)
        inside[1:] = (group[1:] == group[:-1])
        k = key[o]
        return o, k, inside, inside & np.concatenate([[False], k[1:] != k[:-1]])

    def several(at, fresh):
        """Places in groups of two and more; ``fresh`` marks the first place of each group."""
        group = np.cumsum(fresh)
        many = np.bincount(group)[group] > 1
        return at[many], group[many]

    b = bucket[order]
    at, group = several(np.arange(n), np.concatenate([[True], b[1:] != b[:-1]])) if n else (np.arange(0), np.zeros(0, np.int64))
    done = 0
    for off in offs:  # multikey quicksort
        if off + 8 > shallow or not len(at):
            break
        _, k, inside, new = split(at, group, _word(data, start[order[at]] + off))
        x = np.flatnonzero(new)
        common[at[x]] = off + _common(k[x] ^ k[x - 1])
        at, group = several(at, new | ~inside)
        done = off + 8
    known = np.full(len(at), done)
    while len(at):  # blind tries: a string leaves the path of the first of its group at a depth and with a byte
        lead = np.concatenate([[True], group[1:] != group[:-1]])
        mine = start[order[at]]
        path = mine[np.flatnonzero(lead)][np.cumsum(lead) - 1]
        depth = np.full(len(at), size)
        open_ = np.flatnonzero(mine != path)
        for off in offs:
            look = open_[known[open_] < off + 8] if done < off + 8 else open_[:0]
            if not len(look):
                continue
            x = _word(data, mine[look] + off) ^ _word(data, path[look] + off)
            ends = x != 0
            depth[look[ends]] = off + _common(x[ends])
            open_ = open_[depth[open_] == size]
        away = depth < size
        byte, other = data[mine + np.minimum(depth, size - 1)].astype(np.int64), data[path + np.minimum(depth, size - 1)].astype(np.int64)
        middle = 256 * (size + 1)
        # before the path: branches of small depth first; behind it: branches of large depth first
        key = np.where(~away, middle, np.where(byte < other, depth * 256 + byte, 2 * middle - depth * 256 + byte))
        o, k, inside, new = split(at, group, key)
        d = depth[o]
        x = np.flatnonzero(new)
        common[at[x]] = np.minimum(d[x], d[x - 1])
        same = np.flatnonzero(inside & ~new & (k == middle))
        common[at[same]] = size
        rest = k != middle
        fresh = new | ~inside
        # a branch keeps its depth and byte in common; what equals the path is in its place
        kept, at_kept, depth_kept = np.flatnonzero(rest), at[rest], d[rest]
        ids = np.cumsum(fresh)[kept]
        many = np.bincount(ids)[ids] > 1 if len(ids) else np.zeros(0, bool)
        at, group, known = at_kept[many], ids[many], depth_kept[many] + 1
    return order, common


def repeated_starts(data: np.ndarray, offsets: np.ndarray, n: np.ndarray, shift: np.ndarray, group: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Segments and places in them whose string of ``size`` bytes stands in another segment of the group too."""
    reach = int(shift.max()) + 1 if len(shift) else 0
    blocks = max(1, -(-int(n.sum()) // WINDOWS))
    step = max(1, -(-reach // blocks))
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for d in range(0, reach, step):  # strings at equal offset from the anchor are compared
        lo, hi = np.maximum(shift - (d + step - 1), 0), np.minimum(shift - d, n - 1)
        count = np.maximum(hi - lo + 1, 0)
        row = np.repeat(np.arange(len(n)), count)
        place = lo[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        order, common = deep_shallow_sort(data, offsets[row] + place, size, group[row] * (reach + 1) + shift[row] - place)
        twin = common == size
        twin[:-1] |= twin[1:].copy()
        out.append((row[order[twin]], place[order[twin]]))
    row, place = (np.concatenate(x) for x in zip(*out))
    o = np.lexsort((place, row))
    return row[o], place[o]


def runs(row: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last place of the runs of consecutive places."""
    if not len(row):
        return row, place, place
    cut = np.flatnonzero((row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1)) + 1
    a, b = np.concatenate([[0], cut]), np.concatenate([cut, [len(row)]]) - 1
    return row[a], place[a], place[b]


def _sorted_groups(size: int):
    """Input, ordered by anchor: anchor, segment, number of strings, offset of the anchor, occurrences, bytes."""
    def solve(b: pa.RecordBatch):
        raw = b.column(5).cast(pa.large_binary())
        bounds = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
        data = np.frombuffer(raw.buffers()[2], np.uint8)
        anchor, n, shift, times = (np.asarray(b.column(i)) for i in (0, 2, 3, 4))
        n, shift = n.astype(np.int64), shift.astype(np.int64)
        group = np.cumsum(np.concatenate([[0], anchor[1:] != anchor[:-1]]))
        ends = np.concatenate([np.flatnonzero(group[1:] != group[:-1]) + 1, [len(group)]])
        a = 0
        while a < len(group):  # some groups at a time
            total = np.cumsum(n[a:])
            z = ends[max(np.searchsorted(ends, a, "right"), np.searchsorted(ends, a + np.searchsorted(total, WINDOWS, "right"), "right") - 1)]
            row, place = repeated_starts(data[bounds[a] : bounds[z]], bounds[a:z] - bounds[a], n[a:z], shift[a:z], group[a:z], size)
            r, lo, hi = runs(row, place)
            once = times[a:z][r] == 1
            many = np.flatnonzero(times[a:z] > 1)  # such a segment is repeated whole
            r, lo, hi = (np.concatenate([x[once], y]) for x, y in ((r, many), (lo, np.zeros(len(many), np.int64)), (hi, n[a:z][many] - 1)))
            at = pa.array(r + a)
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], names=["_anchor", "_segment", "_lo", "_hi"])
            a = z

    def run(batches):
        held = None
        for b in batches:
            if b.num_rows == 0:
                continue
            if held is not None:
                b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
            anchor = np.asarray(b.column(0))
            last = int(np.flatnonzero(anchor != anchor[-1])[-1]) + 1 if anchor[0] != anchor[-1] else 0
            if last:
                yield from solve(b.slice(0, last))
            held = b.slice(last)
        if held is not None:
            yield from solve(held)
    return run


def _cut_segments(size: int):
    """Input: text and its segments; one row a segment with its bytes."""
    def run(batches):
        for b in batches:
            for text, wanted in zip(b.column(0), b.column(1)):
                raw = text.as_py().encode("utf-8", "surrogatepass")
                rows = wanted.as_py()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s["_anchor"] for s in rows], pa.int64()), pa.array([s["_segment"] for s in rows], pa.int64()), pa.array([s["_n"] for s in rows], pa.int32()),
                     pa.array([s["_shift"] for s in rows], pa.int32()), pa.array([s["_times"] for s in rows], pa.int64()),
                     pa.array([raw[s["_first"] : s["_first"] + s["_n"] - 1 + size] for s in rows], pa.binary())], names=["_anchor", "_segment", "_n", "_shift", "_times", "_bytes"])
    return run


# --- removal

def cut_ranges(raw: bytes, ranges: list[tuple[int, int]], size: int) -> tuple[bytes, int]:
    """What is left without the strings that start in the given places (first and last), and the number of removed runs."""
    kept, done, n = [], 0, 0
    end = -1
    for lo, hi in sorted(ranges):
        if lo > end:
            if end >= 0:
                done = end
            kept.append(raw[done:lo])
            n += 1
        end = max(end, hi + size)
    return b"".join([*kept, raw[end:] if end >= 0 else raw]), n


def _removed(size: int, kept: int, names: list[str]):
    def run(batches):
        for b in batches:
            n_removed, n_spans, left = [], [], []
            for text, ranges in zip(b.column(kept), b.column(kept + 1)):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                rest, n = cut_ranges(raw, [(r["_lo"], r["_hi"]) for r in ranges.as_py() or []], size)
                n_removed.append(len(raw) - len(rest))
                n_spans.append(n)
                left.append(rest)
            yield pa.RecordBatch.from_arrays([*b.columns[:kept], pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(left, pa.binary())], names=names)
    return run


def _counted_windows(cut: DataFrame, size: int) -> DataFrame:
    """The same ranges for segments of crowded anchors: their strings, each with 128 bits of hash, are counted in a shuffle
    on these bits, which no anchor can crowd."""
    place = cut.select("_anchor", "_segment", "_shift", "_times", "_bytes", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_at"))
    string = F.substring("_bytes", F.col("_at") + 1, F.lit(size))
    place = place.select("_anchor", "_segment", "_at", (F.col("_shift") - F.col("_at")).alias("_d"), "_times", F.xxhash64(string).alias("_w1"), F.xxhash64(F.lit(1), string).alias("_w2"))
    key = ["_anchor", "_d", "_w1", "_w2"]
    twice = cut_lineage(place.groupBy(*key).agg(F.sum("_times").alias("_all")).filter("_all > 1").drop("_all"))
    return place.join(twice, key).select("_anchor", "_segment", F.col("_at").alias("_lo"), F.col("_at").alias("_hi"))


RESULT = ("n_bytes", "n_removed", "n_spans", "kept_bytes")


def remove_repeated_bytes(docs: DataFrame, size: int = SIZE, text: str = "text", keep: list[str] | None = None, gram: int = GRAM, group_bound: int = GROUP_BOUND) -> DataFrame:
    """The columns ``keep`` (default: all but the text) with ``n_bytes, n_removed, n_spans`` and ``kept_bytes`` (binary).

    A byte of the text's UTF-8 form goes if it is covered by a string of ``size`` bytes that also starts in any other
    place of the table, the same text included; strings never cross rows. All occurrences go, also the first; rows that
    repeat a text of ``size`` bytes or more lose it whole, and shorter texts lose nothing. ``n_spans`` counts the maximal
    removed runs. Null is the empty text. Results depend on the texts alone, so other columns may hold nulls and repeat;
    columns named like a result are replaced.

    Equal segments are merged before they are shuffled, so a passage in a third of all rows is one row a task. A task
    sorts at most ``group_bound`` different segments around one anchor; strings around a more crowded anchor are counted
    by their hashes. Texts are told apart by 128 bits. Texts are shuffled only where they give a segment or lose bytes.
    """
    if size < 8 or not 1 <= gram <= size:
        raise ValueError("size must be at least 8 and gram at most size")
    keep = [c for c in (keep if keep is not None else docs.columns) if c not in RESULT and (keep is not None or c != text)]
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    keyed = docs.select(*[F.col(c).alias(f"_keep_{i}") for i, c in enumerate(keep)], F.xxhash64(whole).alias("_t1"), F.xxhash64(F.lit(1), whole).alias("_t2"), whole.alias("_text"))
    kept = [f"_keep_{i}" for i in range(len(keep))]
    slim = keyed.select("_t1", "_t2", "_text").filter(F.octet_length("_text") >= size)
    anchors = slim.select("_text").mapInArrow(_anchors(size, gram), "_anchor long, _segment long")
    # written first, so that the join's own shuffle stands alone and AQE can split a hot anchor
    shared = cut_lineage(anchors.groupBy("_anchor").agg(F.count(F.lit(1)).alias("_c"), F.min("_segment").alias("_a"), F.max("_segment").alias("_z")).filter("_c > 1").select(
        "_anchor", (F.col("_a") != F.col("_z")).alias("_mixed")))
    places = slim.mapInArrow(_places(size, gram), "_t1 long, _t2 long, _anchor long, _segment long, _first long, _n int, _shift int")
    # a text and a place give the rest; keys without the anchor keep this grouping apart from the join, which AQE can then split
    place = ["_anchor", "_segment", "_n", "_shift", "_mixed"]
    marked = cut_lineage(places.join(shared, "_anchor").groupBy("_t1", "_t2", "_first").agg(F.count(F.lit(1)).alias("_rows"), *[F.max(c).alias(c) for c in place]))
    mixed = marked.filter("_mixed")
    # one place gives the bytes of a segment, however often it occurs
    chosen = mixed.groupBy("_anchor", "_segment").agg(F.sum("_rows").alias("_times"), F.min(F.struct("_t1", "_t2", "_first", "_n", "_shift")).alias("_at"))
    chosen = cut_lineage(chosen.select("_anchor", "_segment", "_times", "_at.*"))
    crowded = cut_lineage(chosen.groupBy("_anchor").agg(F.count(F.lit(1)).alias("_c")).filter(F.col("_c") > group_bound).select("_anchor"))
    by_text = chosen.groupBy("_t1", "_t2").agg(F.collect_list(F.struct("_anchor", "_segment", "_first", "_n", "_shift", "_times")).alias("_wanted"))
    by_text = cut_lineage(by_text)
    giving, _ = split_by_keys(slim, "_t1", by_text.select("_t1").distinct())
    giving = giving.groupBy("_t1", "_t2").agg(F.first("_text").alias("_text")).join(by_text, ["_t1", "_t2"]).select("_text", "_wanted")
    cut = giving.mapInArrow(_cut_segments(size), "_anchor long, _segment long, _n int, _shift int, _times long, _bytes binary")
    if crowded.limit(1).count():
        cut = cut_lineage(cut)
        dense, sparse = cut.join(crowded, "_anchor", "left_semi"), cut.join(crowded, "_anchor", "left_anti")
    else:
        dense, sparse = None, cut
    told = sparse.repartition("_anchor").sortWithinPartitions("_anchor", "_segment").mapInArrow(_sorted_groups(size), "_anchor long, _segment long, _lo int, _hi int")
    if dense is not None:
        told = told.unionByName(_counted_windows(dense, size))
    single = marked.filter("_rows = 1")  # texts in several rows go whole
    ranges = single.filter("NOT _mixed").select("_t1", "_t2", F.col("_first").alias("_lo"), (F.col("_first") + F.col("_n") - 1).alias("_hi")).unionByName(
        single.filter("_mixed").join(cut_lineage(told), ["_anchor", "_segment"]).select("_t1", "_t2", (F.col("_first") + F.col("_lo")).alias("_lo"), (F.col("_first") + F.col("_hi")).alias("_hi")))
    actions = cut_lineage(ranges.groupBy("_t1", "_t2").agg(F.collect_list(F.struct("_lo", "_hi")).alias("_ranges")))
    copied = cut_lineage(marked.filter("_rows > 1").select(F.col("_t1").alias("_c1"), F.col("_t2").alias("_c2")).distinct())
    if copied.limit(KEYS_BOUND + 1).count() <= KEYS_BOUND:
        copied = F.broadcast(copied)
    same = (F.col("_t1") == F.col("_c1")) & (F.col("_t2") == F.col("_c2"))
    n_bytes = F.octet_length("_text").cast("long").alias("n_bytes")
    whole_rows = keyed.select(*kept, "_t1", "_t2", n_bytes).join(copied, same, "left_semi").select(
        *kept, "n_bytes", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(b"").alias("kept_bytes"))
    single_rows = keyed.select(*kept, "_t1", "_t2", n_bytes, "_text").join(copied, same, "left_anti")
    touched, others = split_by_keys(single_rows, "_t1", actions.select("_t1").distinct())
    touched = touched.join(actions, ["_t1", "_t2"], "left").select(*kept, "n_bytes", "_text", "_ranges")
    fields = [*touched.schema.fields[: len(kept) + 1], T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_bytes", T.BinaryType())]
    out = touched.mapInArrow(_removed(size, len(kept) + 1, [f.name for f in fields]), T.StructType(fields)).unionByName(whole_rows)
    if others is not None:
        zero = F.lit(0).cast("long")
        out = out.unionByName(others.select(*kept, "n_bytes", zero.alias("n_removed"), zero.alias("n_spans"), F.encode("_text", "UTF-8").alias("kept_bytes")))
    return out.select(*[F.col(k).alias(c) for k, c in zip(kept, keep)], *RESULT)
