"""N-gram Jaccard join: documents whose sets of word n-grams are alike, found by MinHash banding of fixed depth.

Every text gets ``TREES`` bands of k minimum hashes. Two texts of similarity s agree in some of l bands with probability
``1 - (1 - s**k)**l``; ``stop_depth`` gives the largest k up to ``MAX_DEPTH`` at which a pair at the threshold itself is
met with the target recall. That is the level at which an LSH forest that shortens its matches for this threshold would
be read, and the only one that is made. Texts that share a band (a node) are compared exactly, unless all their partners
there fall ``SLACK`` standard errors below the threshold by the estimate of all minima.

Pairs are never rows. A node with many texts is cut into blocks by hash, a task gets two blocks of one node, and
returns only counts and a spanning forest of the links. A pair that shares nodes of several trees is counted in the
first one. Texts with equal n-gram sets are one row throughout.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bermline.llm.text import list_values, lists, mix, rolling, signed, slices, spans, split_words
from bermline.operators.graphs import components
from bermline.session import cut_lineage

TREES, MAX_DEPTH, RECALL = 40, 8, 1 - 1e-9
BLOCK = 1024  # texts of one node that a task gets from one side
STRIP = 512  # rows of a block compared at once
SLACK = 7.0  # standard errors that an estimate may fall below the threshold


def stop_depth(threshold: float, trees: int = TREES, deepest: int = MAX_DEPTH, recall: float = RECALL) -> int:
    """Most hashes of a band at which a pair of this similarity meets in some band with the target recall."""
    for k in range(deepest, 1, -1):
        if 1 - (1 - threshold**k) ** trees >= recall:
            return k
    return 1


def gram_sets(words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of each row, sorted, and their numbers. A row of fewer words (not none) is one n-gram."""
    counts = words.counts
    at, h = words.starts_of(n), rolling(words.hash, n)
    row = words.row()[at]
    short = np.flatnonzero((counts > 0) & (counts < n))
    h = np.concatenate([h[at] if len(h) else h[:0], spans(words.hash, words.first[short], words.first[short + 1])])
    row = np.concatenate([row, short])
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], np.bincount(row[new], minlength=len(counts)).astype(np.int64)


def _seeds(n: int) -> np.ndarray:
    return mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)).reshape(2, n)


def _signatures(n: int, depth: int):
    """Per row with words: set hash (two longs), size, prefix of every tree, low bytes of all minima."""
    seeds = _seeds(TREES * depth)
    mul, add = (seeds[0] | np.uint64(1)).astype(np.uint32), seeds[1].astype(np.uint32)

    def run(batches):
        for b in batches:
            for r0, r1, data, offsets in slices(b.column(1)):
                g, sizes = gram_sets(split_words(data, offsets, alnum=True), n)
                rows = np.flatnonzero(sizes)
                if not len(rows):
                    continue
                first = np.concatenate([[0], np.cumsum(sizes[rows])[:-1]])
                low = (g >> np.uint64(16)).astype(np.uint32)
                minima = np.empty((len(rows), TREES * depth), np.uint32)
                for k in range(TREES * depth):
                    minima[:, k] = np.minimum.reduceat(low * mul[k] + add[k], first)
                label = minima.reshape(len(rows), TREES, depth).astype(np.uint64)
                prefix = np.zeros((len(rows), TREES), np.uint64)
                for k in range(depth):
                    prefix = mix(prefix + label[:, :, k] + np.uint64(k))
                sums = [np.add.reduceat(mix(g + np.uint64(s)), first) for s in (0, 1)]
                ids = b.column(0).slice(r0, r1 - r0).take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([
                    ids, pa.array(signed(sums[0])), pa.array(signed(sums[1])), pa.array(sizes[rows].astype(np.int32)),
                    lists(signed(prefix).ravel(), np.full(len(rows), TREES), pa.int64()),
                    pa.array([x.tobytes() for x in (minima >> np.uint32(8)).astype(np.uint8)], pa.binary())], names=["_id", "_s1", "_s2", "_size", "_prefixes", "_sketch"])
    return run


def _sets(n: int):
    def run(batches):
        for b in batches:
            for r0, r1, data, offsets in slices(b.column(1)):
                g, sizes = gram_sets(split_words(data, offsets, alnum=True), n)
                rows = np.flatnonzero(sizes)
                if len(rows):
                    first = np.concatenate([[0], np.cumsum(sizes[rows])[:-1]])
                    sums = [pa.array(signed(np.add.reduceat(mix(g + np.uint64(s)), first))) for s in (0, 1)]
                    ids = b.column(0).slice(r0, r1 - r0).take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays([ids, *sums, lists(signed(g), sizes[rows], pa.int64())], names=["_rep", "_s1", "_s2", "_grams"])
    return run


def _groups(batches, keys: int):
    """Tables of equal leading ``keys`` columns from batches sorted by them."""
    left = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = pa.concat_tables([left, t]) if left is not None else t
        if not t.num_rows:
            continue
        k = np.stack([np.asarray(t.column(i)) for i in range(keys)])
        cuts = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1).tolist(), t.num_rows]
        for a, z in zip(cuts[:-2], cuts[1:-1]):
            yield t.slice(a, z - a)
        left = t.slice(cuts[-2])
    if left is not None and left.num_rows:
        yield left


class _Node:
    """Texts of two blocks of a node, and which pairs of them this node decides."""

    def __init__(self, t: pa.Table, threshold: float):
        self.tree, self.within = t.column("_tree")[0].as_py(), t.column("_i")[0].as_py() == t.column("_j")[0].as_py()
        self.block, self.size = np.asarray(t.column("_block")), np.asarray(t.column("_size")).astype(np.float64)
        self.prefixes = list_values(t.column("_prefixes"))[0].reshape(-1, TREES)
        self.rep, self.threshold, self.n = np.asarray(t.column("_rep")), threshold, t.num_rows
        left = t.column("_i")[0].as_py()
        self.rows, self.cols = (np.arange(self.n),) * 2 if self.within else (np.flatnonzero(self.block == left), np.flatnonzero(self.block != left))

    def strips(self):
        """(rows, columns, decided here): pairs that meet in no earlier tree and whose sizes allow the similarity."""
        for a in range(0, len(self.rows), STRIP):
            r, c = self.rows[a : a + STRIP], self.cols
            ok = self.rep[r][:, None] < self.rep[c][None, :] if self.within else np.ones((len(r), len(c)), bool)
            for t in range(self.tree):
                ok &= self.prefixes[r, t][:, None] != self.prefixes[c, t][None, :]
            small, large = np.minimum(self.size[r][:, None], self.size[c]), np.maximum(self.size[r][:, None], self.size[c])
            yield r, c, ok & (small >= self.threshold * large - 1e-9)


def _owners(threshold: float, hashes: int):
    """Texts of a node that have a partner there by the estimate of all minima."""
    least = threshold - SLACK * np.sqrt(threshold * (1 - threshold) / hashes)

    def run(batches):
        for t in _groups(batches, 4):
            if t.num_rows < 2:
                continue
            node, keep = _Node(t, threshold), np.zeros(t.num_rows, bool)
            sketch = np.stack([np.frombuffer(x, np.uint8) for x in t.column("_sketch").to_pylist()])
            for r, c, ok in node.strips():
                i, j = np.nonzero(ok)
                for a in range(0, len(i), 1 << 16):
                    x, y = r[i[a : a + (1 << 16)]], c[j[a : a + (1 << 16)]]
                    hit = (sketch[x] == sketch[y]).mean(axis=1) >= least
                    keep[x[hit]] = True
                    keep[y[hit]] = True
            if keep.any():
                yield from t.drop_columns(["_sketch"]).filter(pa.array(keep)).combine_chunks().to_batches()
    return run


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Edges that keep ``n`` vertices connected as the given ones do."""
    root, out = list(range(n)), []

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x
    for x, y in zip(a.tolist(), b.tolist()):
        u, v = find(x), find(y)
        if u != v:
            root[max(u, v)] = min(u, v)
            out.append((x, y))
    return out


def _verify(threshold: float):
    """Exact similarity of the pairs a node decides: rows (text, linked documents, null) and forest edges (text, null, other)."""
    def run(batches):
        for t in _groups(batches, 4):
            if t.num_rows < 2:
                continue
            node = _Node(t, threshold)
            grams, first = list_values(t.column("_grams"))
            order, owner = np.argsort(grams, kind="stable"), np.repeat(np.arange(node.n), np.diff(first))
            token = np.empty(len(grams), np.int64)
            s = grams[order]
            token[order] = np.cumsum(np.concatenate([[0], (s[1:] != s[:-1]).astype(np.int64)]))
            copies = np.asarray(t.column("_copies"))
            links, edges = np.zeros(node.n, np.int64), []
            by_token = np.argsort(token, kind="stable")
            vocabulary = int(token.max()) + 1
            bounds = np.searchsorted(token[by_token], np.arange(0, vocabulary + 2048, 2048))
            for r, c, ok in node.strips():
                if not ok.any():
                    continue
                common = np.zeros((len(r), len(c)), np.float32)
                place = np.full((2, node.n), -1)
                place[0, r], place[1, c] = np.arange(len(r)), np.arange(len(c))
                for k in range(len(bounds) - 1):  # a few thousand n-grams at a time
                    part = by_token[bounds[k] : bounds[k + 1]]
                    width = min(2048, vocabulary - 2048 * k)
                    sides = []
                    for side, m in ((0, len(r)), (1, len(c))):
                        at = place[side, owner[part]]
                        x = np.zeros((m, width), np.float32)
                        x[at[at >= 0], token[part][at >= 0] - 2048 * k] = 1
                        sides.append(x)
                    common += sides[0] @ sides[1].T
                both = node.size[r][:, None] + node.size[c] - common
                i, j = np.nonzero(ok & (common >= threshold * both - 1e-6))
                np.add.at(links, r[i], copies[c[j]])
                np.add.at(links, c[j], copies[r[i]])
                edges += _forest(r[i], c[j], node.n)
            near = np.flatnonzero(links)
            if len(near):
                edges = _forest(*np.array(edges).T, node.n)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate([node.rep[near], node.rep[[x for x, _ in edges]]])),
                    pa.array([*links[near].tolist(), *[None] * len(edges)], pa.int64()),
                    pa.array([*[None] * len(near), *(int(node.rep[y]) for _, y in edges)], pa.int64())], names=["_rep", "_links", "_other"])
    return run


def near_duplicates(docs: DataFrame, n: int = 5, threshold: float = 0.8, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per id: ``<id>, class_id, n_links``.

    Two documents are linked if the Jaccard similarity of their sets of word ``n``-grams (lower-cased letters and
    digits) is at least ``threshold``; a text of fewer words is one n-gram. ``n_links`` counts the other documents
    linked to this one, ``class_id`` is the smallest id of its connected component. Null texts and texts without a word
    have no links and are their own class. Ids are whole numbers; rows with a null id are left out, and rows that
    repeat an id are one document with the text of the largest set hash. All other columns are ignored.
    """
    slim = docs.filter(F.col(id).isNotNull()).select(F.col(id).cast("long").alias("_id"), F.col(text).cast("string").alias("_text"))
    depth = stop_depth(threshold)
    sigs = slim.mapInArrow(_signatures(n, depth), "_id long, _s1 long, _s2 long, _size int, _prefixes array<long>, _sketch binary")
    # one text for an id, then one representative for all equal sets
    one = sigs.groupBy("_id").agg(F.max_by(F.struct("_s1", "_s2", "_size", "_prefixes", "_sketch"), F.struct("_s1", "_s2")).alias("v")).select("_id", "v.*")
    one = cut_lineage(one)
    reps = one.groupBy("_s1", "_s2").agg(F.min("_id").alias("_rep"), F.count(F.lit(1)).alias("_copies"), F.any_value("_size").alias("_size"),
                                         F.any_value("_prefixes").alias("_prefixes"), F.any_value("_sketch").alias("_sketch"))
    reps = cut_lineage(reps)
    nodes = reps.select("_rep", F.posexplode("_prefixes").alias("_tree", "_prefix"))
    many = nodes.groupBy("_tree", "_prefix").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    keyed = nodes.join(many, ["_tree", "_prefix"]).withColumn("_cut", F.ceil(F.col("_n") / BLOCK).cast("int"))
    keyed = keyed.withColumn("_block", F.pmod(F.xxhash64("_rep"), F.col("_cut")).cast("int"))
    met = keyed.select("_tree", "_prefix", "_block", "_rep", F.explode(F.sequence(F.lit(0), F.col("_cut") - 1)).alias("_k"))
    met = met.select("_tree", "_prefix", F.least("_block", "_k").alias("_i"), F.greatest("_block", "_k").alias("_j"), "_block", "_rep")
    group = ["_tree", "_prefix", "_i", "_j"]
    facing = met.join(reps.select("_rep", "_size", "_copies", "_prefixes", "_sketch"), "_rep").select(*group, "_block", "_rep", "_size", "_copies", "_prefixes", "_sketch")
    head = "_tree int, _prefix long, _i int, _j int, _block int, _rep long, _size int, _copies long, _prefixes array<long>"
    owned = facing.repartition(*group).sortWithinPartitions(*group).mapInArrow(_owners(threshold, TREES * depth), head)
    owned = cut_lineage(owned)
    wanted = owned.select("_rep").distinct()
    sets = slim.join(wanted, F.col("_id") == F.col("_rep"), "left_semi").mapInArrow(_sets(n), "_rep long, _s1 long, _s2 long, _grams array<long>")
    sets = sets.groupBy("_rep").agg(F.max_by("_grams", F.struct("_s1", "_s2")).alias("_grams"))
    found = (owned.join(sets, "_rep").select(*group, "_block", "_rep", "_size", "_copies", "_prefixes", "_grams").repartition(*group).sortWithinPartitions(*group)
             .mapInArrow(_verify(threshold), "_rep long, _links long, _other long"))
    found = cut_lineage(found)
    links = found.filter("_links IS NOT NULL").groupBy("_rep").agg(F.sum("_links").alias("_links"))
    parts = components(found.filter("_other IS NOT NULL").select(F.col("_rep").alias("a"), F.col("_other").alias("b")))
    classes = reps.select("_s1", "_s2", "_rep", "_copies").join(links, "_rep", "left").join(parts, F.col("_rep") == parts["id"], "left").select(
        "_s1", "_s2", F.coalesce("component", "_rep").alias("_class"), (F.coalesce("_links", F.lit(0)) + F.col("_copies") - 1).alias("_links"))
    known = one.select("_id", "_s1", "_s2").join(classes, ["_s1", "_s2"]).select("_id", "_class", "_links")
    every = slim.select("_id").distinct()
    return every.join(known, "_id", "left").select(F.col("_id").alias(id), F.coalesce("_class", "_id").alias("class_id"), F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"))
