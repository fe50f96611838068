"""Binary morphology, components, thinning and centre lines on pixel sets ``(keys..., row, col)``."""
from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bermline.operators.cells import end_pairs, line_ends
from bermline.operators.graphs import components, joined_labels, list_order, matching_round, mutual_matching
from bermline.operators.ordered import null_safe_join
from bermline.operators.rasters import Grid, with_tiles
from bermline.session import cut_lineage, drop_cut

NEIGHBOURS = [(-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)]


def disk(radius: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if i * i + j * j <= radius * radius]


def _long(pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    return pixels.select(*keys, F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"))


def _spread(pixels: DataFrame, keys: Sequence[str], offsets: Sequence[tuple[int, int]]) -> DataFrame:
    o = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in offsets])
    d = pixels.select(*keys, "row", "col", F.explode(o).alias("_o"))
    return d.select(*keys, (F.col("row") + F.col("_o.i")).alias("row"), (F.col("col") + F.col("_o.j")).alias("col"))


def binary_closing(pixels: DataFrame, radius: int = 3, keys: Sequence[str] = (), nrows: int | None = None, ncols: int | None = None) -> DataFrame:
    """Dilation then erosion with a disk. With a raster size, the outside does not hinder the erosion.

    Erosion counts, for every cell, how many of its disk cells are set.
    """
    se = disk(radius)
    keys = list(keys)
    wide = _spread(_long(pixels, keys), keys, se).distinct()
    need = F.lit(len(se))
    if nrows is not None:
        inside = lambda r, c: r.between(0, nrows - 1) & c.between(0, ncols - 1)
        wide = wide.filter(inside(F.col("row"), F.col("col")))
        need = sum((F.when(inside(F.col("row") + i, F.col("col") + j), 1).otherwise(0) for i, j in se), F.lit(0))
    votes = _spread(wide, keys, se).groupBy(*keys, "row", "col").agg(F.count(F.lit(1)).alias("_n"))
    if nrows is not None:
        votes = votes.filter(inside(F.col("row"), F.col("col")))
    return votes.filter(F.col("_n") == need).drop("_n")


def pixel_degree(pixels: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Number of set 8-neighbours of every set pixel: votes of the neighbours, one aggregation, no join."""
    keys = list(keys)
    p = _long(pixels, keys)
    votes = _spread(p, keys, NEIGHBOURS).withColumn("_v", F.lit(1)).withColumn("_s", F.lit(0))
    own = p.withColumn("_v", F.lit(0)).withColumn("_s", F.lit(1))
    d = votes.unionByName(own).groupBy(*keys, "row", "col").agg(F.sum("_v").alias("degree"), F.max("_s").alias("_s"))
    return d.filter("_s = 1").drop("_s")


# ---- connected components ------------------------------------------------------------------

def _labels(group: np.ndarray, r: np.ndarray, c: np.ndarray, eight: bool) -> np.ndarray:
    """Index of the first pixel (row-major) of the component of each pixel, for the pixels of many groups at once.

    Neighbours are found in the sorted pixel codes.
    """
    w, h = int(c.max() - c.min()) + 3, int(r.max() - r.min()) + 3
    code = (group * h + (r - r.min() + 1)) * w + (c - c.min() + 1)
    order = np.argsort(code, kind="stable")
    s = code[order]
    ends = []
    for delta in (1, w, w - 1, w + 1) if eight else (1, w):
        at = np.searchsorted(s, s + delta)
        hit = np.flatnonzero((at < len(s)) & (s[np.minimum(at, len(s) - 1)] == s + delta))
        ends.append((hit, at[hit]))
    a, b = (np.concatenate(x) for x in zip(*ends))
    lab = joined_labels(len(s), a, b)
    out = np.empty(len(s), np.int64)
    out[order] = order[lab]
    return out


def connected_components(pixels: DataFrame, connectivity: int = 8, keys: Sequence[str] = (), tile: int = 128) -> DataFrame:
    """Add ``component`` = struct(row, col) of its first pixel (row-major).

    Tiles are labelled on their own (fixed number of pixels); labels that touch
    across tile borders form a graph over tile labels, which star contraction
    joins. Only border pixels take part in that graph.
    """
    keys = list(keys)
    p = _long(pixels, keys).distinct()
    p = p.withColumn("_tr", F.floor(F.col("row") / tile)).withColumn("_tc", F.floor(F.col("col") / tile))
    schema = T.StructType([*[p.schema[k] for k in keys], *[T.StructField(c, T.LongType()) for c in ("row", "col", "_lr", "_lc")]])

    def label(t: pa.Table, group: np.ndarray) -> pa.RecordBatch:
        r, c = np.asarray(t.column("row")), np.asarray(t.column("col"))
        i = _labels(group, r, c, connectivity == 8)
        flat = t.combine_chunks()
        return pa.RecordBatch.from_arrays([*(flat.column(k).chunk(0) for k in keys), pa.array(r), pa.array(c), pa.array(r[i]), pa.array(c[i])],
                                          names=[*keys, "row", "col", "_lr", "_lc"])

    def run(batches):
        """Whole tiles of each batch at once; the last tile waits for the rest of its pixels."""
        left = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = pa.concat_tables([left, t]) if left is not None else t
            if not t.num_rows:
                continue
            marks = np.zeros(t.num_rows, bool)
            for k in (*keys, "_tr", "_tc"):
                x = pd.factorize(t.column(k).to_pandas())[0]
                marks[1:] |= x[1:] != x[:-1]
            group = np.cumsum(marks)
            last = int(np.searchsorted(group, group[-1]))
            if last:
                yield label(t.slice(0, last), group[:last])
            left = t.slice(last)
        if left is not None and left.num_rows:
            yield label(left, np.zeros(left.num_rows, np.int64))

    order = [*keys, "_tr", "_tc"]
    lab = cut_lineage(p.select(*keys, "row", "col", "_tr", "_tc").repartition(*order).sortWithinPartitions(*order).mapInArrow(run, schema))
    me = F.struct(*keys, "_lr", "_lc")
    rim = lab.filter((F.col("row") % tile == 0) | (F.col("row") % tile == tile - 1) | (F.col("col") % tile == 0) | (F.col("col") % tile == tile - 1))
    steps = NEIGHBOURS if connectivity == 8 else [(-1, 0), (0, -1), (0, 1), (1, 0)]
    a = rim.select(*keys, "row", "col", me.alias("a"))
    o = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in steps if (i, j) > (0, 0)])
    b = rim.select(*keys, "row", "col", me.alias("b"), F.explode(o).alias("_o"))
    b = b.select(*keys, (F.col("row") + F.col("_o.i")).alias("row"), (F.col("col") + F.col("_o.j")).alias("col"), "b")
    links = a.join(b, [*keys, "row", "col"]).select("a", "b").filter("a <> b").distinct()
    links = cut_lineage(links)
    if links.isEmpty():
        return lab.select(*keys, "row", "col", F.struct(F.col("_lr").alias("row"), F.col("_lc").alias("col")).alias("component"))
    root = components(links)
    out = lab.withColumn("_me", me).join(root, F.col("_me") == F.col("id"), "left")
    first = F.coalesce(F.col("component"), F.col("_me"))
    return out.select(*keys, "row", "col", F.struct(first["_lr"].alias("row"), first["_lc"].alias("col")).alias("component"))


def remove_small(pixels: DataFrame, min_px: int = 50, keys: Sequence[str] = (), connectivity: int = 8) -> DataFrame:
    """Drop components of fewer than ``min_px`` pixels."""
    keys = list(keys)
    cc = connected_components(pixels, connectivity, keys)
    big = cc.groupBy(*keys, "component").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_px).drop("_n")
    return null_safe_join(cc, big, [*keys, "component"], "left_semi").drop("component")


def regions_by_value(pixels: DataFrame, values: Sequence | None = None, min_area: float | None = None, pixel_area: float = 1.0,
                     keys: Sequence[str] = ()) -> DataFrame:
    """4-connected regions of equal value: value, first cell, cell count, area and box."""
    keys = list(keys)
    p = pixels if values is None else pixels.filter(F.col("value").isin(list(values)))
    cc = connected_components(p.select(*keys, "value", "row", "col"), 4, [*keys, "value"])
    g = cc.groupBy(*keys, "value", "component").agg(
        F.count(F.lit(1)).alias("n_cells"), F.min("row").alias("row_min"), F.max("row").alias("row_max"), F.min("col").alias("col_min"), F.max("col").alias("col_max"))
    g = g.withColumn("area", F.col("n_cells") * pixel_area)
    return g if min_area is None else g.filter(F.col("area") >= min_area)


# ---- thinning ------------------------------------------------------------------------------

def thin_step(a: np.ndarray, second: bool) -> np.ndarray:
    """Pixels to delete in one sub-iteration of the Zhang-Suen rule (a: 0/1 with a margin of zeros)."""
    p = np.pad(a, 1)
    n = [p[:-2, 1:-1], p[:-2, 2:], p[1:-1, 2:], p[2:, 2:], p[2:, 1:-1], p[2:, :-2], p[1:-1, :-2], p[:-2, :-2]]
    total = sum(x.astype(np.int8) for x in n)
    turns = sum(((n[k] == 0) & (n[(k + 1) % 8] == 1)).astype(np.int8) for k in range(8))
    p2, p4, p6, p8 = n[0], n[2], n[4], n[6]
    c = ((p2 * p4 * p8 == 0) & (p2 * p6 * p8 == 0)) if second else ((p2 * p4 * p6 == 0) & (p4 * p6 * p8 == 0))
    return (a == 1) & (total >= 2) & (total <= 6) & (turns == 1) & c


def skeletonize(pixels: DataFrame, keys: Sequence[str] = (), tile: int = 256, steps: int = 16) -> DataFrame:
    """Thinning of the whole raster at once, tile by tile.

    A deletion depends on pixels one step away per sub-iteration, so a tile with
    a halo of 2*steps pixels can run ``steps`` iterations exactly; one shuffle
    then advances all tiles. Rounds repeat until an iteration deletes nothing.
    """
    keys = list(keys)
    halo = 2 * steps + 1
    cur = cut_lineage(_long(pixels, keys).distinct().withColumn("_ch", F.lit(True)))
    schema = cur.schema

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        tr, tc = int(pdf["tile_r"].iloc[0]), int(pdf["tile_c"].iloc[0])
        a = np.zeros((tile + 2 * halo, tile + 2 * halo), np.uint8)
        a[pdf["row"].to_numpy() - tr * tile + halo, pdf["col"].to_numpy() - tc * tile + halo] = 1
        core = (slice(halo, halo + tile), slice(halo, halo + tile))
        changed = False
        for _ in range(steps):
            changed = any_kill = False
            for second in (False, True):
                kill = thin_step(a, second)
                changed = changed or bool(kill[core].any())
                any_kill = any_kill or bool(kill.any())
                a[kill] = 0
            if not any_kill:  # neither half deleted anything, in the halo neither
                break
        r, c = np.nonzero(a[core])
        out = pd.DataFrame({k: [pdf[k].iloc[0]] * len(r) for k in keys})
        return out.assign(row=r + tr * tile, col=c + tc * tile, _ch=changed)[[f.name for f in schema.fields]]

    while True:  # every round but the last deletes a pixel
        last, cur = cur, cut_lineage(with_tiles(cur.drop("_ch"), tile, halo).groupBy(*keys, "tile_r", "tile_c").applyInPandas(run, schema))
        drop_cut(last)
        if cur.filter("_ch").isEmpty():
            break
    return cur.drop("_ch")


# ---- skeleton graph --------------------------------------------------------------------------

def skeleton_chains(skeleton: DataFrame, keys: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Contract a skeleton to its graph without gathering a component.

    Nodes are pixels of degree <> 2; a closed ring without nodes gets its first
    pixel as node. Directed pixel steps form linked lists that end at nodes and
    are ordered by pointer doubling.

    Returns ``(edges, steps)``: edges ``chain, a, b, length, n`` (one row per
    direction kept once, a and b structs (keys, row, col)) and steps
    ``chain, pos, row, col`` with the pixels of each chain in order from a to b.
    """
    keys = list(keys)
    deg = cut_lineage(pixel_degree(skeleton, keys))
    cc = connected_components(skeleton, 8, keys)
    info = null_safe_join(cc, deg, [*keys, "row", "col"])
    no_node = info.groupBy(*keys, "component").agg(F.count_if(F.col("degree") != 2).alias("_nodes"))
    info = null_safe_join(info, no_node, [*keys, "component"])
    first = (F.col("row") == F.col("component.row")) & (F.col("col") == F.col("component.col"))
    info = info.withColumn("node", (F.col("degree") != 2) | ((F.col("_nodes") == 0) & first))
    info = cut_lineage(info.select(F.struct(*keys, "row", "col").alias("px"), "component", "node"))
    o = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in NEIGHBOURS])
    shifted = lambda px, off: F.struct(*[px[k].alias(k) for k in keys], (px["row"] + off["i"]).alias("row"), (px["col"] + off["j"]).alias("col"))
    cand = info.select(F.col("px").alias("p"), F.col("node").alias("p_node"), "component", F.explode(o).alias("_o"))
    cand = cand.select("p", "p_node", "component", shifted(F.col("p"), F.col("_o")).alias("q"))
    half = cand.join(info.select(F.col("px").alias("q"), F.col("node").alias("q_node")), "q")
    # the successor of p->q at a chain pixel q is q->r with r <> p; it exists exactly once
    step = half.select(F.struct("p", "q").alias("id"), "p", "q", "p_node", "q_node", "component")
    step = cut_lineage(step)
    follow = step.filter("NOT p_node").select(F.col("p").alias("_q"), F.col("q").alias("_r"), F.col("id").alias("_next"))
    nxt = step.filter("NOT q_node").join(follow, F.col("q") == F.col("_q")).filter("_r <> p").select(F.col("id").alias("_id"), "_next")
    links = step.join(nxt, F.col("id") == F.col("_id"), "left").select("id", F.col("_next").alias("nxt"), F.hypot(
        (F.col("p.row") - F.col("q.row")).cast("double"), (F.col("p.col") - F.col("q.col")).cast("double")).alias("len"))
    pos = list_order(links, "len")
    full = step.join(pos, "id").withColumn("chain", F.col("last"))
    heads = full.filter("p_node").select("chain", F.col("p").alias("a"), F.col("last.q").alias("b"), F.col("total").alias("length"),
                                         (F.col("hops") + 1).alias("n"), F.struct("q", "p").alias("_back_last"), "component")
    # both directions of a chain exist: keep the one with the smaller (start, first step); reversed, it ends with the back step
    heads = heads.filter(F.struct("a", F.col("_back_last.q")) <= F.struct("b", F.col("chain.p")))
    heads = cut_lineage(heads.drop("_back_last"))
    kept = full.join(heads.select(F.col("chain").alias("_c"), F.col("n").alias("_n"), F.col("a").alias("_a")), F.col("chain") == F.col("_c"))
    pixels = kept.select("chain", (F.col("_n") - F.col("hops")).alias("pos"), F.col("q.row").alias("row"), F.col("q.col").alias("col"))
    start = heads.select("chain", F.lit(0).cast("long").alias("pos"), F.col("a.row").alias("row"), F.col("a.col").alias("col"))
    return heads, start.unionByName(pixels)


def _world(grid: Grid):
    return F.struct((grid.x0 + (F.col("col") + 0.5) * grid.res).alias("x"), (grid.y0 - (F.col("row") + 0.5) * grid.res).alias("y"))


def walk_edges(skeleton: DataFrame, grid: Grid, keys: Sequence[str] = ()) -> DataFrame:
    """One polyline per skeleton edge between nodes: ``keys..., a, b, length_px, pts``. A line's vertices are one row."""
    edges, steps = skeleton_chains(skeleton, keys)
    lines = steps.groupBy("chain").agg(F.sort_array(F.collect_list(F.struct("pos", _world(grid).alias("p")))).alias("_s"))
    lines = lines.select("chain", F.transform("_s", lambda v: v["p"]).alias("pts"))
    d = edges.join(lines, "chain")
    return d.select(*[F.col(f"a.{k}").alias(k) for k in keys], F.struct("a.row", "a.col").alias("a"), F.struct("b.row", "b.col").alias("b"),
                    F.col("length").alias("length_px"), "pts")


def _longest_paths(edge_list: list[tuple], min_len: float) -> list[list[tuple[int, int]]]:
    """Peel longest paths off a reduced graph: lists of (edge index, direction)."""
    best: dict[tuple, int] = {}
    for i, (a, b, w) in enumerate(edge_list):
        if a == b:
            continue
        k = (a, b) if a <= b else (b, a)
        if k not in best or w > edge_list[best[k]][2]:
            best[k] = i
    adj: dict = {}
    for i in best.values():
        a, b, _ = edge_list[i]
        adj.setdefault(a, {})[b] = i
        adj.setdefault(b, {})[a] = i

    def far(start):
        dist, back, heap = {start: 0.0}, {}, [(0.0, start)]
        while heap:
            d0, u = heapq.heappop(heap)
            if d0 > dist[u]:
                continue
            for v, i in adj.get(u, {}).items():
                nd = d0 + edge_list[i][2]
                if nd < dist.get(v, float("inf")):
                    dist[v], back[v] = nd, (u, i)
                    heapq.heappush(heap, (nd, v))
        end = max(dist, key=lambda v: (dist[v], v))
        return end, dist, back

    out, todo = [], sorted(adj)
    while todo:
        s = todo.pop()
        if not adj.get(s):
            continue
        a, _, _ = far(s)
        b, dist, back = far(a)
        if dist[b] < min_len:
            for v in dist:  # the rest of this piece is too short
                adj.pop(v, None)
            continue
        path, v = [], b
        while v != a:
            u, i = back[v]
            path.append((i, 0 if edge_list[i][0] == u else 1))
            adj[u].pop(v, None)
            adj[v].pop(u, None)
            v = u
        out.append(path[::-1])
        todo += sorted(dist)
    return out


def centrelines(skeleton: DataFrame, grid: Grid, min_length: float = 50.0, keys: Sequence[str] = ()) -> DataFrame:
    """Longest-path centre lines per component: ``keys..., component, path, length_m, pts``.

    The skeleton is contracted to its graph by Spark first; only node-to-node
    edges (no pixels) of a component meet in one task, where longest paths are
    peeled off. The pixels are then put back by a join. Closed chains are
    emitted as lines of their own.
    """
    keys = list(keys)
    edges, steps = skeleton_chains(skeleton, keys)
    min_px = min_length / grid.res
    loops = edges.filter(F.col("a") == F.col("b")).filter(F.col("length") >= min_px)
    open_ = edges.filter(F.col("a") != F.col("b"))
    text = lambda c: F.to_json(c)
    comp = F.struct(*[F.col(f"a.{k}").alias(k) for k in keys], "component")
    g = open_.select(text(comp).alias("g"), text(F.col("a")).alias("a"), text(F.col("b")).alias("b"), "length", text(F.col("chain")).alias("c"))

    def peel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("c").reset_index(drop=True)
        rows = []
        for n, path in enumerate(_longest_paths(list(zip(pdf["a"], pdf["b"], pdf["length"])), min_px)):
            for seq, (i, rev) in enumerate(path):
                rows.append((pdf["c"][i], n, seq, rev))
        return pd.DataFrame(rows, columns=["c", "path", "seq", "rev"])

    paths = g.groupBy("g").applyInPandas(peel, "c string, path int, seq int, rev int")
    named = edges.withColumn("c", text(F.col("chain")))
    use = named.join(paths, "c").select("chain", comp.alias("comp"), "path", "seq", "rev", "n", "length")
    ring = loops.withColumn("rn", F.dense_rank().over(_per_component(keys))).select(
        "chain", comp.alias("comp"), (-F.col("rn")).alias("path"), F.lit(0).alias("seq"), F.lit(0).alias("rev"), "n", "length")
    use = use.unionByName(ring)
    px = steps.join(use, "chain").withColumn("at", F.when(F.col("rev") == 1, F.col("n") - F.col("pos")).otherwise(F.col("pos")))
    px = px.filter((F.col("at") > 0) | (F.col("seq") == 0))
    lines = px.groupBy("comp", "path").agg(F.sort_array(F.collect_list(F.struct("seq", "at", _world(grid).alias("p")))).alias("_s"))
    length = use.groupBy(F.col("comp").alias("_comp"), F.col("path").alias("_path")).agg((F.sum("length") * grid.res).alias("length_m"))
    d = lines.join(length, (F.col("comp") == F.col("_comp")) & (F.col("path") == F.col("_path")))
    return d.select(*[F.col(f"comp.{k}").alias(k) for k in keys], F.col("comp.component").alias("component"), "path", "length_m",
                    F.transform("_s", lambda v: v["p"]).alias("pts"))


def _per_component(keys: Sequence[str]):
    from pyspark.sql.window import Window
    return Window.partitionBy(*[F.col(f"a.{k}") for k in keys], "component").orderBy("chain")


def _spur_pixels(a: np.ndarray, min_px: int) -> tuple[np.ndarray, np.ndarray]:
    """Pixels of the end branches of at most ``min_px`` pixels that meet a junction (a: 0/1 with a margin of zeros).

    All ends walk at once: a pixel of two neighbours leads on to the one the walk does not come from.
    """
    w = a.shape[1]
    flat = a.ravel()
    around = np.array([i * w + j for i, j in NEIGHBOURS])
    on = np.flatnonzero(flat)
    degree = np.zeros(flat.size, np.int8)
    degree[on] = flat[on[:, None] + around].sum(axis=1)
    end = on[degree[on] == 1]
    path = [end]
    back, at = np.full(len(end), -1), end
    walk = np.arange(len(end))  # the ends that still walk
    gone = []
    for _ in range(min_px):
        near = at[:, None] + around
        here, to = np.nonzero((flat[near] == 1) & (near != back[:, None]))
        back, at = at, near[here, to]  # exactly one way on: ends have one neighbour, inner pixels two
        met = degree[at] >= 3
        gone += [p[walk[met]] for p in path]
        on_way = degree[at] == 2
        walk, back, at = walk[on_way], back[on_way], at[on_way]
        if not len(walk):
            break
        step = np.full(len(end), -1)
        step[walk] = at
        path.append(step)
    g = np.unique(np.concatenate(gone)) if gone else np.zeros(0, np.int64)
    return np.unravel_index(g, a.shape)


def prune_spurs(skeleton: DataFrame, min_px: int = 5, keys: Sequence[str] = (), tile: int = 256, steps: int = 8) -> DataFrame:
    """Remove end branches of at most ``min_px`` pixels that meet a junction, until none is left.

    Of branches that meet at the same junction all are removed in the same round, as in a walk from every end. A removal
    depends on pixels at most min_px + 1 away, so a tile with a halo of ``steps`` times that runs ``steps`` rounds exactly,
    and one shuffle advances all tiles, as in ``skeletonize``.
    """
    keys = list(keys)
    halo = steps * (min_px + 1) + 1
    tile = max(tile, 2 * halo)
    cur = cut_lineage(_long(skeleton, keys).distinct())
    schema = cur.schema

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        tr, tc = int(pdf["tile_r"].iloc[0]), int(pdf["tile_c"].iloc[0])
        a = np.zeros((tile + 2 * halo + 2, tile + 2 * halo + 2), np.uint8)
        off = halo + 1
        a[pdf["row"].to_numpy() - tr * tile + off, pdf["col"].to_numpy() - tc * tile + off] = 1
        core = (slice(off, off + tile), slice(off, off + tile))
        for _ in range(steps):
            kill = _spur_pixels(a, min_px)
            if not len(kill[0]):
                break
            a[kill] = 0
        r, c = np.nonzero(a[core])
        out = pd.DataFrame({k: [pdf[k].iloc[0]] * len(r) for k in keys})
        return out.assign(row=r + tr * tile, col=c + tc * tile)[[f.name for f in schema.fields]]

    while True:  # every pass but the last removes a pixel
        n = cur.count()
        last, cur = cur, cut_lineage(with_tiles(cur, tile, halo).groupBy(*keys, "tile_r", "tile_c").applyInPandas(run, schema))
        drop_cut(last)
        if cur.count() == n:
            break
    return cur


def trace_greedy(skeleton: DataFrame, grid: Grid, max_gap_px: float = 3.0, min_px: int = 20, keys: Sequence[str] = ()) -> DataFrame:
    """Node-to-node lines of components with at least ``min_px`` pixels whose ends are joined over gaps of up to
    ``max_gap_px`` pixels, shortest first; every pixel is used and order along a line follows the skeleton."""
    keys = list(keys)
    big = remove_small(skeleton, min_px, keys)
    lines = walk_edges(big, grid, keys).withColumn("line_id", F.xxhash64(*keys, "a", "b", F.col("pts")[1]))
    return bridge_gaps(cut_lineage(lines.select("line_id", "pts")), max_gap_px * grid.res, 180.0)


# ---- joining lines ---------------------------------------------------------------------------

def _chain_lines(lines: DataFrame, partner: DataFrame, line_id: str = "line_id") -> DataFrame:
    """Join lines along end-to-end partners (a_id, a_port, b_id, b_port, each end at most once).

    Ports become the nodes of linked lists. Each list is walked from its smaller
    free end; a closed ring is opened at its smallest line. A file of lines is far
    smaller than its lines, so the joins ask for a shuffle, as in ``components``.
    """
    p = partner.select("a_id", "a_port", "b_id", "b_port")
    sym = p.unionByName(p.select(F.col("b_id").alias("a_id"), F.col("b_port").alias("a_port"), F.col("a_id").alias("b_id"), F.col("a_port").alias("b_port")))
    sym = cut_lineage(sym)
    ids = lines.select(F.col(line_id).alias("l"))
    cc = components(p.select(F.col("a_id").alias("a"), F.col("b_id").alias("b")))  # a line without partner is no ring
    n_l = cc.groupBy("component").agg(F.count(F.lit(1)).alias("_n"))
    n_p = p.join(cc.hint("merge"), F.col("a_id") == F.col("id")).groupBy("component").agg(F.count(F.lit(1)).alias("_e"))
    ring = n_l.join(n_p.hint("merge"), "component").filter("_n = _e").select(F.col("component").alias("_root"))
    # open rings: the smallest line loses the partner of its port 0
    cut = sym.join(ring.hint("merge"), F.col("a_id") == F.col("_root")).filter("a_port = 0")
    gone = cut.select("a_id", "a_port").unionByName(cut.select(F.col("b_id").alias("a_id"), F.col("b_port").alias("a_port")))
    sym = cut_lineage(sym.join(gone.hint("merge"), ["a_id", "a_port"], "left_anti"))
    # traversal state (line, entry port): leave by the other port, enter the partner
    state = ids.select("l", F.explode(F.array(F.lit(0), F.lit(1))).alias("inp"))
    state = state.join(sym.hint("merge"), (F.col("l") == F.col("a_id")) & (F.lit(1) - F.col("inp") == F.col("a_port")), "left")
    links = state.select(F.struct("l", "inp").alias("id"), F.when(F.col("b_id").isNotNull(), F.struct(F.col("b_id").alias("l"), F.col("b_port").alias("inp"))).alias("nxt"))
    pos = list_order(links)
    # a chain appears in both directions; keep the one that starts at the smaller free end
    free = state.join(sym.select(F.col("a_id").alias("_a"), F.col("a_port").alias("_p")).hint("merge"), (F.col("l") == F.col("_a")) & (F.col("inp") == F.col("_p")), "left_anti")
    start = free.select(F.struct("l", "inp").alias("id")).join(pos.hint("merge"), "id")
    start = start.filter(F.struct(F.col("id.l"), F.col("id.inp")) <= F.struct(F.col("last.l"), 1 - F.col("last.inp")))
    keep = start.select(F.col("last").alias("_last"), F.col("id.l").alias("chain_id"), F.col("hops").alias("_len"))
    m = pos.join(keep.hint("merge"), F.col("last") == F.col("_last")).select("chain_id", (F.col("_len") - F.col("hops")).alias("k"), F.col("id.l").alias("_l"), F.col("id.inp").alias("_inp"))
    d = m.join(lines.select(F.col(line_id).alias("_lid"), "pts").hint("merge"), F.col("_l") == F.col("_lid"))
    d = d.withColumn("pts", F.when(F.col("_inp") == 0, F.col("pts")).otherwise(F.reverse("pts")))
    out = d.groupBy("chain_id").agg(F.sort_array(F.collect_list(F.struct("k", "pts"))).alias("_s"), F.count(F.lit(1)).alias("n_lines"))
    return out.select(F.col("chain_id").alias(line_id), "n_lines", F.flatten(F.transform("_s", lambda v: v["pts"])).alias("pts"))


def bridge_gaps(lines: DataFrame, max_gap: float = 100.0, max_angle: float = 45.0, line_id: str = "line_id") -> DataFrame:
    """Reconnect lines whose ends are close and point at each other, shortest gap first.

    The pairs of crowded ends are many times the ends. So the first round of the matching reads them as they are made, and
    only pairs of the ends that it leaves over are written.
    """
    def pairs(ends):
        p = end_pairs(ends, max_gap, max_angle, line_id)
        return p.select(F.struct(F.col("a_id").alias("l"), F.col("a_port").alias("p")).alias("a"), F.struct(F.col("b_id").alias("l"), F.col("b_port").alias("p")).alias("b"), "gap")

    ends = cut_lineage(line_ends(lines, line_id))
    first = cut_lineage(matching_round(pairs(ends)))
    used = first.select(F.explode(F.array("a", "b")).alias("_e")).select(F.col("_e.l").alias(line_id), F.col("_e.p").alias("port"))
    rest = cut_lineage(ends.join(used.hint("merge"), [line_id, "port"], "left_anti"))
    drop_cut(ends)
    m = first.unionByName(mutual_matching(pairs(rest)))
    return _chain_lines(lines, m.select(F.col("a.l").alias("a_id"), F.col("a.p").alias("a_port"), F.col("b.l").alias("b_id"), F.col("b.p").alias("b_port")), line_id)


def merge_pseudonodes(lines: DataFrame, line_id: str = "line_id", places: int = 6, within: Sequence[str] = ()) -> DataFrame:
    """Merge lines that meet, two at a time, at a common end point; ``within`` names columns that both must have equal, so that
    the parts of one feature are not merged with another feature that happens to end at the same place."""
    within = list(within)
    p = F.col("pts")
    end = lambda port, e: F.struct(F.lit(port).alias("port"), F.round(e["x"], places).alias("x"), F.round(e["y"], places).alias("y"))
    ends = lines.select(*within, F.col(line_id).alias("l"), F.explode(F.array(end(0, F.element_at(p, 1)), end(1, F.element_at(p, -1)))).alias("_e")).select(*within, "l", "_e.*")
    two = ends.groupBy(*within, "x", "y").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("l", "port")).alias("a"), F.max(F.struct("l", "port")).alias("b")).filter("n = 2")
    two = two.filter(F.col("a.l") != F.col("b.l"))
    part = two.select(F.col("a.l").alias("a_id"), F.col("a.port").alias("a_port"), F.col("b.l").alias("b_id"), F.col("b.port").alias("b_port"))
    out = _chain_lines(lines, part, line_id)
    # the shared vertex appears twice at a joint
    from bermline.functions.geometry import without_repeats
    return out.withColumn("pts", without_repeats(F.col("pts")))
