"""Areas as cells: quadtree covers of polygons, and row runs of buffered lines and of polygons.

No row holds a whole polygon. A cover has large cells that lie inside, and small boundary cells with the edges that pass
them and the parity of their corner, so a point is decided by the edges of one cell. A run is a stretch of neighbouring
cells of one row (``row, c0, c1``); an area costs one row for each cell row it touches, not one for each cell.
"""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from bermline.functions import geometry as G
from bermline.operators.cells import BROADCAST_COPIES, _stage, line_edges, short_edges, spread
from bermline.operators.graphs import components, joined_labels
from bermline.session import cut_lineage

OFFSET_X, OFFSET_Y = 0.41421356237309515, 0.7320508075688772  # shares of a cell: corners keep off round coordinates and off lines between them
MOST_EDGES = 64  # edges of one boundary cell; a polygon with a denser one is covered by smaller cells
FINER = 3  # halvings of the cell for such a polygon
RUN_BLOCK = 4096  # cells of a row that are merged together
RUN_ROWS = 128  # rows of a tile in which runs are labelled together


def _column(x: Column, size) -> Column:
    return F.floor(x / size - OFFSET_X)


def _line(y: Column, size) -> Column:
    return F.floor(y / size - OFFSET_Y)


def _halved(v: Column, k: Column) -> Column:
    return F.floor(v / F.pow(F.lit(2.0), k))


def ring_edges(polygons: DataFrame, polygon_id: str) -> DataFrame:
    """One row for each edge of each ring: ``_id, _ring, _edge, x0, y0, x1, y1``."""
    rings = polygons.select(F.col(polygon_id).alias("_id"), F.posexplode("parts").alias("_ring", "_pts"))
    e = rings.select("_id", "_ring", F.posexplode(G.edges(F.col("_pts"))).alias("_edge", "_e"))
    e = e.select("_id", "_ring", "_edge", *[F.col(f"_e.{c}").alias(c) for c in ("x0", "y0", "x1", "y1")])
    return e.filter("_id IS NOT NULL AND x0 IS NOT NULL AND y0 IS NOT NULL AND x1 IS NOT NULL AND y1 IS NOT NULL")


def _passed_cells(edges: DataFrame, size: float) -> DataFrame:
    """Cells that an edge passes (or nearly passes), with the whole edge as ``_whole``."""
    whole = F.struct("_ring", "_edge", "x0", "y0", "x1", "y1").alias("_whole")
    e = short_edges(edges.select("_id", whole, "x0", "y0", "x1", "y1"), 2 * size)
    span = lambda cell, a, b: F.explode(F.sequence(cell(F.least(a, b), size), cell(F.greatest(a, b), size)))
    e = e.withColumn("_x", span(_column, "x0", "x1")).withColumn("_y", span(_line, "y0", "y1"))
    middle = lambda c, offset: (F.col(c) + offset + 0.5) * size
    return e.filter(G.edge_distance(middle("_x", OFFSET_X), middle("_y", OFFSET_Y), F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")) <= 0.7072 * size).select("_id", "_x", "_y", "_whole")


def _cover(edges: DataFrame, passed: DataFrame, size: float, top: int) -> DataFrame:
    """Boundary cells (``_k`` 0) and inside cells of 2**_k cells a side."""
    boundary = passed.groupBy("_id", "_x", "_y").agg(F.collect_set("_whole").alias("_edges"))
    ancestors = boundary.select("_id", F.col("_x").alias("_bx"), F.col("_y").alias("_by"), F.explode(F.sequence(F.lit(0), F.lit(top))).alias("_k"))
    ancestors = cut_lineage(ancestors.select("_id", "_k", _halved(F.col("_bx"), F.col("_k")).alias("_x"), _halved(F.col("_by"), F.col("_k")).alias("_y")).distinct())
    quarter = lambda c: F.explode(F.array(2 * F.col(c), 2 * F.col(c) + 1))
    children = ancestors.filter("_k > 0").select("_id", (F.col("_k") - 1).alias("_k"), quarter("_x").alias("_x"), F.col("_y").alias("_py")).select(
        "_id", "_k", "_x", quarter("_py").alias("_y"))
    # a child that no edge passes lies inside or outside as a whole: the parity of its corner tells
    corner = lambda d, on_edge: d.select("_id", (F.col("_y") * F.pow(F.lit(2.0), "_k")).cast("long").alias("_row"), (F.col("_x") * F.pow(F.lit(2.0), "_k")).cast("long").alias("_at"),
                                         F.lit(0).alias("_n"), "_k", "_x", "_y", F.lit(on_edge).alias("_on_edge"))
    probes = corner(children.join(ancestors, ["_id", "_k", "_x", "_y"], "left_anti"), False).unionByName(corner(ancestors.filter("_k = 0"), True))
    level = lambda j: (j + OFFSET_Y) * size
    scan = edges.withColumn("_row", F.explode(F.sequence(_line(F.least("y0", "y1"), size), _line(F.greatest("y0", "y1"), size))))
    scan = scan.filter((F.col("y0") > level(F.col("_row"))) != (F.col("y1") > level(F.col("_row"))))
    cross = F.col("x0") + (level(F.col("_row")) - F.col("y0")) * (F.col("x1") - F.col("x0")) / (F.col("y1") - F.col("y0"))
    crossings = scan.select("_id", "_row", _column(cross, size).alias("_at")).groupBy("_id", "_row", "_at").agg(F.count(F.lit(1)).cast("int").alias("_n"))
    crossings = crossings.select("_id", "_row", "_at", "_n", *[F.lit(None).cast(t).alias(c) for c, t in (("_k", "int"), ("_x", "long"), ("_y", "long"), ("_on_edge", "boolean"))])
    # crossings of a column count for the corners behind it; a row of one polygon has at most two entries a column
    along = W.partitionBy("_id", "_row").orderBy("_at", F.col("_k").isNull()).rowsBetween(W.unboundedPreceding, W.currentRow)
    judged = probes.unionByName(crossings).withColumn("_inside", F.sum("_n").over(along) % 2 == 1).filter(F.col("_k").isNotNull() & (F.col("_on_edge") | F.col("_inside")))
    return judged.select("_id", "_k", "_x", "_y", "_inside", "_on_edge").join(boundary.withColumn("_on_edge", F.lit(True)), ["_id", "_x", "_y", "_on_edge"], "left").select(
        "_id", "_k", "_x", "_y", "_inside", "_edges")


def polygon_cover(polygons: DataFrame, size: float, polygon_id: str = "polygon_id") -> DataFrame:
    """Quadtree cover: ``_id, _base, _k, _x, _y, _inside, _edges``.

    A cell has side ``size * 2**(_base + _k)``. Without ``_edges`` it lies inside as a whole; with them (``_k`` 0) it is
    passed by these edges and ``_inside`` tells for its lower left corner. Even-odd rule over all rings of ``parts``.
    Polygons with a boundary cell of more than MOST_EDGES edges are covered by finer cells, so no row holds more than a
    cell's edges unless that many meet in a point. Ids are unique; polygons with a null id or without edges have no cells.
    """
    edges, base, out = cut_lineage(ring_edges(polygons, polygon_id)), 0, None
    box = edges.groupBy("_id").agg((F.max(F.greatest("x0", "x1")) - F.min(F.least("x0", "x1"))).alias("w"), (F.max(F.greatest("y0", "y1")) - F.min(F.least("y0", "y1"))).alias("h"))
    extent = box.agg(F.max(F.greatest("w", "h"))).first()[0] or 0.0
    while True:  # ends after nine rounds at most; cells of the top level are as large as the largest polygon
        side = size * 2.0**base
        top = 1
        while side * 2**top < extent:
            top += 1
        passed = cut_lineage(_passed_cells(edges, side))
        dense = cut_lineage(passed.groupBy("_id", "_x", "_y").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > MOST_EDGES).select("_id").distinct())
        last = base <= -8 * FINER or dense.isEmpty()
        done = edges if last else edges.join(dense, "_id", "left_anti")
        part = _cover(done, passed if last else passed.join(dense, "_id", "left_anti"), side, top).withColumn("_base", F.lit(base))
        out = part if out is None else out.unionByName(part)
        if last:
            return out.select("_id", "_base", "_k", "_x", "_y", "_inside", "_edges")
        edges, base = cut_lineage(edges.join(dense, "_id", "left_semi")), base - FINER


def _odd_from_corner(size: float) -> Column:
    """Whether a boundary cell's point lies inside: the corner's parity and the edges between corner and point, counted up
    the left side and then along the point's height. Both legs ask the same sign where they meet, so none is lost there."""
    side = size * F.pow(F.lit(2.0), F.col("_base"))
    a, b, px, py = (F.col("_x") + OFFSET_X) * side, (F.col("_y") + OFFSET_Y) * side, F.col("_px"), F.col("_py")

    def turn(e, y):  # a height counts as a little above what lies on it, as in the crossing test
        s = (e["x1"] - e["x0"]) * (y - e["y0"]) - (e["y1"] - e["y0"]) * (a - e["x0"])
        return (s > 0) | ((s == 0) & (e["x1"] > e["x0"]))

    def crossings(n, e):
        meet, corner = turn(e, py), turn(e, b)
        right, up = e["x1"] > e["x0"], e["y1"] > e["y0"]
        upward = ((e["x0"] > a) != (e["x1"] > a)) & ((meet == right) != (corner == right))
        at = (e["x1"] - e["x0"]) * (py - e["y0"]) / (e["y1"] - e["y0"]) + e["x0"]
        along = ((e["y0"] > py) != (e["y1"] > py)) & (meet == up) & ~(px < at)
        return n + upward.cast("int") + F.coalesce(along, F.lit(False)).cast("int")

    return (F.aggregate("_edges", F.col("_inside").cast("int"), crossings) % 2) == 1


def polygon_pairs(points: DataFrame, cover: DataFrame, size: float, x: str = "x", y: str = "y") -> DataFrame:
    """``points`` with the id ``_id`` of every polygon of ``cover`` they lie in; a point has a row for each level of the cover
    while it looks for its cell. Points without coordinates are in no polygon."""
    cover = cut_lineage(cover)
    levels = cover.select("_base", "_k").distinct().collect()  # a few dozen numbers
    if not levels:
        return points.join(cover.select("_id"), F.lit(False))
    spots = F.array(*[F.struct(F.lit(r["_base"]).alias("_pb"), F.lit(r["_k"]).alias("_pk")) for r in levels])
    p = points.withColumn("_px", F.col(x).cast("double")).withColumn("_py", F.col(y).cast("double")).filter("_px IS NOT NULL AND _py IS NOT NULL")
    p = p.withColumn("_spot", F.explode(spots)).select("*", "_spot.*").drop("_spot")
    side = size * F.pow(F.lit(2.0), F.col("_pb"))
    p = p.withColumn("_cx", _halved(_column(F.col("_px"), side), F.col("_pk"))).withColumn("_cy", _halved(_line(F.col("_py"), side), F.col("_pk")))
    weight = cover.select(F.sum(F.coalesce(F.size("_edges"), F.lit(0)) + 1)).first()[0] or 0
    c = F.broadcast(cover) if weight <= BROADCAST_COPIES else cover.hint("merge")
    met = (F.col("_pb") == F.col("_base")) & (F.col("_pk") == F.col("_k")) & (F.col("_cx") == F.col("_x")) & (F.col("_cy") == F.col("_y"))
    got = p.join(c, met & (F.col("_edges").isNull() | _odd_from_corner(size)))
    return got.drop("_px", "_py", "_pb", "_pk", "_cx", "_cy", "_base", "_k", "_x", "_y", "_inside", "_edges")


# ---- runs of cells ----------------------------------------------------------------------

def merge_runs(runs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Union of runs (``keys..., row, c0, c1``): no two results of a row touch, except where a block of cells ends."""
    keys = list(keys)
    b = runs.withColumn("_b", F.explode(F.sequence(F.floor(F.col("c0") / RUN_BLOCK), F.floor(F.col("c1") / RUN_BLOCK))))
    b = b.select(*keys, "row", "_b", F.greatest("c0", F.col("_b") * RUN_BLOCK).alias("c0"), F.least("c1", F.col("_b") * RUN_BLOCK + RUN_BLOCK - 1).alias("c1"))
    b = b.groupBy(*keys, "row", "_b", "c0").agg(F.max("c1").alias("c1"))  # at most RUN_BLOCK rows for the windows below
    w = W.partitionBy(*keys, "row", "_b").orderBy("c0")
    before = F.max("c1").over(w.rowsBetween(W.unboundedPreceding, -1))
    b = b.withColumn("_new", F.when(before.isNull() | (F.col("c0") > before + 1), 1).otherwise(0)).withColumn("_g", F.sum("_new").over(w))
    return b.groupBy(*keys, "row", "_b", "_g").agg(F.min("c0").alias("c0"), F.max("c1").alias("c1")).drop("_b", "_g")


def line_runs(lines: DataFrame, buffer: float, size: float, keep: Sequence[str] = ()) -> DataFrame:
    """Cells whose centre comes within ``buffer`` of a line (``pts``), as merged runs by ``keep``; row and column 0 start at 0."""
    keep = list(keep)
    e = short_edges(line_edges(spread(lines), keep).drop("edge", "len"), 256 * size)
    x0, y0, x1, y1, y = (F.col(c) for c in ("x0", "y0", "x1", "y1", "_y"))
    dx, dy, length = x1 - x0, y1 - y0, F.hypot(x1 - x0, y1 - y0)
    # all rows of an edge share its offsets; the steps of a row are told apart by `_stage`, or they would be written out many times
    e = e.withColumns({"_ox": F.when(dy != 0, -dy / length * buffer), "_oy": F.when(dy != 0, dx / length * buffer)})
    first = F.ceil((F.least("y0", "y1") - buffer) / size - 0.5)
    last = F.floor((F.greatest("y0", "y1") + buffer) / size - 0.5)
    e = e.filter(first <= last).withColumn("row", F.explode(F.sequence(first, last))).withColumn("_y", (F.col("row") + 0.5) * size)
    half = lambda cy: F.when(F.abs(y - cy) <= buffer, F.sqrt(F.greatest(F.lit(0.0), buffer * buffer - (y - cy) * (y - cy))))
    meets = lambda sign: F.when(dy != 0, (y - y0 - sign * F.col("_oy")) / dy)  # where the line beside the edge has that height
    e = _stage(e, _h0=half(y0), _h1=half(y1), _t=meets(1), _u=meets(-1))
    flank = lambda t, sign: F.when(F.col(t).between(0, 1), x0 + sign * F.col("_ox") + F.col(t) * dx)
    sides = [flank("_t", 1), flank("_u", -1)]
    e = _stage(e, _a=F.least(x0 - F.col("_h0"), x1 - F.col("_h1"), *sides), _z=F.greatest(x0 + F.col("_h0"), x1 + F.col("_h1"), *sides))
    e = _stage(e.select(*keep, "row", "_a", "_z"), c0=F.ceil(F.col("_a") / size - 0.5), c1=F.floor(F.col("_z") / size - 0.5))
    runs = e.select(*keep, "row", "c0", "c1").filter("c0 <= c1")
    return merge_runs(runs, keep)


def slab_reach(edges: DataFrame, buffer: float, rows: Column, slab) -> DataFrame:
    """A row for each edge and number ``row`` of ``rows`` whose slab ``(low, high) = slab(row)`` comes within ``buffer``: the
    x-range ``_a.._z`` that the buffered edge (a convex area) takes up in it."""
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    dx, dy, length = x1 - x0, y1 - y0, F.hypot(x1 - x0, y1 - y0)
    e = edges.withColumn("_ox", F.when(dy != 0, -dy / length * buffer)).withColumn("_oy", F.when(dy != 0, dx / length * buffer))
    low, high = slab(F.col("row"))
    e = _stage(e.withColumn("row", F.explode(rows)), _low=low, _high=high)
    away = lambda cy: F.greatest(F.col("_low") - cy, F.lit(0.0), cy - F.col("_high"))
    t = lambda sign, h: F.when(dy != 0, (F.col(h) - y0 - sign * F.col("_oy")) / dy)
    e = _stage(e, _d0=away(y0), _d1=away(y1), _t0=t(1, "_low"), _t1=t(1, "_high"), _u0=t(-1, "_low"), _u1=t(-1, "_high"))
    half = lambda d: F.when(F.col(d) <= buffer, F.sqrt(F.greatest(F.lit(0.0), buffer * buffer - F.col(d) * F.col(d))))

    def flank(sign, at, p, q):  # the line beside the edge at the heights it has in the slab
        inside = (F.least(p, q) <= 1) & (F.greatest(p, q) >= 0)
        return F.when(inside, x0 + sign * F.col("_ox") + F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(at))) * dx)

    e = _stage(e, _h0=half("_d0"), _h1=half("_d1"), _f0=flank(1, "_t0", "_t0", "_t1"), _f1=flank(1, "_t1", "_t0", "_t1"), _f2=flank(-1, "_u0", "_u0", "_u1"), _f3=flank(-1, "_u1", "_u0", "_u1"))
    sides = [F.col(f"_f{k}") for k in range(4)]
    e = _stage(e, _a=F.least(x0 - F.col("_h0"), x1 - F.col("_h1"), *sides), _z=F.greatest(x0 + F.col("_h0"), x1 + F.col("_h1"), *sides))
    return e.filter("_a IS NOT NULL")


def polygon_runs(polygons: DataFrame, size: float, polygon_id: str = "polygon_id") -> DataFrame:
    """Cells whose centre lies inside a polygon, as runs by ``polygon_id``: the heights of the centres cut the rings."""
    e = ring_edges(polygons, polygon_id)
    height = lambda r: (r + 0.5) * size
    first, last = F.floor(F.least("y0", "y1") / size - 0.5), F.ceil(F.greatest("y0", "y1") / size - 0.5)
    e = e.withColumn("row", F.explode(F.sequence(first, last)))
    e = e.filter((F.col("y0") > height(F.col("row"))) != (F.col("y1") > height(F.col("row"))))
    at = (F.col("x1") - F.col("x0")) * (height(F.col("row")) - F.col("y0")) / (F.col("y1") - F.col("y0")) + F.col("x0")
    # crossings left of a centre are those at or before it; equal columns cancel in pairs
    cuts = e.select("_id", "row", F.ceil(at / size - 0.5).alias("_c")).groupBy("_id", "row", "_c").agg((F.count(F.lit(1)) % 2).alias("_n")).filter("_n = 1")
    w = W.partitionBy("_id", "row").orderBy("_c")
    pairs = cuts.withColumn("_k", F.row_number().over(w)).withColumn("_next", F.lead("_c").over(w)).filter("_k % 2 = 1")
    return merge_runs(pairs.select("_id", "row", F.col("_c").alias("c0"), (F.col("_next") - 1).alias("c1")), ["_id"]).withColumnRenamed("_id", polygon_id)


def run_cells(runs: DataFrame) -> Column:
    return F.col("c1") - F.col("c0") + 1


def _tile_labels(runs: pd.DataFrame) -> pd.DataFrame:
    """Runs of one tile with ``_label``, the first ``_run`` of those that hang together inside the tile."""
    runs = runs.sort_values("_run").reset_index(drop=True)
    row, c0, c1, n = runs["row"].to_numpy(), runs["c0"].to_numpy() % RUN_BLOCK, runs["c1"].to_numpy() % RUN_BLOCK, len(runs)
    at = lambda r, c: r * RUN_BLOCK + c
    # runs of a row are in order and apart: those of the row before that a run meets stand together
    first, last = np.searchsorted(at(row, c1), at(row - 1, c0)), np.searchsorted(at(row, c0), at(row - 1, c1), side="right")
    met = np.maximum(last - first, 0)
    i = np.repeat(np.arange(n), met)
    j = np.arange(len(i)) - np.repeat(np.cumsum(met) - met, met) + np.repeat(first, met)
    runs["_label"] = runs["_run"].to_numpy()[joined_labels(n, i, j)]
    return runs[["row", "c0", "c1", "_run", "_label"]]


def dissolve_runs(runs: DataFrame) -> DataFrame:
    """Merged runs with ``piece``, the same for runs that touch along a side of a cell, directly or through others.

    Rows and columns lie within 2**30 of 0. Tiles of RUN_ROWS rows and one block of cells are labelled on their own, so only
    labels that meet at a tile's border form a graph. The planner takes runs for as small as the file of lines they come from
    and would broadcast them all, so the joins of runs ask for a shuffle.
    """
    r = merge_runs(runs).select("row", "c0", "c1", (F.col("row") * F.lit(2**31) + F.col("c0") + F.lit(2**30)).alias("_run"))
    r = r.groupBy(F.floor(F.col("row") / RUN_ROWS).alias("_tr"), F.floor(F.col("c0") / RUN_BLOCK).alias("_b"))
    r = cut_lineage(r.applyInPandas(_tile_labels, "row long, c0 long, c1 long, _run long, _label long"))
    rim = r.withColumn("_b", F.floor(F.col("c0") / RUN_BLOCK)).withColumn("_in", F.pmod("row", F.lit(RUN_ROWS)))
    above = rim.filter("_in = 0").select((F.col("row") - 1).alias("row"), "_b", F.col("c0").alias("_c0"), F.col("c1").alias("_c1"), F.col("_label").alias("b"))
    meet = rim.filter(F.col("_in") == RUN_ROWS - 1).join(above.hint("merge"), ["row", "_b"]).filter("c0 <= _c1 AND _c0 <= c1").select(F.col("_label").alias("a"), "b")
    starts = r.filter(F.pmod("c0", F.lit(RUN_BLOCK)) == 0).select("row", "c0", F.col("_label").alias("b"))
    ends = r.select("row", (F.col("c1") + 1).alias("c0"), F.col("_label").alias("a")).filter(F.pmod("c0", F.lit(RUN_BLOCK)) == 0)
    parts = components(meet.unionByName(ends.join(starts.hint("merge"), ["row", "c0"]).select("a", "b")).distinct())
    return r.join(parts, F.col("_label") == F.col("id"), "left").select("row", "c0", "c1", F.coalesce("component", "_label").alias("piece"))


def shared_cells(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Number of cells ``n`` of each key of ``left`` (merged runs by ``keys``) that are in ``right`` (merged runs)."""
    block = lambda d: d.withColumn("_b", F.floor(F.col("c0") / RUN_BLOCK))
    r = block(right).select("row", "_b", F.col("c0").alias("_c0"), F.col("c1").alias("_c1"))
    met = block(left).join(r, ["row", "_b"]).filter("c0 <= _c1 AND _c0 <= c1")
    return met.groupBy(*keys).agg(F.sum(F.least("c1", "_c1") - F.greatest("c0", "_c0") + 1).alias("n"))
