"""Spatial joins as equi-joins on square cells.

One side keeps its own cell, the other is copied to every cell within the
search radius, and the exact test sits in the join condition. Each pair then
meets in exactly one cell. The copied side is counted up to a bound: a small one is
broadcast, so that the other side is not shuffled; a larger one is joined by a
shuffle on the cell key, where AQE splits a cell that holds a large share of the
rows. Results that do not need the pairs themselves
(flags, minima, best match) are reduced by an aggregation directly above the
join, which combines on the map side.
"""
from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from bermline.functions import geometry as G
from bermline.operators.ordered import null_safe_join
from bermline.session import cut_lineage

BROADCAST_COPIES = 50_000  # edges or points with a few columns: some megabytes
CELL_RADII = 6  # width of the cells of lines against lines
SPREAD_ROWS = 20_000  # lines or edges in one task before each becomes many cells or runs


def cell_keys(df: DataFrame, size: float, expand: float = 0.0, x: str = "x", y: str = "y") -> DataFrame:
    """Add cell columns ``cx, cy``; with ``expand`` one row per cell within that distance."""
    if expand <= 0:
        return df.withColumn("cx", F.floor(F.col(x) / size)).withColumn("cy", F.floor(F.col(y) / size))
    span = lambda c: F.explode(F.sequence(F.floor((F.col(c) - expand) / size), F.floor((F.col(c) + expand) / size)))
    return df.withColumn("cx", span(x)).withColumn("cy", span(y))


def line_edges(lines: DataFrame, keep: Sequence[str]) -> DataFrame:
    """One row per line edge: ``keep..., edge, x0, y0, x1, y1, len``."""
    e = lines.select(*keep, F.posexplode(G.edges(F.col("pts"))).alias("edge", "_e"))
    return e.select(*keep, "edge", *[F.col(f"_e.{c}").alias(c) for c in ("x0", "y0", "x1", "y1", "len")])


def short_edges(edges: DataFrame, longest: float) -> DataFrame:
    """Cut long edges, so that the bounding box of a piece covers few cells."""
    n = F.greatest(F.lit(1), F.ceil(F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) / longest)).cast("int")
    d = edges.withColumn("_n", n).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    a, b = F.col("_k") / F.col("_n"), (F.col("_k") + 1) / F.col("_n")
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    new = {"_a": F.col("x0") + a * dx, "_b": F.col("y0") + a * dy, "_c": F.col("x0") + b * dx, "_d": F.col("y0") + b * dy}
    return d.withColumns(new).drop("x0", "y0", "x1", "y1", "_n", "_k").withColumnsRenamed({"_a": "x0", "_b": "y0", "_c": "x1", "_d": "y1"})


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many tasks as the session shuffles to, and at most about SPREAD_ROWS rows in each.

    A file of lines is small, so few tasks read it; without this they alone would make all its cells.
    """
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return df.repartition(max(width, -(-df.count() // SPREAD_ROWS)))


def _stage(d: DataFrame, **cols: Column) -> DataFrame:
    """``d`` with more columns, made by an explode of one struct: a filter further on would else be moved before them, with
    all their terms written out."""
    s = F.struct(*[c.alias(n) for n, c in cols.items()])
    return d.withColumn("_s", F.explode(F.array(s))).select(*[c for c in d.columns if c not in cols], "_s.*")


def edge_cells(edges: DataFrame, size: float, expand: float = 0.0) -> DataFrame:
    """Copy each edge to the cells it comes within ``expand`` of."""
    lo = lambda a, b: F.floor((F.least(a, b) - expand) / size)
    hi = lambda a, b: F.floor((F.greatest(a, b) + expand) / size)
    d = edges.withColumn("cx", F.explode(F.sequence(lo(F.col("x0"), F.col("x1")), hi(F.col("x0"), F.col("x1")))))
    d = d.withColumn("cy", F.explode(F.sequence(lo(F.col("y0"), F.col("y1")), hi(F.col("y0"), F.col("y1")))))
    centre = G.edge_distance((F.col("cx") + 0.5) * size, (F.col("cy") + 0.5) * size,
                             F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    return d.filter(centre <= expand + size * 0.70711)


def _clash(left: DataFrame, right: DataFrame) -> None:
    both = set(left.columns) & set(right.columns)
    if both:
        raise ValueError(f"rename columns present on both sides: {sorted(both)}")


def _exploded(df: DataFrame) -> DataFrame:
    """Broadcast copies of at most BROADCAST_COPIES rows, else ask for a shuffle join.

    The planner estimates the size before the copies to cells are made, so it would broadcast tables that are many times
    larger than it believes; the rows are counted instead, and no further than the bound (one small job).
    """
    if df.limit(BROADCAST_COPIES + 1).count() <= BROADCAST_COPIES:
        return F.broadcast(df)
    return df.hint("merge")


def point_pairs(left: DataFrame, right: DataFrame, radius: float, r_min: float = 0.0,
                strict_min: bool = False) -> DataFrame:
    """All (left, right) points with ``r_min <= d <= radius``; right columns ``x, y`` come back as ``rx, ry``.

    Cells are two radii wide: a right point is copied to four cells on average, to nine with cells of one radius.
    """
    right = right.withColumnsRenamed({"x": "rx", "y": "ry"})
    _clash(left, right)
    a = cell_keys(left, 2 * radius)
    b = cell_keys(right, 2 * radius, radius, "rx", "ry").withColumnsRenamed({"cx": "_cx", "cy": "_cy"})
    d = F.hypot(F.col("x") - F.col("rx"), F.col("y") - F.col("ry"))
    box = (F.abs(F.col("x") - F.col("rx")) <= radius) & (F.abs(F.col("y") - F.col("ry")) <= radius)  # far cheaper than the distance
    cond = (F.col("cx") == F.col("_cx")) & (F.col("cy") == F.col("_cy")) & box & (d <= radius)
    if r_min > 0:
        cond = cond & ((d > r_min) if strict_min else (d >= r_min))
    return a.join(_exploded(b), cond).withColumn("d", d).drop("cx", "cy", "_cx", "_cy")


def point_line_pairs(points: DataFrame, lines: DataFrame, radius: float, keep: Sequence[str],
                     size: float | None = None) -> DataFrame:
    """All (point, edge) pairs within ``radius`` with the distance ``d``."""
    size = size or max(radius, 1e-9) * 2
    e = line_edges(lines, keep)
    _clash(points, e)
    a = cell_keys(points, size)
    b = edge_cells(e, size, radius).withColumnsRenamed({"cx": "_cx", "cy": "_cy"})
    d = G.edge_distance(F.col("x"), F.col("y"), F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    cond = (F.col("cx") == F.col("_cx")) & (F.col("cy") == F.col("_cy")) & (d <= radius)
    return a.join(_exploded(b), cond).withColumn("d", d).drop("cx", "cy", "_cx", "_cy")


# ---- lines against lines ---------------------------------------------------------

def _cross(ax, ay, bx, by, cx, cy) -> Column:
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def edges_distance(p: str = "", q: str = "q_") -> Column:
    """Distance of two edges given column prefixes; 0 when they cross or touch."""
    a = [F.col(f"{p}{c}") for c in ("x0", "y0", "x1", "y1")]
    b = [F.col(f"{q}{c}") for c in ("x0", "y0", "x1", "y1")]
    s1, s2 = _cross(*a, b[0], b[1]), _cross(*a, b[2], b[3])
    s3, s4 = _cross(*b, a[0], a[1]), _cross(*b, a[2], a[3])
    proper = (F.signum(s1) * F.signum(s2) < 0) & (F.signum(s3) * F.signum(s4) < 0)
    ends = F.least(G.edge_distance(a[0], a[1], *b), G.edge_distance(a[2], a[3], *b),
                   G.edge_distance(b[0], b[1], *a), G.edge_distance(b[2], b[3], *a))
    return F.when(proper, F.lit(0.0)).otherwise(ends)


def edges_boxes_near(radius: float, p: str = "", q: str = "q_") -> Column:
    """Whether the boxes of two edges come within ``radius`` along both axes: a cheap test before the distance."""
    slack = radius * (1 + 1e-9)
    lo, hi = lambda e, c: F.least(f"{e}{c}0", f"{e}{c}1"), lambda e, c: F.greatest(f"{e}{c}0", f"{e}{c}1")
    along = lambda c: (lo(p, c) <= hi(q, c) + slack) & (lo(q, c) <= hi(p, c) + slack)
    return along("x") & along("y")


def near_edges(pairs: DataFrame, radius: float, p: str = "", q: str = "q_") -> DataFrame:
    """Pairs of edges with ``edges_distance() <= radius``, told without a root or a division.

    The steps of the test are kept apart: as one condition it is so long that it is never compiled to machine code.
    """
    a, b = ([F.col(f"{e}{c}") for c in ("x0", "y0", "x1", "y1")] for e in (p, q))
    # of each end to the other edge: side (area with it), foot (place along it), of each edge: squared length
    along = lambda e, x, y: (x - e[0]) * (e[2] - e[0]) + (y - e[1]) * (e[3] - e[1])
    square = lambda x, y: x * x + y * y
    d = _stage(pairs, _s1=_cross(*a, b[0], b[1]), _s2=_cross(*a, b[2], b[3]), _s3=_cross(*b, a[0], a[1]), _s4=_cross(*b, a[2], a[3]),
               _l=square(a[2] - a[0], a[3] - a[1]), _q=square(b[2] - b[0], b[3] - b[1]))
    d = _stage(d, _f1=along(a, b[0], b[1]), _f2=along(a, b[2], b[3]), _f3=along(b, a[0], a[1]), _f4=along(b, a[2], a[3]),
               _e=F.least(*[square(a[i] - b[j], a[i + 1] - b[j + 1]) for i in (0, 2) for j in (0, 2)]))
    crossed = F.expr("signum(_s1) * signum(_s2) < 0 AND signum(_s3) * signum(_s4) < 0")
    far = math.nextafter(radius * radius, math.inf)  # its root is not more than the radius
    beside = lambda s, f, l: F.col(f).between(F.lit(0.0), F.col(l)) & (F.col(l) > 0) & (F.col(s) * F.col(s) <= far * F.col(l))
    return d.filter(crossed | (F.col("_e") <= far) | beside("_s1", "_f1", "_l") | beside("_s2", "_f2", "_l") | beside("_s3", "_f3", "_q") | beside("_s4", "_f4", "_q"))


def line_pairs(left: DataFrame, right: DataFrame, radius: float, size: float,
               left_id: str, right_id: str) -> DataFrame:
    """Distinct (left id, right id) of lines within ``radius`` of each other."""
    a = edge_cells(line_edges(left, [left_id]), size).drop("edge", "len")
    b = edge_cells(line_edges(right, [right_id]), size, radius).drop("edge", "len")
    b = b.withColumnsRenamed({c: f"q_{c}" for c in ("x0", "y0", "x1", "y1", "cx", "cy")})
    cond = (F.col("cx") == F.col("q_cx")) & (F.col("cy") == F.col("q_cy")) & edges_boxes_near(radius)
    return near_edges(a.join(_exploded(b), cond), radius).select(left_id, right_id).distinct()


def intersects_join(left: DataFrame, right: DataFrame, buffer: float = 0.0, size: float = 1000.0,
                    left_id: str = "left_id", right_id: str = "right_id") -> DataFrame:
    """Ids of boxes (``left``: xmin..ymax) and lines (``right``: pts) that meet within ``buffer``."""
    cells = left.select(left_id, "xmin", "ymin", "xmax", "ymax")
    span = lambda lo, hi: F.explode(F.sequence(F.floor((F.col(lo) - buffer) / size), F.floor((F.col(hi) + buffer) / size)))
    cells = cells.withColumn("cx", span("xmin", "xmax")).withColumn("cy", span("ymin", "ymax"))
    e = edge_cells(line_edges(spread(right), [right_id]), size).drop("edge", "len").withColumnsRenamed({"cx": "_cx", "cy": "_cy"})
    cond = (F.col("cx") == F.col("_cx")) & (F.col("cy") == F.col("_cy")) & box_edge_near(buffer)
    return cells.join(_exploded(e), cond).select(left_id, right_id).distinct()


def box_edge_distance(xmin="xmin", ymin="ymin", xmax="xmax", ymax="ymax") -> Column:
    """Distance of an axis-parallel box and an edge x0..y1; 0 when they overlap."""
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    b = [F.col(xmin), F.col(ymin), F.col(xmax), F.col(ymax)]
    dx, dy = x1 - x0, y1 - y0
    # share of the edge that lies inside the box (slab clipping)
    inv = lambda d: F.when(d != 0, 1.0 / d)
    # an edge parallel to a slab is inside it for every share or for none

    def shares(start, d, lo, hi):
        inside = start.between(lo, hi)
        return [F.coalesce((lo - start) * inv(d), F.when(inside, -1e300).otherwise(1e300)),
                F.coalesce((hi - start) * inv(d), F.lit(1e300))]

    tx, ty = shares(x0, dx, b[0], b[2]), shares(y0, dy, b[1], b[3])
    enter = F.greatest(F.least(*tx), F.least(*ty), F.lit(0.0))
    leave = F.least(F.greatest(*tx), F.greatest(*ty), F.lit(1.0))
    to_box = lambda x, y: F.hypot(F.greatest(b[0] - x, F.lit(0.0), x - b[2]), F.greatest(b[1] - y, F.lit(0.0), y - b[3]))
    corners = [G.edge_distance(cx, cy, x0, y0, x1, y1) for cx in (b[0], b[2]) for cy in (b[1], b[3])]
    return F.when(enter <= leave, F.lit(0.0)).otherwise(
        F.least(to_box(x0, y0), to_box(x1, y1), *corners))


def box_edge_near(buffer: float, xmin="xmin", ymin="ymin", xmax="xmax", ymax="ymax") -> Column:
    """Whether an axis-parallel box and an edge x0..y1 come within ``buffer``, as ``box_edge_distance() <= buffer``.

    Written so that every part is small: a condition of many thousand byte codes is never compiled to machine code.
    Boxes apart along an axis are told at once. Of the four corners only the one nearest to the edge's line can decide.
    """
    x0, y0, x1, y1, l, b, r, t = (F.col(c) for c in ("x0", "y0", "x1", "y1", xmin, ymin, xmax, ymax))
    dx, dy = x1 - x0, y1 - y0
    slack = buffer * (1 + 1e-9)
    met = (l <= F.greatest(x0, x1) + slack) & (r >= F.least(x0, x1) - slack) & (b <= F.greatest(y0, y1) + slack) & (t >= F.least(y0, y1) - slack)
    share = lambda d, start, up, down: F.when(d > 0, (up - start) / d).when(d < 0, (down - start) / d)
    enter = F.greatest(share(dx, x0, l, r), share(dy, y0, b, t), F.lit(0.0))  # an edge parallel to an axis has no share there
    leave = F.least(share(dx, x0, r, l), share(dy, y0, t, b), F.lit(1.0))
    overlap = (enter <= leave) & ((dx != 0) | x0.between(l, r)) & ((dy != 0) | y0.between(b, t))
    if buffer == 0:
        return met & overlap
    gap_of = lambda xa, xb, ya, yb: F.hypot(F.greatest(l - xb, F.lit(0.0), xa - r), F.greatest(b - yb, F.lit(0.0), ya - t)) <= buffer
    end = lambda x, y: gap_of(x, x, y, y)
    flat = gap_of(F.least(x0, x1), F.greatest(x0, x1), F.least(y0, y1), F.greatest(y0, y1))  # such an edge is a box itself
    w, h, mx, my = (r - l) / 2, (t - b) / 2, (l + r) / 2 - x0, (b + t) / 2 - y0
    side = dx * my - dy * mx
    gap = F.abs(side) - w * F.abs(dy) - h * F.abs(dx)
    foot = dx * mx + dy * my + F.signum(side) * (w * dx * F.signum(dy) - h * dy * F.signum(dx))
    corner = (gap <= buffer * F.hypot(dx, dy)) & foot.between(0, dx * dx + dy * dy)
    return met & F.when((dx == 0) | (dy == 0), flat).otherwise(overlap | end(x0, y0) | end(x1, y1) | corner)


# ---- the join family ----------------------------------------------------------------

def within_distance_best(left: DataFrame, right: DataFrame, radius: float = 500.0, by: str = "uparea",
                         tie: str = "comid", left_id: str = "segment_id") -> DataFrame:
    """Per left row (unique ``left_id``) the right row with the largest ``by`` within ``radius``; unmatched rows drop out.

    The winner is an aggregate of structs, so only one row per map task and
    left row is shuffled, not the pairs.
    """
    cols = [c for c in right.columns if c not in ("x", "y")]
    mine = [c for c in left.columns if c != left_id]
    pairs = point_pairs(left, right.select("x", "y", *cols), radius)
    rank = F.struct(F.col(by).alias("_by"), (-F.col(tie)).alias("_tie"))
    # the left row rides along, so the result needs no join back
    best = pairs.groupBy(left_id).agg(F.first(F.struct(*mine)).alias("_l"), F.max_by(F.struct(*cols), rank).alias("_m"))
    return best.select(left_id, *[F.col(f"_l.{c}").alias(c) for c in mine], *[F.col(f"_m.{c}").alias(c) for c in cols])


def nearest_join(left: DataFrame, right: DataFrame, right_id: str, start_radius: float | None = None) -> DataFrame:
    """Nearest right point for every left row (smallest id on ties): adds ``right_id, d``.

    Distinct left positions are searched in rounds of doubling radius; a match
    found within the radius is final, only the rest goes on. The rounds are few
    because the radius starts at the spacing of the right points and doubles until
    it spans the data.
    """
    refs = right.groupBy("x", "y").agg(F.min(right_id).alias(right_id))
    todo = left.select("x", "y").distinct()
    box = right.agg(F.min("x").alias("a"), F.max("x").alias("b"), F.min("y").alias("c"), F.max("y").alias("d"))
    left_box = left.agg(F.min("x").alias("a"), F.max("x").alias("b"), F.min("y").alias("c"), F.max("y").alias("d"))
    e = box.unionAll(left_box).agg(F.min("a"), F.max("b"), F.min("c"), F.max("d")).first()
    found, n = [], refs.count()
    if e[0] is not None and n:
        reach = ((e[1] - e[0]) ** 2 + (e[3] - e[2]) ** 2) ** 0.5
        # without a stated radius: about five right points are expected within it
        radius = start_radius or max((5 * (e[1] - e[0]) * (e[3] - e[2]) / (3.14 * n)) ** 0.5, reach / n, 1e-9)
        while True:  # the radius doubles until it spans the data
            pairs = point_pairs(todo, refs, radius)
            hit = cut_lineage(pairs.groupBy("x", "y").agg(F.min(F.struct("d", right_id)).alias("_m")))
            found.append(hit)
            if radius >= reach:
                break
            rest = cut_lineage(todo.join(hit, ["x", "y"], "left_anti"))
            if rest.isEmpty():
                break
            todo, radius = rest, radius * 2
    if not found:
        return left.withColumn(right_id, F.lit(None).cast(right.schema[right_id].dataType)).withColumn("d", F.lit(None).cast("double"))
    hits = found[0]
    for h in found[1:]:
        hits = hits.unionByName(h)
    hits = hits.select("x", "y", F.col(f"_m.{right_id}").alias(right_id), F.col("_m.d").alias("d"))
    return left.join(hits, ["x", "y"], "left")


def lines_within_best(left: DataFrame, right: DataFrame, radius: float = 500.0, by: str = "uparea", tie: str = "comid",
                      left_id: str = "segment_id") -> DataFrame:
    """As ``within_distance_best`` between lines (``pts``): the distance of two lines is that of their nearest edges.

    ``left_id`` and the columns of the chosen right line; unmatched lines drop out. A long segment meets a reach that its
    middle is far from. Only one row per map task and left line is shuffled behind the join. The side of fewer lines is
    copied to the cells within the radius, which are CELL_RADII wide: the rows of narrow cells take longer than more pairs.
    """
    cols = [c for c in right.columns if c != "pts"]
    size = max(CELL_RADII * radius, 1e-9)
    grow = (radius, 0.0) if left.count() <= right.count() else (0.0, radius)
    a = edge_cells(line_edges(spread(left), [left_id]), size, grow[0]).drop("edge", "len")
    b = edge_cells(line_edges(spread(right), cols), size, grow[1]).drop("edge", "len")
    b = b.withColumnsRenamed({c: f"q_{c}" for c in ("x0", "y0", "x1", "y1", "cx", "cy")})
    cond = (F.col("cx") == F.col("q_cx")) & (F.col("cy") == F.col("q_cy")) & edges_boxes_near(radius)
    rank = F.struct(F.col(by).alias("_by"), (-F.col(tie)).alias("_tie"))
    best = near_edges(a.join(_exploded(b), cond), radius).groupBy(left_id).agg(F.max_by(F.struct(*cols), rank).alias("_m"))
    return best.select(left_id, *[F.col(f"_m.{c}").alias(c) for c in cols])


def nearest_line_join(points: DataFrame, lines: DataFrame, line_id: str = "line_id", start_radius: float | None = None) -> DataFrame:
    """Nearest line for every point at any distance (smallest id on ties): adds ``line_id, d``; NULL only without lines.

    Distinct positions are searched in rounds of doubling radius, as in ``nearest_join``; a line found within the radius
    is final. Positions without coordinates get NULL.
    """
    todo = points.filter(F.col("x").isNotNull() & F.col("y").isNotNull()).select("x", "y").distinct()
    refs = lines.filter(F.size("pts") >= 2).select(line_id, "pts")
    e = refs.select(F.explode("pts").alias("p")).select("p.x", "p.y").unionAll(todo).agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    n, length = refs.agg(F.count(F.lit(1)), F.coalesce(F.sum(G.line_length(F.col("pts"))), F.lit(0.0))).first()
    found = []
    if n and e[0] is not None:
        reach = max(((e[1] - e[0]) ** 2 + (e[3] - e[2]) ** 2) ** 0.5, 1e-9)
        # without a stated radius: about five lines are expected within it, n * (pi * r * r + 2 * r * mean length) = 5 * area
        a = 5 * (e[1] - e[0]) * (e[3] - e[2])
        radius = start_radius or max(a / max(length + (length * length + 3.14 * n * a) ** 0.5, 1e-9), reach / n, 1e-9)
        while True:  # the radius doubles until it spans the data
            pairs = point_line_pairs(todo, refs, radius, [line_id])
            found.append(cut_lineage(pairs.groupBy("x", "y").agg(F.min(F.struct("d", line_id)).alias("_m"))))
            if radius >= reach:
                break
            todo = cut_lineage(todo.join(found[-1], ["x", "y"], "left_anti"))
            if todo.isEmpty():
                break
            radius *= 2
    if not found:
        return points.withColumn(line_id, F.lit(None).cast(lines.schema[line_id].dataType)).withColumn("d", F.lit(None).cast("double"))
    hits = found[0]
    for h in found[1:]:
        hits = hits.unionByName(h)
    return points.join(hits.select("x", "y", F.col(f"_m.{line_id}").alias(line_id), F.col("_m.d").alias("d")), ["x", "y"], "left")


def nearest_within(points: DataFrame, lines: DataFrame, radius: float, point_id: str = "id",
                   line_id: str = "line_id", how: str = "inner", distance_col: str = "d") -> DataFrame:
    """Nearest line within ``radius`` per point (unique ``point_id``); ``how='left'`` keeps the others with NULL."""
    best = F.min(F.struct("d", line_id)).alias("_m")
    chosen = [F.col(f"_m.{line_id}").alias(line_id), F.col("_m.d").alias(distance_col)]
    if how == "inner":
        # the point rides along, so the result needs no join back
        mine = [c for c in points.columns if c != point_id]
        pairs = point_line_pairs(points, lines.select(line_id, "pts"), radius, [line_id])
        got = pairs.groupBy(point_id).agg(F.first(F.struct(*mine)).alias("_l"), best)
        return got.select(point_id, *[F.col(f"_l.{c}").alias(c) for c in mine], *chosen)
    pairs = point_line_pairs(points.select(point_id, "x", "y"), lines.select(line_id, "pts"), radius, [line_id])
    got = pairs.groupBy(point_id).agg(best).select(F.col(point_id).alias("_id"), *chosen)
    return points.join(got, F.col(point_id) == F.col("_id"), how).drop("_id")


def assign_to_segments(points: DataFrame, segments: DataFrame, max_dist: float = 30.0,
                       point_id: str = "id", segment_id: str = "segment_id") -> DataFrame:
    """Nearest segment, only when it lies within ``max_dist``."""
    return nearest_within(points, segments, max_dist, point_id, segment_id)


def within_buffer_semi(points: DataFrame, lines: DataFrame, buffer: float = 30.0, point_id: str = "id",
                       flag: str | None = None) -> DataFrame:
    """Points within ``buffer`` of any line, or all points with a boolean ``flag`` column."""
    near = point_line_pairs(points.select(point_id, "x", "y"), lines.select("pts"), buffer, [])
    near = near.select(F.col(point_id).alias("_id")).distinct()
    if flag is None:
        return points.join(near, F.col(point_id) == F.col("_id"), "left_semi")
    return (points.join(near, F.col(point_id) == F.col("_id"), "left")
            .withColumn(flag, F.col("_id").isNotNull()).drop("_id"))


def exclude_near(points: DataFrame, lines: DataFrame, buffer: float = 100.0, point_id: str = "id") -> DataFrame:
    """Points that are not within ``buffer`` of any line."""
    near = point_line_pairs(points.select(point_id, "x", "y"), lines.select("pts"), buffer, [])
    near = near.select(F.col(point_id).alias("_id")).distinct()
    return points.join(near, F.col(point_id) == F.col("_id"), "left_anti")


def point_in_polygon(points: DataFrame, polygons: DataFrame, how: str = "left_semi", size: float = 1000.0,
                     polygon_id: str = "polygon_id", key: Sequence[str] | None = None) -> DataFrame:
    """Points inside polygons (even-odd rule over ``parts``), decided by the edges of one cell of a quadtree cover.

    ``how``: ``inner`` gives a row for each polygon a point lies in, with the polygon's other columns; ``left_semi`` and
    ``left_anti`` give points that lie in some or in none. For these two, ``key`` names columns that tell points apart;
    without it the points are written once with a number. Polygons need no id for them.
    """
    from bermline.operators.coverage import polygon_cover, polygon_pairs

    if how == "inner":
        met = polygon_pairs(points, polygon_cover(polygons.select(polygon_id, "parts"), size, polygon_id), size)
        more = [c for c in polygons.columns if c not in (polygon_id, "parts")]
        if not more:
            return met.withColumnRenamed("_id", polygon_id)
        return met.join(polygons.select(polygon_id, *more), F.col("_id") == F.col(polygon_id)).drop("_id")
    if polygon_id not in polygons.columns:
        polygons = polygons.select("parts").distinct().withColumn(polygon_id, F.xxhash64("parts"))
    if key is None:
        points, key = cut_lineage(points.withColumn("_point", F.monotonically_increasing_id())), ["_point"]
    cover = polygon_cover(polygons.select(polygon_id, "parts"), size, polygon_id)
    found = polygon_pairs(points.select(*key, "x", "y"), cover, size).select(*key).distinct()
    return points.join(found, list(key), how).drop("_point")


def crossing_share(p: str = "", q: str = "q_") -> Column:
    """Position on edge ``p`` where it properly crosses or touches edge ``q``, else NULL."""
    x0, y0, x1, y1 = (F.col(f"{p}{c}") for c in ("x0", "y0", "x1", "y1"))
    u0, v0, u1, v1 = (F.col(f"{q}{c}") for c in ("x0", "y0", "x1", "y1"))
    det = (x1 - x0) * (v1 - v0) - (y1 - y0) * (u1 - u0)
    t = ((u0 - x0) * (v1 - v0) - (v0 - y0) * (u1 - u0)) / F.nullif(det, F.lit(0.0))
    s = ((u0 - x0) * (y1 - y0) - (v0 - y0) * (x1 - x0)) / F.nullif(det, F.lit(0.0))
    return F.when(t.between(0, 1) & s.between(0, 1), t)


def _edge_meetings(a: DataFrame, b: DataFrame, size: float) -> DataFrame:
    a = edge_cells(a, size)
    b = edge_cells(b, size).drop("len").withColumnsRenamed(
        {c: f"q_{c}" for c in ("x0", "y0", "x1", "y1", "cx", "cy", "edge")})
    cond = (F.col("cx") == F.col("q_cx")) & (F.col("cy") == F.col("q_cy"))
    return a.join(_exploded(b), cond).withColumn("_t", crossing_share()).filter(F.col("_t").isNotNull())


def line_intersections(lines_a: DataFrame, lines_b: DataFrame, size: float = 1000.0,
                       a_id: str = "a_id", b_id: str = "b_id") -> DataFrame:
    """Distinct crossing points of two line sets (6 decimals)."""
    m = _edge_meetings(line_edges(lines_a, [a_id]), line_edges(lines_b, [b_id]), size)
    return m.select(a_id, b_id,
                    F.round(F.col("x0") + F.col("_t") * (F.col("x1") - F.col("x0")), 6).alias("x"),
                    F.round(F.col("y0") + F.col("_t") * (F.col("y1") - F.col("y0")), 6).alias("y")).distinct()


def clip_lines(lines: DataFrame, polygons: DataFrame, size: float = 1000.0, line_id: str = "line_id",
               polygon_id: str = "polygon_id") -> DataFrame:
    """Parts of lines inside polygons: edges are cut where they cross a ring and the pieces whose
    midpoint lies inside are kept. Returns ``line_id, polygon_id, edge, k, x0, y0, x1, y1, len``.

    The midpoints are looked up in a quadtree cover; an edge that no ring crosses is one piece for every polygon around it.
    """
    from bermline.operators.coverage import polygon_cover, polygon_pairs

    e = line_edges(lines, [line_id])
    rings = polygons.select(polygon_id, F.explode("parts").alias("pts"))
    cuts = _edge_meetings(e, line_edges(rings, [polygon_id]), size)
    cuts = cuts.groupBy(line_id, "edge", polygon_id, "x0", "y0", "x1", "y1").agg(F.collect_set("_t").alias("_ts"))  # crossings of one edge
    cuts = cut_lineage(cuts)
    ts = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0)), "_ts", F.array(F.lit(1.0)))))
    pieces = cuts.withColumn("_ts", ts).select(
        line_id, F.col(polygon_id).alias("_own"), "edge", "x0", "y0", "x1", "y1", F.posexplode(F.expr(
            "zip_with(slice(_ts, 1, size(_ts) - 1), slice(_ts, 2, size(_ts) - 1), (a, b) -> struct(a, b))")).alias("k", "_p"))
    whole = e.select(line_id, F.lit(None).cast(polygons.schema[polygon_id].dataType).alias("_own"), "edge", "x0", "y0", "x1", "y1",
                     F.lit(0).alias("k"), F.struct(F.lit(0.0).alias("a"), F.lit(1.0).alias("b")).alias("_p"))
    ax = lambda t: F.col("x0") + t * (F.col("x1") - F.col("x0"))
    ay = lambda t: F.col("y0") + t * (F.col("y1") - F.col("y0"))
    t0, t1 = F.col("_p.a"), F.col("_p.b")
    every = pieces.unionByName(whole).withColumn("_mx", ax((t0 + t1) / 2)).withColumn("_my", ay((t0 + t1) / 2))
    met = polygon_pairs(every, polygon_cover(polygons.select(polygon_id, "parts"), size, polygon_id), size, "_mx", "_my").withColumnRenamed("_id", polygon_id)
    cut = met.filter(F.col("_own") == F.col(polygon_id))
    uncut = null_safe_join(met.filter(F.col("_own").isNull()), cuts.select(line_id, "edge", polygon_id), [line_id, "edge", polygon_id], "left_anti")
    kept = cut.unionByName(uncut)
    out = kept.select(line_id, polygon_id, "edge", "k", ax(t0).alias("_a"), ay(t0).alias("_c"),
                      ax(t1).alias("_d"), ay(t1).alias("_f"))
    out = out.withColumnsRenamed({"_a": "x0", "_c": "y0", "_d": "x1", "_f": "y1"})
    return out.withColumn("len", F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))


def ring_join(points: DataFrame, refs: DataFrame, r_min: float = 50.0, r_max: float = 200.0) -> DataFrame:
    """Pairs with ``r_min <= d <= r_max``."""
    return point_pairs(points, refs, r_max, r_min)


def line_ends(lines: DataFrame, line_id: str = "line_id", k: int = 10) -> DataFrame:
    """Two rows per line: ``port`` 0/1, the end point and its outward direction over up to k vertices."""
    p = F.col("pts")
    n = F.size(p)
    kk = F.least(n - 1, F.lit(k))
    first, last = F.element_at(p, 1), F.element_at(p, -1)
    a, b = F.element_at(p, kk + 1), F.element_at(p, n - kk)
    end = lambda port, e, i: F.struct(F.lit(port).alias("port"), e["x"].alias("x"), e["y"].alias("y"),
                                      (e["x"] - i["x"]).alias("dx"), (e["y"] - i["y"]).alias("dy"))
    ends = lines.select(line_id, F.explode(F.array(end(0, first, a), end(1, last, b))).alias("_e"))
    return ends.select(line_id, *[F.col(f"_e.{c}").alias(c) for c in ("port", "x", "y", "dx", "dy")])


def endpoint_pairs(lines: DataFrame, max_gap: float = 100.0, max_angle: float = 45.0,
                   line_id: str = "line_id") -> DataFrame:
    """Ends of different lines within ``max_gap`` that point at each other: ``a_id, a_port, b_id, b_port, gap``."""
    return end_pairs(line_ends(lines, line_id), max_gap, max_angle, line_id)


def end_pairs(ends: DataFrame, max_gap: float, max_angle: float, line_id: str = "line_id") -> DataFrame:
    """``endpoint_pairs`` of given ``line_ends``."""
    a = ends.withColumnsRenamed({line_id: "a_id", "port": "a_port", "dx": "a_dx", "dy": "a_dy"})
    b = ends.withColumnsRenamed({line_id: "b_id", "port": "b_port", "dx": "b_dx", "dy": "b_dy"})
    pairs = point_pairs(a, b, max_gap).filter(F.col("a_id") < F.col("b_id"))
    gap = F.when(F.col("d") == 0, F.lit(1e-6)).otherwise(F.col("d"))
    ux, uy = (F.col("rx") - F.col("x")) / (gap + 1e-9), (F.col("ry") - F.col("y")) / (gap + 1e-9)
    unit = lambda x, y, c: F.col(c) / (F.hypot(F.col(x), F.col(y)) + 1e-9)
    ang = lambda dot: F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot))))
    ang_a = ang(unit("a_dx", "a_dy", "a_dx") * ux + unit("a_dx", "a_dy", "a_dy") * uy)
    ang_b = ang(-unit("b_dx", "b_dy", "b_dx") * ux - unit("b_dx", "b_dy", "b_dy") * uy)
    return (pairs.filter((ang_a <= max_angle) & (ang_b <= max_angle))
            .select("a_id", "a_port", "b_id", "b_port", gap.alias("gap")))


# ---- joins on keys -------------------------------------------------------------------

def attach_source(metadata: DataFrame, segments: DataFrame, positives: DataFrame,
                  negatives: DataFrame) -> DataFrame:
    """patch -> segment -> source for positives; negatives through their positive."""
    pos = positives.select("patch_id", "segment_id").join(
        segments.select("segment_id", "source_idx"), "segment_id", "left").select("patch_id", "source_idx")
    neg = negatives.select("patch_id", "source_positive_id").join(
        pos.withColumnsRenamed({"patch_id": "source_positive_id"}), "source_positive_id", "left"
    ).select("patch_id", "source_idx")
    return metadata.join(pos.unionByName(neg), "patch_id", "left")


def attach_split(results: DataFrame, metadata: DataFrame, keys: Sequence[str] = ("region", "patch_id")) -> DataFrame:
    """Attributes of a patch next to its results, keyed by region and patch."""
    return results.join(metadata, list(keys), "left")


def map_key(df: DataFrame, mapping: DataFrame, key: str, value: str, drop_missing: bool = True) -> DataFrame:
    """Look up ``value`` by ``key``."""
    m = mapping.select(F.col(key).alias("_k"), value)
    return df.join(m, F.col(key) == F.col("_k"), "inner" if drop_missing else "left").drop("_k")


def id_hits(ids: DataFrame, tables: dict[str, DataFrame], columns: dict[str, Sequence[str]], key: str = "id") -> DataFrame:
    """How many rows of each (table, column) hold one of the ids."""
    wanted = ids.select(F.col(key).cast("string").alias("_k")).distinct()
    out = None
    for name, df in tables.items():
        for c in columns[name]:
            hit = (df.select(F.col(c).cast("string").alias("_k")).join(wanted, "_k", "left_semi")
                   .agg(F.count(F.lit(1)).alias("hits"))
                   .select(F.lit(name).alias("table_name"), F.lit(c).alias("column_name"), "hits"))
            out = hit if out is None else out.unionAll(hit)
    return out


# ---- raster values at points ---------------------------------------------------------

def sample_bilinear(points: DataFrame, pixels: DataFrame, x0: float, y0: float, res: float,
                    nrows: int, ncols: int, point_id: str = "id", out: str = "value") -> DataFrame:
    """Bilinear value from the four nearest cell centres, weights renormalised over valid cells;
    NULL where the 2x2 block leaves the raster."""
    cf, rf = (F.col("x") - x0) / res - 0.5, (y0 - F.col("y")) / res - 0.5
    p = points.select(point_id, F.floor(cf).alias("_c"), F.floor(rf).alias("_r"),
                      (cf - F.floor(cf)).alias("_dc"), (rf - F.floor(rf)).alias("_dr"))
    p = p.filter((F.col("_c") >= 0) & (F.col("_r") >= 0) & (F.col("_c") + 1 < ncols) & (F.col("_r") + 1 < nrows))
    corner = lambda i, j: F.struct((F.col("_r") + i).alias("row"), (F.col("_c") + j).alias("col"),
                                   ((F.col("_dr") if i else 1 - F.col("_dr"))
                                    * (F.col("_dc") if j else 1 - F.col("_dc"))).alias("w"))
    n = p.select(point_id, F.explode(F.array(corner(0, 0), corner(0, 1), corner(1, 0), corner(1, 1))).alias("_n"))
    n = n.select(F.col(point_id).alias("_id"), F.col("_n.row").alias("row"), F.col("_n.col").alias("col"), F.col("_n.w").alias("w"))
    v = n.join(pixels.select("row", "col", F.col("value").alias("_v")), ["row", "col"]).filter(F.col("_v").isNotNull())
    s = v.groupBy("_id").agg((F.sum(F.col("w") * F.col("_v")) / F.nullif(F.sum("w"), F.lit(0.0))).alias(out))
    return points.join(s, F.col(point_id) == F.col("_id"), "left").drop("_id")


def sample_nearest(points: DataFrame, pixels: DataFrame, x0: float, y0: float, res: float,
                   out: str = "value") -> DataFrame:
    """Value of the cell whose index is nearest (ties to even), NULL outside."""
    p = points.withColumn("_c", F.bround((F.col("x") - x0) / res, 0).cast("long"))
    p = p.withColumn("_r", F.bround((y0 - F.col("y")) / res, 0).cast("long"))
    px = pixels.select(F.col("row").alias("_pr"), F.col("col").alias("_pc"), F.col("value").alias(out))
    return p.join(px, (F.col("_r") == F.col("_pr")) & (F.col("_c") == F.col("_pc")), "left").drop("_c", "_r", "_pr", "_pc")


def sample_window(points: DataFrame, pixels: DataFrame, x0: float, y0: float, res: float, nrows: int, ncols: int,
                  radius: float = 5.0, stat: str = "max", point_id: str = "id", out: str = "value") -> DataFrame:
    """Max or median of the window of ``radius`` around a point; NULL where the window leaves the raster."""
    r = max(1, round(radius / res))
    # int() of a pixel position truncates toward zero
    px, py = ((F.col("x") - x0) / res).cast("long"), ((y0 - F.col("y")) / res).cast("long")
    p = points.select(F.col(point_id).alias("_id"), px.alias("_c"), py.alias("_r"))
    p = p.filter((F.col("_c") >= r) & (F.col("_r") >= r) & (F.col("_c") + r < ncols) & (F.col("_r") + r < nrows))
    offs = F.sequence(F.lit(-r), F.lit(r))
    n = p.select("_id", "_r", "_c", F.explode(offs).alias("_i")).select("_id", "_r", "_c", "_i", F.explode(offs).alias("_j"))
    n = n.select("_id", (F.col("_r") + F.col("_i")).alias("row"), (F.col("_c") + F.col("_j")).alias("col"))
    v = n.join(pixels.select("row", "col", F.col("value").alias("_v")).filter(F.abs("_v") <= 1e10), ["row", "col"])
    agg = F.max("_v") if stat == "max" else F.percentile("_v", 0.5)  # window cells: (2r+1)^2 at most
    s = v.groupBy("_id").agg(agg.alias(out))
    return points.join(s, F.col(point_id) == F.col("_id"), "left").drop("_id")


def sample_on_axis(points: DataFrame, lines: DataFrame, pixels: DataFrame, x0: float, y0: float, res: float,
                   nrows: int, ncols: int, max_dist: float, radius: float = 5.0, stat: str = "max",
                   point_id: str = "id", out: str = "value") -> DataFrame:
    """The window value at the closest point on the nearest line."""
    pairs = point_line_pairs(points.select(point_id, "x", "y"), lines.select("pts"), max_dist, [])
    t = G.foot_share(F.col("x"), F.col("y"), F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    foot = F.struct(F.col("d"), (F.col("x0") + t * (F.col("x1") - F.col("x0"))).alias("fx"),
                    (F.col("y0") + t * (F.col("y1") - F.col("y0"))).alias("fy"))
    f = pairs.groupBy(point_id).agg(F.min(foot).alias("_f"))
    f = f.select(F.col(point_id).alias("_pid"), F.col("_f.fx").alias("x"), F.col("_f.fy").alias("y"))
    v = sample_window(f, pixels, x0, y0, res, nrows, ncols, radius, stat, "_pid", out)
    return points.join(v.select("_pid", out), F.col(point_id) == F.col("_pid"), "left").drop("_pid")


def coverage_share(footprints: DataFrame, aoi: DataFrame, cell: float, id_col: str = "scene_id") -> DataFrame:
    """Share of AOI cells whose centre lies in each footprint polygon; both areas are runs of cells, never single cells."""
    from bermline.operators.coverage import merge_runs, polygon_runs, shared_cells

    areas = aoi.select("parts").distinct().withColumn("_aoi", F.xxhash64("parts"))
    a = cut_lineage(merge_runs(polygon_runs(areas, cell, "_aoi").select("row", "c0", "c1")))
    total = a.agg(F.coalesce(F.sum(F.col("c1") - F.col("c0") + 1), F.lit(0)).alias("_n"))
    hit = shared_cells(polygon_runs(footprints.select(id_col, "parts"), cell, id_col), a, [id_col]).withColumnRenamed("n", "cells")
    out = footprints.select(id_col).join(hit, id_col, "left").crossJoin(total)  # one row of totals
    return out.select(id_col, F.coalesce("cells", F.lit(0)).alias("cells"),
                      (F.coalesce("cells", F.lit(0)) / F.col("_n")).alias("share"))


def windows_with_line(lines: DataFrame, size: float, raster_bounds: tuple[float, float, float, float],
                      candidates: int | None = None, line_id: str = "line_id", limit: int | None = None) -> DataFrame:
    """Square windows around line middles that meet a line and overlap the raster; rounded-key distinct.

    ``limit`` keeps the first windows by position, a report feature.
    """
    h = size / 2
    mid = G.interpolate(F.col("pts"), F.lit(0.5), normalized=True)
    xmin, ymin, xmax, ymax = raster_bounds
    w = lines.select(F.col(line_id), mid.alias("_m")).select(
        line_id, F.col("_m.x").alias("x"), F.col("_m.y").alias("y"))
    for c, e in (("xmin", F.col("x") - h), ("ymin", F.col("y") - h), ("xmax", F.col("x") + h), ("ymax", F.col("y") + h)):
        w = w.withColumn(c, F.round(e, 2))
    w = w.filter((F.col("xmax") >= xmin) & (F.col("xmin") <= xmax) & (F.col("ymax") >= ymin) & (F.col("ymin") <= ymax))
    w = w.groupBy("xmin", "ymin", "xmax", "ymax").agg(F.min(line_id).alias("window_id"))
    hits = intersects_join(w, lines.select(line_id, "pts"), 0.0, size, "window_id", line_id)
    n = hits.groupBy("window_id").agg(F.count(F.lit(1)).alias("n_lines"))
    out = w.join(n, "window_id")
    return out if limit is None else out.orderBy("xmin", "ymin").limit(limit)
