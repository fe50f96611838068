"""Planar geometry as Spark column expressions.

A polyline is ``pts ARRAY<STRUCT<x DOUBLE, y DOUBLE>>``; a multi-line or a
polygon is ``parts ARRAY<pts>`` (first part of a polygon is its shell). All
functions are plain expressions, so they stay inside the JVM.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _null() -> Column:
    return F.lit(None).cast("double")


def point(x, y) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def edges(pts: Column) -> Column:
    """Consecutive vertex pairs as structs ``x0, y0, x1, y1, len``."""
    n = F.greatest(F.size(pts) - 1, F.lit(0))
    return F.zip_with(
        F.slice(pts, F.lit(1), n), F.slice(pts, F.lit(2), n),
        lambda a, b: F.struct(
            a["x"].alias("x0"), a["y"].alias("y0"), b["x"].alias("x1"), b["y"].alias("y1"),
            F.hypot(b["x"] - a["x"], b["y"] - a["y"]).alias("len")))


def line_length(pts: Column) -> Column:
    return F.aggregate(edges(pts), F.lit(0.0), lambda s, e: s + e["len"])


def interpolate(pts: Column, d: Column, normalized: bool = False) -> Column:
    """Point at distance ``d`` along the line, clamped to its ends."""
    at = F.greatest(d * line_length(pts) if normalized else d, F.lit(0.0))

    def step(s, e):
        t = F.when(e["len"] > 0, (s["at"] - s["acc"]) / e["len"]).otherwise(F.lit(0.0))
        here = s["x"].isNull() & (s["acc"] + e["len"] >= s["at"])
        return F.struct(
            s["at"].alias("at"), (s["acc"] + e["len"]).alias("acc"),
            F.when(here, e["x0"] + t * (e["x1"] - e["x0"])).otherwise(s["x"]).alias("x"),
            F.when(here, e["y0"] + t * (e["y1"] - e["y0"])).otherwise(s["y"]).alias("y"))

    # the target distance travels in the state, so that it is computed once per line and not per edge
    start = F.struct(at.cast("double").alias("at"), F.lit(0.0).alias("acc"), _null().alias("x"), _null().alias("y"))
    end = F.element_at(pts, -1)
    return F.aggregate(edges(pts), start, step, lambda s: F.struct(
        F.coalesce(s["x"], end["x"]).alias("x"), F.coalesce(s["y"], end["y"]).alias("y")))


def chains(pts: Column) -> Column:
    """Distance from the start for every vertex."""
    return F.aggregate(edges(pts), F.array(F.lit(0.0)),
                       lambda acc, e: F.array_append(acc, F.element_at(acc, -1) + e["len"]))


def substring(pts: Column, d0: Column, d1: Column, vertex_chains: Column | None = None) -> Column:
    """The part of the line between two distances along it."""
    c = chains(pts) if vertex_chains is None else vertex_chains
    inner = F.filter(
        F.zip_with(pts, c, lambda p, k: F.struct(p["x"].alias("x"), p["y"].alias("y"), k.alias("k"))),
        lambda v: (v["k"] > d0) & (v["k"] < d1))
    return F.concat(F.array(interpolate(pts, d0)),
                    F.transform(inner, lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y"))),
                    F.array(interpolate(pts, d1)))


def foot_share(px, py, x0, y0, x1, y1) -> Column:
    """Position in [0, 1] of the closest point of an edge."""
    dx, dy = x1 - x0, y1 - y0
    l2 = dx * dx + dy * dy
    return F.when(l2 > 0, F.least(F.lit(1.0), F.greatest(
        F.lit(0.0), ((px - x0) * dx + (py - y0) * dy) / l2))).otherwise(F.lit(0.0))


def edge_distance(px, py, x0, y0, x1, y1) -> Column:
    t = foot_share(px, py, x0, y0, x1, y1)
    return F.hypot(px - (x0 + t * (x1 - x0)), py - (y0 + t * (y1 - y0)))


def project_point(pts: Column, px: Column, py: Column) -> Column:
    """Closest point of a line: struct ``d`` (distance), ``chain``, ``x``, ``y``."""
    start = F.struct(F.lit(0.0).alias("acc"), _null().alias("d"), _null().alias("chain"),
                     _null().alias("x"), _null().alias("y"))

    def step(s, e):
        t = foot_share(px, py, e["x0"], e["y0"], e["x1"], e["y1"])
        fx, fy = e["x0"] + t * (e["x1"] - e["x0"]), e["y0"] + t * (e["y1"] - e["y0"])
        d = F.hypot(px - fx, py - fy)
        closer = s["d"].isNull() | (d < s["d"])
        return F.struct(
            (s["acc"] + e["len"]).alias("acc"),
            F.when(closer, d).otherwise(s["d"]).alias("d"),
            F.when(closer, s["acc"] + t * e["len"]).otherwise(s["chain"]).alias("chain"),
            F.when(closer, fx).otherwise(s["x"]).alias("x"),
            F.when(closer, fy).otherwise(s["y"]).alias("y"))

    return F.aggregate(edges(pts), start, step, lambda s: F.struct(
        s["d"].alias("d"), s["chain"].alias("chain"), s["x"].alias("x"), s["y"].alias("y")))


def points_around(pts: Column, px: Column, py: Column, before: float, after: float) -> Column:
    """Two points at -before / +after from the projection of a point, clamped to the line."""
    c = project_point(pts, px, py)["chain"]
    return F.struct(interpolate(pts, F.greatest(c - before, F.lit(0.0))).alias("before"),
                    interpolate(pts, F.least(c + after, line_length(pts))).alias("after"))


def angle_deg(ax, ay, bx, by, cx, cy) -> Column:
    """Angle at the middle point b, 180 when an arm has no length."""
    na, nc = F.hypot(ax - bx, ay - by), F.hypot(cx - bx, cy - by)
    cos = ((ax - bx) * (cx - bx) + (ay - by) * (cy - by)) / (na * nc)
    return F.when((na == 0) | (nc == 0), F.lit(180.0)).otherwise(
        F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos)))))


def bounds(pts: Column) -> Column:
    xs, ys = F.transform(pts, lambda p: p["x"]), F.transform(pts, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"),
                    F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax"))


def bounds_polygon(xmin, ymin, xmax, ymax) -> Column:
    """Closed counter-clockwise ring of a box."""
    return F.array(point(xmin, ymin), point(xmax, ymin), point(xmax, ymax), point(xmin, ymax),
                   point(xmin, ymin))


def extent_to_bounds(extent: Column) -> Column:
    """[xmin, xmax, ymin, ymax] to [xmin, ymin, xmax, ymax]."""
    return F.array(extent[0], extent[2], extent[1], extent[3])


def bounds_to_extent(b: Column) -> Column:
    """[xmin, ymin, xmax, ymax] to [xmin, xmax, ymin, ymax]."""
    return F.array(b[0], b[2], b[1], b[3])


def inside_ring(pts: Column, px: Column, py: Column) -> Column:
    """Even-odd crossing test against one closed ring."""
    crossings = F.aggregate(
        edges(pts), F.lit(0),
        lambda s, e: s + F.when(
            ((e["y0"] > py) != (e["y1"] > py))
            & (px < (e["x1"] - e["x0"]) * (py - e["y0"]) / (e["y1"] - e["y0"]) + e["x0"]), 1).otherwise(0))
    return crossings % 2 == 1


def inside_polygon(parts: Column, px: Column, py: Column) -> Column:
    """Even-odd test over shell and holes."""
    odd = F.aggregate(parts, F.lit(0), lambda s, ring: s + F.when(inside_ring(ring, px, py), 1).otherwise(0))
    return odd % 2 == 1


def snap_bounds(xmin, ymin, xmax, ymax, x0: float, y0: float, dx: float, dy: float) -> Column:
    """Grow a box outward to whole grid cells."""
    return F.struct((F.floor((xmin - x0) / dx) * dx + x0).alias("xmin"),
                    (F.floor((ymin - y0) / dy) * dy + y0).alias("ymin"),
                    (F.ceil((xmax - x0) / dx) * dx + x0).alias("xmax"),
                    (F.ceil((ymax - y0) / dy) * dy + y0).alias("ymax"))


def cell_center(x, y, x0: float, y0: float, dx: float, dy: float) -> Column:
    """Centre of the north-up grid cell that holds a point (y0 is the top edge)."""
    return F.struct((x0 + (F.floor((x - x0) / dx) + 0.5) * dx).alias("x"),
                    (y0 - (F.floor((y0 - y) / dy) + 0.5) * dy).alias("y"))


def to_pixel(x, y, x0: float, y0: float, res: float) -> Column:
    """World to nearest pixel offset, ties to even like Python ``round``."""
    return F.struct(F.bround((y0 - y) / res, 0).cast("long").alias("row"),
                    F.bround((x - x0) / res, 0).cast("long").alias("col"))


def to_world(row, col, x0: float, y0: float, res: float) -> Column:
    """Centre of a pixel."""
    return F.struct((x0 + (col + 0.5) * res).alias("x"), (y0 - (row + 0.5) * res).alias("y"))


def in_raster(x, y, x0: float, y0: float, width: float, height: float) -> Column:
    return x.between(x0, x0 + width) & y.between(y0 - height, y0)


def without_repeats(pts: Column) -> Column:
    """Drop vertices equal to the one before."""
    return F.filter(pts, lambda p, i: (i == 0) | (p != F.element_at(pts, F.greatest(i, F.lit(1)))))

