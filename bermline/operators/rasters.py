"""Raster and patch algebra on pixel tables ``(keys..., row, col, value)`` and patch arrays.

Pixel form is used inside a stage, tile arrays at rest. Operators that need
neighbours either send votes to neighbour cells (one aggregation, no join) or
work on tiles with a halo, whose size is fixed.
"""
from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from bermline.functions import geometry as G
from bermline.operators.cells import line_edges, sample_bilinear, sample_nearest, short_edges, spread
from bermline.operators.coverage import merge_runs, slab_reach
from bermline.operators.ordered import null_safe_join


@dataclass(frozen=True)
class Grid:
    """North-up grid: top-left corner, cell size and optional size in cells."""
    x0: float
    y0: float
    res: float
    nrows: int | None = None
    ncols: int | None = None


# ---- lines to cells ----------------------------------------------------------------------

def rasterize(lines: DataFrame, grid: Grid, buffer: float = 15.0, all_touched: bool = True, keep: Sequence[str] = ()) -> DataFrame:
    """Distinct cells (row, col) covered by lines buffered by ``buffer``.

    ``all_touched``: the cell square comes within the buffer; otherwise its centre does.
    """
    keep = list(keep)
    e = short_edges(line_edges(spread(lines), keep).drop("edge", "len"), 256 * grid.res)
    reach = buffer + grid.res
    whole = lambda v: F.lit(v).cast("long")
    inside = lambda lo, hi, n: (lo, hi) if n is None else (F.greatest(lo, whole(0)), F.least(hi, whole(n - 1)))
    r0, r1 = inside(F.floor((grid.y0 - F.greatest("y0", "y1") - reach) / grid.res), F.floor((grid.y0 - F.least("y0", "y1") + reach) / grid.res), grid.nrows)
    e = e.filter(r0 <= r1)
    if all_touched:
        s = slab_reach(e, buffer, F.sequence(r0, r1), lambda r: (grid.y0 - r * grid.res - grid.res, grid.y0 - r * grid.res))
        c0, c1 = inside(F.ceil((F.col("_a") - grid.x0) / grid.res - 1), F.floor((F.col("_z") - grid.x0) / grid.res), grid.ncols)
        runs = merge_runs(s.select(*keep, "row", c0.alias("c0"), c1.alias("c1")).filter("c0 <= c1"), keep)
        return runs.select(*keep, "row", F.explode(F.sequence("c0", "c1")).alias("col"))
    c0, c1 = inside(F.floor((F.least("x0", "x1") - reach - grid.x0) / grid.res), F.floor((F.greatest("x0", "x1") + reach - grid.x0) / grid.res), grid.ncols)
    c = e.filter(c0 <= c1).withColumn("col", F.explode(F.sequence(c0, c1))).withColumn("row", F.explode(F.sequence(r0, r1)))
    hit = G.edge_distance(grid.x0 + (F.col("col") + 0.5) * grid.res, grid.y0 - (F.col("row") + 0.5) * grid.res,
                          F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")) <= buffer
    return c.filter(hit).select(*keep, "row", "col").distinct()


# ---- merging rasters ------------------------------------------------------------------------

def mosaic_in_order(pixels: DataFrame, order: str, keys: Sequence[str] = ("row", "col")) -> DataFrame:
    """First raster in the order wins wherever it is valid."""
    return pixels.groupBy(*keys).agg(F.min_by("value", F.when(F.col("value").isNotNull(), F.col(order))).alias("value"))


def mosaic_extreme(pixels: DataFrame, how: str = "max", keys: Sequence[str] = ("row", "col")) -> DataFrame:
    return pixels.groupBy(*keys).agg((F.max if how == "max" else F.min)("value").alias("value"))


def mosaic_sum(pixels: DataFrame, keys: Sequence[str] = ("row", "col"), zero_is_nodata: bool = True, places: int | None = None) -> DataFrame:
    """Sum with missing as 0, rounded to ``places`` if these are given; a result of 0 counts as missing."""
    s = F.sum(F.coalesce("value", F.lit(0.0)))
    s = s if places is None else F.round(s, places)
    return pixels.groupBy(*keys).agg((F.nullif(s, F.lit(0.0)) if zero_is_nodata else s).alias("value"))


def mosaic_groups(pixels: DataFrame, scenes: DataFrame, grid: Grid, scene: str = "scene_id", order: str = "ord") -> DataFrame:
    """Pixels of each scene (own x0, y0, res) moved to one grid by cell centre, then merged in order per group."""
    d = pixels.join(scenes.select(scene, "group", order, "x0", "y0", "res"), scene)
    x, y = F.col("x0") + (F.col("col") + 0.5) * F.col("res"), F.col("y0") - (F.col("row") + 0.5) * F.col("res")
    d = d.withColumn("_c", F.floor((x - grid.x0) / grid.res)).withColumn("_r", F.floor((grid.y0 - y) / grid.res))
    d = d.select("group", F.col("_r").alias("row"), F.col("_c").alias("col"), order, "value")
    return mosaic_in_order(d, order, ("group", "row", "col"))


# ---- box windows -------------------------------------------------------------------------------

def _padded(d: DataFrame, axis: str, size: str, r: int, border: str) -> DataFrame:
    """Copy border cells outward along one axis."""
    p, n = F.col(axis), F.col(size)
    if border == "reflect":
        extra = F.concat(F.when(p < r, F.array(-1 - p)).otherwise(F.array().cast("array<bigint>")),
                         F.when(p >= n - r, F.array(2 * n - 1 - p)).otherwise(F.array().cast("array<bigint>")))
    else:
        extra = F.concat(F.when(p == 0, F.sequence(F.lit(-r).cast("long"), F.lit(-1).cast("long"))).otherwise(F.array().cast("array<bigint>")),
                         F.when(p == n - 1, F.sequence(n, n + r - 1)).otherwise(F.array().cast("array<bigint>")))
    return d.withColumn("_at", F.explode(F.concat(F.array(p.cast("long")), extra))).drop(axis).withColumnRenamed("_at", axis)


def _sized(pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    dims = pixels.groupBy(*keys).agg((F.max("row") + 1).alias("_nr"), (F.max("col") + 1).alias("_nc"))
    return null_safe_join(pixels, dims, keys) if keys else pixels.crossJoin(dims)  # one row of sizes


def tpi(pixels: DataFrame, radius: int, border: str = "reflect", keys: Sequence[str] = ()) -> DataFrame:
    """Value minus the mean of the (2r+1) square around it; ``reflect`` repeats the edge pixel (d c b a | a b c d).

    The box sum is two one-dimensional window passes; a window partition is one
    row or one column of a raster.
    """
    d = _sized(pixels.select(*keys, F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "value"), keys)
    d = d.withColumn("_s", F.col("value"))
    for axis, other, size in (("row", "col", "_nr"), ("col", "row", "_nc")):
        d = _padded(d, axis, size, radius, border)
        w = W.partitionBy(*keys, other).orderBy(axis).rangeBetween(-radius, radius)
        d = d.withColumn("_s", F.sum("_s").over(w)).filter((F.col(axis) >= 0) & (F.col(axis) < F.col(size)))
    return d.select(*keys, "row", "col", (F.col("value") - F.col("_s") / float((2 * radius + 1) ** 2)).alias("value"))


def relative_elevation(pixels: DataFrame, radius: int, keys: Sequence[str] = ()) -> DataFrame:
    """Value minus the minimum of the (2r+1) square (border cells see a smaller window, as with edge repetition)."""
    rows = W.partitionBy(*keys, "col").orderBy("row").rangeBetween(-radius, radius)
    cols = W.partitionBy(*keys, "row").orderBy("col").rangeBetween(-radius, radius)
    d = pixels.withColumn("_m", F.min("value").over(rows))
    d = d.withColumn("_m", F.min("_m").over(cols))
    return d.withColumn("value", F.col("value") - F.col("_m")).drop("_m")


def window_values(points: DataFrame, pixels: DataFrame, size: int = 3, fill: float | None = None, point_id: str = "id") -> DataFrame:
    """Odd window around a pixel (row, col): one row per cell with offsets dr, dc; ``fill`` outside."""
    r = size // 2
    offs = F.sequence(F.lit(-r), F.lit(r))
    n = points.select(point_id, F.col("row").alias("_r"), F.col("col").alias("_c"), F.explode(offs).alias("dr"))
    n = n.select(point_id, "dr", F.explode(offs).alias("dc"), "_r", "_c")
    n = n.withColumn("_r", F.col("_r") + F.col("dr")).withColumn("_c", F.col("_c") + F.col("dc"))
    px = pixels.select(F.col("row").alias("_pr"), F.col("col").alias("_pc"), "value")
    j = n.join(px, (F.col("_r") == F.col("_pr")) & (F.col("_c") == F.col("_pc")), "left")
    return j.select(point_id, "dr", "dc", F.coalesce("value", F.lit(fill).cast("double")).alias("value"))


# ---- patch grids -----------------------------------------------------------------------------

def sliding_centres(lines: DataFrame, buffer: float, stride: float = 1280.0, extent: float = 2560.0) -> DataFrame:
    """Centres on the stride grid whose square comes within ``buffer`` of a line.

    Each edge proposes the centres near its own box, so the work follows the
    lines and not the area of the whole extent.
    """
    e = short_edges(line_edges(spread(lines.select("pts")), []).drop("edge", "len"), 4 * stride)
    h = extent / 2
    reach = buffer + h
    rows = F.sequence(F.ceil((F.least("y0", "y1") - reach) / stride - 0.5), F.floor((F.greatest("y0", "y1") + reach) / stride - 0.5))
    s = slab_reach(e, buffer, rows, lambda j: ((j + 0.5) * stride - h, (j + 0.5) * stride + h))
    runs = s.select("row", F.ceil((F.col("_a") - h) / stride - 0.5).alias("c0"), F.floor((F.col("_z") + h) / stride - 0.5).alias("c1")).filter("c0 <= c1")
    c = merge_runs(runs).select("row", F.explode(F.sequence("c0", "c1")).alias("_i"))
    return c.select(((F.col("_i") + 0.5) * stride).alias("x"), ((F.col("row") + 0.5) * stride).alias("y"))


def fishnet(areas: DataFrame, cell: float, block: int, overlap: float) -> DataFrame:
    """Squares of block*cell with overlap from the lower left corner of each area (xmin..ymax, inclusive starts)."""
    size = block * cell
    step = size - overlap
    n = lambda lo, hi: F.sequence(F.lit(0), F.floor((F.col(hi) - F.col(lo)) / step).cast("int"))
    d = areas.withColumn("_j", F.explode(n("ymin", "ymax"))).withColumn("_i", F.explode(n("xmin", "xmax")))
    x, y = F.col("xmin") + F.col("_i") * step, F.col("ymin") + F.col("_j") * step
    keep = [c for c in areas.columns if c not in ("xmin", "ymin", "xmax", "ymax")]
    return d.select(*keep, x.alias("x0"), y.alias("y0"), (x + size).alias("x1"), (y + size).alias("y1"))


def flush_tiles(rasters: DataFrame, tile: int, overlap: int) -> DataFrame:
    """Overlapping tiles per raster (nrows, ncols), the last one flush with the edge."""
    step = tile - overlap
    starts = lambda n: F.array_distinct(F.transform(
        F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.col(n) - tile) / step).cast("int"))), lambda k: F.least(k * step, F.col(n) - tile)))
    keep = [c for c in rasters.columns if c not in ("nrows", "ncols")]
    d = rasters.withColumn("r0", F.explode(starts("nrows"))).withColumn("c0", F.explode(starts("ncols")))
    return d.select(*keep, "r0", (F.col("r0") + tile).alias("r1"), "c0", (F.col("c0") + tile).alias("c1"))


def stitch(predictions: DataFrame, bounds: Sequence[float], stride: float, extent: float, res: float, size_px: int,
           method: str = "feather", floor: float = 0.02) -> DataFrame:
    """Patch predictions (cx, cy, prob array) to one raster: Hann-weighted, plain mean or maximum per pixel.

    Patches become pixels of the global grid and are reduced by an aggregation
    that combines on the map side. The grid origin follows the bounds.
    """
    minx, miny, maxx, maxy = bounds
    ox = math.floor(minx / stride) * stride - extent / 2
    oy = (math.floor(maxy / stride) + 1) * stride + extent / 2
    ncols, nrows = math.ceil(((maxx - ox) + extent) / res), math.ceil(((oy - miny) + extent) / res)
    d = predictions.select(F.bround((oy - F.col("cy") - extent / 2) / res, 0).cast("long").alias("_r0"),
                           F.bround((F.col("cx") - extent / 2 - ox) / res, 0).cast("long").alias("_c0"), F.posexplode("prob").alias("_i", "_p"))
    r, c = F.floor(F.col("_i") / size_px), F.col("_i") % size_px
    hann = lambda k: F.greatest(F.lit(floor), 0.5 * (1.0 - F.cos(2.0 * math.pi * k / (size_px - 1))))
    d = d.select((F.col("_r0") + r).alias("row"), (F.col("_c0") + c).alias("col"), F.col("_p").cast("double").alias("_p"),
                 (hann(r) * hann(c) if method == "feather" else F.lit(1.0)).alias("_w"))
    d = d.filter(F.col("row").between(0, nrows - 1) & F.col("col").between(0, ncols - 1))
    value = F.greatest(F.max("_p"), F.lit(0.0)) if method == "max" else F.sum(F.col("_p") * F.col("_w")) / F.sum("_w")
    return d.groupBy("row", "col").agg(value.alias("value"))


def stitch_grid(bounds: Sequence[float], stride: float, extent: float, res: float) -> Grid:
    minx, miny, maxx, maxy = bounds
    ox = math.floor(minx / stride) * stride - extent / 2
    oy = (math.floor(maxy / stride) + 1) * stride + extent / 2
    return Grid(ox, oy, res, math.ceil(((oy - miny) + extent) / res), math.ceil(((maxx - ox) + extent) / res))


# ---- scoring and classes --------------------------------------------------------------------------

def score_batches(df: DataFrame, make_predict: Callable[[], Callable[[np.ndarray], np.ndarray]], features: Sequence[str] | str,
                  out: str = "prob", batch: int = 1024) -> DataFrame:
    """Score rows in Arrow batches with a caller's model. ``make_predict`` runs once per Python worker.

    ``features``: one array column or several numeric columns; rows with a missing feature stay NULL.
    """
    cols = [features] if isinstance(features, str) else list(features)

    def run(batches: Iterator[tuple]) -> Iterator[pd.Series]:
        predict = make_predict()
        for parts in batches:
            parts = parts if isinstance(parts, tuple) else (parts,)
            if isinstance(features, str):
                ok = parts[0].notna()
                x = np.stack(parts[0][ok].to_list()) if ok.any() else np.empty((0, 0))
            else:
                m = pd.concat(list(parts), axis=1).to_numpy(float)
                ok = pd.Series(~np.isnan(m).any(axis=1))
                x = m[ok.to_numpy()]
            scored = [v for i in range(0, len(x), batch) for v in np.asarray(predict(x[i:i + batch]), float).tolist()]
            rest = iter(scored)
            res = [next(rest) if k else None for k in ok]
            yield pd.Series(res, dtype=object if isinstance(features, str) else float)

    is_array = isinstance(features, str)
    kind = T.ArrayType(T.DoubleType()) if is_array else T.DoubleType()
    if len(cols) == 1:
        def one(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            yield from run(batches)
        return df.withColumn(out, F.pandas_udf(one, kind, F.PandasUDFType.SCALAR_ITER)(*[F.col(c) for c in cols]))
    return df.withColumn(out, F.pandas_udf(run, kind, F.PandasUDFType.SCALAR_ITER)(*[F.col(c) for c in cols]))


def classify(pixels: DataFrame, threshold: float, nodata: int = 255, prob: str = "prob") -> DataFrame:
    """1 where prob >= threshold, 0 below, ``nodata`` where missing."""
    return pixels.withColumn("class", F.when(F.col(prob).isNull(), nodata).when(F.col(prob) >= threshold, 1).otherwise(0))


def mask_counts(pixels: DataFrame, pixel_size: float = 10.0, nodata: int = 255, col: str = "class", by: Sequence[str] = ()) -> DataFrame:
    pos, valid = F.count_if(F.col(col) == 1), F.count_if(F.col(col) != nodata)
    return pixels.groupBy(*by).agg(pos.alias("n_positive"), valid.alias("n_valid"), (pos / F.greatest(valid, F.lit(1))).alias("share"),
                                   (pos * (pixel_size * pixel_size) / 1e6).alias("area_km2"))


def feature_stack(layers: dict[str, DataFrame], keys: Sequence[str] = ("row", "col")) -> DataFrame:
    """One wide row per pixel with a column per layer; rows with a missing value drop out.

    The layers are stacked and pivoted in a single aggregation: one shuffle for
    any number of bands.
    """
    long = None
    for name, df in layers.items():
        part = df.select(*keys, F.lit(name).alias("_b"), F.col("value").cast("double").alias("_v"))
        long = part if long is None else long.unionByName(part)
    wide = long.groupBy(*keys).agg(*[F.max(F.when(F.col("_b") == n, F.col("_v"))).alias(n) for n in layers])
    return wide.dropna(subset=list(layers))


def warp(pixels: DataFrame, source: Grid, source_epsg: int, target: Grid, target_epsg: int, cells: DataFrame | None = None,
         method: str = "nearest", mask: DataFrame | None = None) -> DataFrame:
    """Resample to another grid and system: target cell centres are carried back to the source and sampled there.

    ``cells`` limits the target cells; ``mask`` holds polygons in target coordinates.
    """
    from bermline.functions.crs import reproject_columns
    from bermline.operators.cells import point_in_polygon

    spark = pixels.sparkSession
    if cells is None:
        n = target.nrows * target.ncols
        cells = spark.range(n).select(F.floor(F.col("id") / target.ncols).alias("row"), (F.col("id") % target.ncols).alias("col"))
    c = cells.select(F.col("row").alias("trow"), F.col("col").alias("tcol"))
    c = c.withColumn("x", target.x0 + (F.col("tcol") + 0.5) * target.res).withColumn("y", target.y0 - (F.col("trow") + 0.5) * target.res)
    if mask is not None:
        c = point_in_polygon(c, mask, key=["trow", "tcol"])
    c = c.withColumn("_p", reproject_columns(F.col("x"), F.col("y"), target_epsg, source_epsg))
    c = c.withColumn("x", F.col("_p.x")).withColumn("y", F.col("_p.y")).drop("_p").withColumn("id", F.struct("trow", "tcol"))
    if method == "bilinear":
        s = sample_bilinear(c, pixels, source.x0, source.y0, source.res, source.nrows, source.ncols)
    else:
        # the cell that holds the point, i.e. the nearest centre
        shifted = c.withColumn("x", F.col("x") - source.res / 2).withColumn("y", F.col("y") + source.res / 2)
        s = sample_nearest(shifted, pixels, source.x0, source.y0, source.res)
    return s.select(F.col("trow").alias("row"), F.col("tcol").alias("col"), "value")


# ---- tiles with halo ---------------------------------------------------------------------------------

def with_tiles(pixels: DataFrame, size: int, halo: int) -> DataFrame:
    """Copy each pixel to every tile whose halo covers it: adds tile_r, tile_c."""
    span = lambda c: F.explode(F.sequence(F.floor((F.col(c) - halo) / size), F.floor((F.col(c) + halo) / size)))
    return pixels.withColumn("tile_r", span("row")).withColumn("tile_c", span("col"))


def window_glcm(q: np.ndarray, window: int, levels: int, distance: int = 1) -> dict[str, np.ndarray]:
    """Texture of every full window of a level array (four directions, symmetric): arrays of the interior size."""
    pad = window // 2
    views = np.lib.stride_tricks.sliding_window_view(q, (window, window))
    h, w = views.shape[:2]
    d = distance
    pairs = [(views[:, :, :, :-d], views[:, :, :, d:]), (views[:, :, d:, :-d], views[:, :, :-d, d:]),
             (views[:, :, :-d, :], views[:, :, d:, :]), (views[:, :, :-d, :-d], views[:, :, d:, d:])]
    a = np.concatenate([p[0].reshape(h, w, -1) for p in pairs] + [p[1].reshape(h, w, -1) for p in pairs], axis=2).astype(np.int32)
    b = np.concatenate([p[1].reshape(h, w, -1) for p in pairs] + [p[0].reshape(h, w, -1) for p in pairs], axis=2).astype(np.int32)
    n = a.shape[2]
    diff = np.abs(a - b)
    out = {"contrast": (diff.astype(float) ** 2).mean(axis=2), "homogeneity": (1.0 / (1.0 + diff)).mean(axis=2)}
    # sum of squared cell shares: runs of equal codes
    code = np.sort(a * levels + b, axis=2)
    new = np.ones_like(code, bool)
    new[:, :, 1:] = code[:, :, 1:] != code[:, :, :-1]
    run = np.cumsum(new.reshape(-1)) - 1
    counts = np.bincount(run)
    owner = np.repeat(np.arange(h * w), n)[new.reshape(-1)]
    out["energy"] = np.bincount(owner, weights=(counts / n) ** 2, minlength=h * w).reshape(h, w)
    mu = a.mean(axis=2)
    var = ((a - mu[..., None]) ** 2).mean(axis=2)
    cov = ((a - mu[..., None]) * (b - mu[..., None])).mean(axis=2)
    out["correlation"] = cov / np.maximum(var, 1e-10)
    assert pad * 2 + 1 == window
    return out


def glcm(pixels: DataFrame, nrows: int, ncols: int, window: int = 7, levels: int = 64, distance: int = 1, tile: int = 128,
         keys: Sequence[str] = ()) -> DataFrame:
    """Texture bands from a pixel table with integer ``level``; the raster border is mirrored without repeating the edge.

    Tiles carry a halo of real pixels, so the result does not depend on the tile size.
    """
    pad = window // 2
    keys = list(keys)
    px = pixels.select(*keys, F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col("level").cast("int").alias("level"))
    schema = T.StructType([*[px.schema[k] for k in keys], T.StructField("row", T.LongType()), T.StructField("col", T.LongType()),
                           *[T.StructField(c, T.DoubleType()) for c in ("contrast", "homogeneity", "energy", "correlation")]])

    def mirrored(i: np.ndarray, n: int) -> np.ndarray:
        i = np.abs(i)
        return np.where(i >= n, 2 * (n - 1) - i, i)

    def textures(t: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Bands of whole tiles: those of one shape are stacked, one frame of a mirrored border each."""
        col = lambda k: np.asarray(t.column(k))
        ends = np.append(starts[1:], t.num_rows)
        tr, tc = col("tile_r")[starts], col("tile_c")[starts]
        r0, c0 = tr * tile, tc * tile
        height, width = np.minimum(r0 + tile, nrows) - r0, np.minimum(c0 + tile, ncols) - c0
        owner = np.repeat(np.arange(len(starts)), ends - starts)
        # a frame holds the tile and pad pixels around it; pixels beyond the raster are mirrored into it afterwards
        at_r, at_c = col("row") - r0[owner] + pad, col("col") - c0[owner] + pad
        level = col("level")
        for h, w in sorted(set(zip(height.tolist(), width.tolist()))):
            mine = np.flatnonzero((height == h) & (width == w))
            per = max(1, 65536 // ((h + 2 * pad) * (w + 2 * pad)))
            for k in range(0, len(mine), per):
                some = mine[k:k + per]
                place = np.full(len(starts), -1)
                place[some] = np.arange(len(some))
                take = place[owner] >= 0
                a = np.zeros((len(some), h + 2 * pad, w + 2 * pad), np.int32)
                a[place[owner[take]], at_r[take], at_c[take]] = level[take]
                for x, (i, j) in enumerate(zip(r0[some], c0[some])):
                    if i < pad or j < pad or i + h + pad > nrows or j + w + pad > ncols:
                        rr, cc = mirrored(np.arange(i - pad, i + h + pad), nrows) - i + pad, mirrored(np.arange(j - pad, j + w + pad), ncols) - j + pad
                        a[x] = a[x][np.ix_(rr, cc)]
                # the frames stand below each other; windows across two of them are left out
                res = window_glcm(a.reshape(-1, w + 2 * pad), window, levels, distance)
                inner = (np.arange(len(some))[:, None] * (h + 2 * pad) + np.arange(h)).ravel()
                row = np.repeat(r0[some], h * w) + np.tile(np.repeat(np.arange(h), w), len(some))
                column = np.repeat(c0[some], h * w) + np.tile(np.arange(w), h * len(some))
                first = pa.array(np.repeat(starts[some], h * w))
                out = [t.column(k).take(first).combine_chunks() for k in keys]
                out += [pa.array(row.astype(np.int64)), pa.array(column.astype(np.int64)), *[pa.array(res[b][inner].ravel()) for b in ("contrast", "homogeneity", "energy", "correlation")]]
                yield pa.RecordBatch.from_arrays([c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in out], names=[f.name for f in schema.fields])

    def run(batches):
        """Whole tiles of each batch at once; the last tile waits for the rest of its pixels."""
        left = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = (pa.concat_tables([left, t]) if left is not None else t).combine_chunks()
            if not t.num_rows:
                continue
            marks = np.zeros(t.num_rows, bool)
            marks[0] = True
            for k in order:
                x = pd.factorize(t.column(k).to_pandas())[0]
                marks[1:] |= x[1:] != x[:-1]
            starts = np.flatnonzero(marks)
            if len(starts) > 1:
                yield from textures(t.slice(0, starts[-1]).combine_chunks(), starts[:-1])
            left = t.slice(starts[-1])
        if left is not None:
            yield from textures(left.combine_chunks(), np.zeros(1, np.int64))

    # mirrored borders reach pad pixels inward, which the halo already holds; tiles beyond the raster have no pixels of their own
    order = [*keys, "tile_r", "tile_c"]
    real = F.col("tile_r").between(0, (nrows - 1) // tile) & F.col("tile_c").between(0, (ncols - 1) // tile)
    px = px.filter(F.col("row").between(0, nrows - 1) & F.col("col").between(0, ncols - 1))
    return with_tiles(px, tile, pad).filter(real).repartition(*order).sortWithinPartitions(*order).mapInArrow(run, schema)


# ---- patch reads and assembly ------------------------------------------------------------------------

def read_windows(centres: DataFrame, tiles: DataFrame, grid: Grid, size_px: int, res: float, method: str = "bilinear",
                 tile: int = 256, patch_id: str = "patch_id", out: str = "value") -> DataFrame:
    """Square windows around centres from a tile table (tile_r, tile_c, data: row-major float array of tile x tile).

    Zero outside the raster. A window meets its few tiles by an equi-join and is
    resampled in one Arrow group; a group is one patch, whose size is fixed.
    """
    ext = size_px * res
    src = int(math.ceil(ext / grid.res))
    c = centres.select(patch_id, F.floor((F.col("x") - ext / 2 - grid.x0) / grid.res).alias("_c0"),
                       F.floor((grid.y0 - F.col("y") - ext / 2) / grid.res).alias("_r0"))
    span = lambda o: F.explode(F.sequence(F.floor(F.col(o) / tile), F.floor((F.col(o) + src - 1) / tile)))
    c = c.withColumn("tile_r", span("_r0")).withColumn("tile_c", span("_c0"))
    j = c.join(tiles.select("tile_r", "tile_c", "data"), ["tile_r", "tile_c"], "left")
    nrows, ncols = grid.nrows, grid.ncols

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = int(pdf["_r0"].iloc[0]), int(pdf["_c0"].iloc[0])
        buf = np.zeros((src, src))
        for tr, tc, data in zip(pdf["tile_r"], pdf["tile_c"], pdf["data"]):
            if data is None:
                continue
            t = np.asarray(data, float).reshape(tile, tile)
            a, b = max(r0, tr * tile, 0), min(r0 + src, (tr + 1) * tile, nrows)
            u, v = max(c0, tc * tile, 0), min(c0 + src, (tc + 1) * tile, ncols)
            if a < b and u < v:
                buf[a - r0:b - r0, u - c0:v - c0] = np.nan_to_num(t[a - tr * tile:b - tr * tile, u - tc * tile:v - tc * tile])
        return pd.DataFrame({patch_id: [pdf[patch_id].iloc[0]], out: [resample(buf, size_px, method).ravel().tolist()]})

    kind = centres.schema[patch_id].dataType.simpleString()
    return j.groupBy(patch_id).applyInPandas(run, f"{patch_id} {kind}, {out} array<double>")


def resample(a: np.ndarray, n: int, method: str) -> np.ndarray:
    """Square array to n x n at cell centres."""
    m = a.shape[0]
    if m == n:
        return a
    pos = (np.arange(n) + 0.5) * m / n - 0.5
    if method == "nearest":
        i = np.clip(np.floor((np.arange(n) + 0.5) * m / n).astype(int), 0, m - 1)
        return a[np.ix_(i, i)]
    i = np.clip(np.floor(pos).astype(int), 0, max(m - 2, 0))
    f = np.clip(pos - i, 0, 1)
    k = np.minimum(i + 1, m - 1)
    rows = a[i] * (1 - f)[:, None] + a[k] * f[:, None]
    return rows[:, i] * (1 - f)[None, :] + rows[:, k] * f[None, :]


def to_tiles(pixels: DataFrame, tile: int = 256) -> DataFrame:
    """Pixel table to tile arrays (missing pixels are 0); a group is one tile, whose size is fixed."""
    d = pixels.select(F.floor(F.col("row") / tile).alias("tile_r"), F.floor(F.col("col") / tile).alias("tile_c"),
                      (F.col("row") % tile * tile + F.col("col") % tile).cast("int").alias("at"), F.col("value").cast("float").alias("value"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a = np.zeros(tile * tile, np.float32)
        a[pdf["at"].to_numpy()] = np.nan_to_num(pdf["value"].to_numpy(np.float32))
        return pd.DataFrame({"tile_r": pdf["tile_r"].iloc[:1].to_numpy(), "tile_c": pdf["tile_c"].iloc[:1].to_numpy(), "data": [a]})

    return d.groupBy("tile_r", "tile_c").applyInPandas(run, "tile_r long, tile_c long, data array<float>")


def _tpi_array(z: np.ndarray, r: int) -> np.ndarray:
    p = np.pad(z, r, mode="symmetric")
    s = np.pad(p.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    k = 2 * r + 1
    return z - (s[k:, k:] - s[:-k, k:] - s[k:, :-k] + s[:-k, :-k]) / (k * k)


def patch_tpi(arr: Column, n: int, radius: int) -> Column:
    """TPI of an n x n patch array, in Arrow batches."""
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda v: _tpi_array(np.asarray(v, float).reshape(n, n), radius).ravel().tolist())
    return F.pandas_udf(run, T.ArrayType(T.DoubleType()))(arr)


def assemble_channels(centres: DataFrame, rasters: dict[str, DataFrame], grids: dict[str, Grid], labels: DataFrame | None = None,
                      size_px: int = 256, res: float = 10.0, radii: Sequence[int] = (5, 10, 15), tile: int = 256,
                      patch_id: str = "patch_id") -> DataFrame:
    """Seven channels per patch centre: dsm, its TPI per radius, canopy height and deviation, 0/1 water.

    ``rasters``: tile tables. Centres outside the dsm and patches that are all
    zero drop out. ``labels`` holds line cells (row, col) of a grid of cell size
    ``res`` whose origin is that of the dsm grid; patches must be aligned to it.
    """
    g = grids["dsm"]
    c = centres.filter(G.in_raster(F.col("x"), F.col("y"), g.x0, g.y0, g.ncols * g.res, g.nrows * g.res))
    out = c
    for name in ("dsm", "canopy_height", "canopy_height_sd", "water"):
        w = read_windows(c, rasters[name], grids[name], size_px, res, "nearest" if name == "water" else "bilinear", tile, patch_id, f"_{name}")
        out = out.join(w, patch_id)
    out = out.filter(F.exists("_dsm", lambda v: v != 0))
    water = F.transform("_water", lambda v: F.when(v > 0.5, 1.0).otherwise(0.0))
    ch = [F.lit("dsm"), F.col("_dsm")]
    for r in radii:
        ch += [F.lit(f"tpi_r{r}"), patch_tpi(F.col("_dsm"), size_px, r)]
    ch += [F.lit("canopy_height"), F.col("_canopy_height"), F.lit("canopy_height_sd"), F.col("_canopy_height_sd"), F.lit("water"), water]
    out = out.withColumn("channels", F.create_map(*ch)).drop("_dsm", "_canopy_height", "_canopy_height_sd", "_water")
    return out if labels is None else out.join(patch_labels(c, labels, g, size_px, res, patch_id), patch_id, "left")


def patch_labels(centres: DataFrame, cells: DataFrame, grid: Grid, size_px: int, res: float, patch_id: str = "patch_id") -> DataFrame:
    """0/1 label array per patch from line cells of the ``res`` grid: cells meet patches by block equi-join."""
    r0 = F.bround((grid.y0 - F.col("y")) / res - size_px / 2, 0).cast("long")
    c0 = F.bround((F.col("x") - grid.x0) / res - size_px / 2, 0).cast("long")
    p = centres.select(patch_id, r0.alias("_r0"), c0.alias("_c0"))
    span = lambda o: F.explode(F.sequence(F.floor(F.col(o) / size_px), F.floor((F.col(o) + size_px - 1) / size_px)))
    pb = p.withColumn("_br", span("_r0")).withColumn("_bc", span("_c0"))
    cb = cells.select(F.floor(F.col("row") / size_px).alias("_br"), F.floor(F.col("col") / size_px).alias("_bc"), "row", "col")
    hit = pb.join(cb, ["_br", "_bc"]).filter(F.col("row").between(F.col("_r0"), F.col("_r0") + size_px - 1)
                                             & F.col("col").between(F.col("_c0"), F.col("_c0") + size_px - 1))
    at = ((F.col("row") - F.col("_r0")) * size_px + F.col("col") - F.col("_c0")).cast("int")
    s = hit.groupBy(patch_id).agg(F.collect_set(at).alias("_set"))  # at most size_px^2 cells
    m = p.select(patch_id).join(s, patch_id, "left")
    filled = F.coalesce("_set", F.array().cast("array<int>"))

    def spread(sets: pd.Series) -> pd.Series:
        def one(v):
            a = np.zeros(size_px * size_px, np.int8)
            a[np.asarray(v, np.int64)] = 1
            return a
        return sets.map(one)

    lab = F.pandas_udf(spread, T.ArrayType(T.ByteType()))(filled)
    return m.select(patch_id, lab.alias("label"), F.size(filled).alias("n_label_px"))


# ---- soft skeleton and reported losses ------------------------------------------------------------------

def _shift_reduce(a: np.ndarray, offsets, fill: float, op) -> np.ndarray:
    p = np.pad(a, ((0, 0), (1, 1), (1, 1)), constant_values=fill)
    h, w = a.shape[1:]
    out = None
    for dr, dc in offsets:
        v = p[:, 1 + dr:1 + dr + h, 1 + dc:1 + dc + w]
        out = v if out is None else op(out, v)
    return out


_CROSS_V, _CROSS_H = [(-1, 0), (0, 0), (1, 0)], [(0, -1), (0, 0), (0, 1)]
_BOX = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]


def soft_skeleton(x: np.ndarray, iters: int) -> np.ndarray:
    """Differentiable thinning of a (batch, h, w) array; outside counts as +inf for minima and -inf for maxima."""
    erode = lambda a: np.minimum(_shift_reduce(a, _CROSS_V, np.inf, np.minimum), _shift_reduce(a, _CROSS_H, np.inf, np.minimum))
    lost = lambda a, eroded: np.maximum(a - _shift_reduce(eroded, _BOX, -np.inf, np.maximum), 0)  # what opening takes away
    img, eroded = x, erode(x)
    skel = lost(img, eroded)
    for _ in range(iters):
        img, eroded = eroded, erode(eroded)
        skel = skel + lost(img, eroded) * (1 - skel)
    return skel


def cldice(patches: DataFrame, n: int, iters: int = 5, threshold: float | None = 0.5, prob: str = "prob", label: str = "label",
           eps: float = 1e-6, out: str = "cldice") -> DataFrame:
    """Centre-line Dice per patch (1 when both masks are empty), in Arrow batches. ``threshold=None``: soft probabilities."""
    def run(p: pd.Series, t: pd.Series) -> pd.Series:
        if not len(p):
            return pd.Series([], dtype=float)
        a = np.stack(p.to_list()).astype(float).reshape(len(p), n, n)
        b = np.stack(t.to_list()).astype(float).reshape(len(t), n, n)
        if threshold is not None:
            a = (a > threshold).astype(float)
        sa, sb = soft_skeleton(a, iters), soft_skeleton(b, iters)
        s = lambda v: v.sum(axis=(1, 2))
        tp, tr = (s(sa * b) + eps) / (s(sa) + eps), (s(a * sb) + eps) / (s(sb) + eps)
        return pd.Series(2 * tp * tr / (tp + tr))
    return patches.withColumn(out, F.pandas_udf(run, T.DoubleType())(F.col(prob), F.col(label)))


def reported_losses(patches: DataFrame, n: int, pos_weight: float = 20.0, dice_weight: float = 0.25, iters: int = 5,
                    prob: str = "prob", label: str = "label", by: Sequence[str] = (), eps: float = 1e-6) -> DataFrame:
    """Weighted cross-entropy, Dice and centre-line losses of given probabilities, and their combination."""
    d = cldice(patches, n, iters, None, prob, label, eps, "_cl")
    pair = F.arrays_zip(F.col(prob).alias("p"), F.col(label).alias("t"))
    safe = lambda v: F.log(F.greatest(v, F.lit(1e-12)))
    bce = F.aggregate(pair, F.lit(0.0), lambda s, z: s - (pos_weight * z["t"] * safe(z["p"]) + (1 - z["t"]) * safe(1 - z["p"])))
    total = lambda e: F.aggregate(pair, F.lit(0.0), lambda s, z: s + e(z))
    dice = (2 * total(lambda z: z["p"] * z["t"]) + eps) / (total(lambda z: z["p"]) + total(lambda z: z["t"].cast("double")) + eps)
    a = d.groupBy(*by).agg(F.avg(bce / float(n * n)).alias("bce"), (1 - F.avg(dice)).alias("dice_loss"), (1 - F.avg("_cl")).alias("cldice_loss"))
    return a.withColumn("combined", F.col("bce") + dice_weight * F.col("dice_loss") + (1 - dice_weight) * F.col("cldice_loss"))


