"""Map projections as column expressions (published closed forms, GRS80 ellipsoid, degrees in and out).

Transverse Mercator uses the Krueger series to the fourth order; Albers and
Lambert azimuthal equal-area use authalic latitudes with the inverse series.
"""
from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

A = 6378137.0
FLAT = 1 / 298.257222101
E2 = FLAT * (2 - FLAT)
E = math.sqrt(E2)
N = FLAT / (2 - FLAT)


@dataclass(frozen=True)
class Projection:
    kind: str
    lat0: float
    lon0: float
    fe: float
    fn: float
    k0: float = 1.0
    lat1: float = 0.0
    lat2: float = 0.0


# fixed values: published parameters of the coordinate systems in use
PROJECTIONS = {
    2180: Projection("tm", 0.0, 19.0, 500000.0, -5300000.0, k0=0.9993),
    3035: Projection("laea", 52.0, 10.0, 4321000.0, 3210000.0),
    5070: Projection("albers", 23.0, -96.0, 0.0, 0.0, lat1=29.5, lat2=45.5),
}

_KR = A / (1 + N) * (1 + N ** 2 / 4 + N ** 4 / 64)
_ALPHA = (N / 2 - 2 * N ** 2 / 3 + 5 * N ** 3 / 16 + 41 * N ** 4 / 180, 13 * N ** 2 / 48 - 3 * N ** 3 / 5 + 557 * N ** 4 / 1440,
          61 * N ** 3 / 240 - 103 * N ** 4 / 140, 49561 * N ** 4 / 161280)
_BETA = (N / 2 - 2 * N ** 2 / 3 + 37 * N ** 3 / 96 - N ** 4 / 360, N ** 2 / 48 + N ** 3 / 15 - 437 * N ** 4 / 1440,
         17 * N ** 3 / 480 - 37 * N ** 4 / 840, 4397 * N ** 4 / 161280)
_DELTA = (2 * N - 2 * N ** 2 / 3 - 2 * N ** 3 + 116 * N ** 4 / 45, 7 * N ** 2 / 3 - 8 * N ** 3 / 5 - 227 * N ** 4 / 45,
          56 * N ** 3 / 15 - 136 * N ** 4 / 35, 4279 * N ** 4 / 630)


def _q(sin_lat):
    """Authalic function of latitude; works on floats and Columns."""
    if isinstance(sin_lat, Column):
        return (1 - E2) * (sin_lat / (1 - E2 * sin_lat * sin_lat) - F.log((1 - E * sin_lat) / (1 + E * sin_lat)) / (2 * E))
    return (1 - E2) * (sin_lat / (1 - E2 * sin_lat ** 2) - math.log((1 - E * sin_lat) / (1 + E * sin_lat)) / (2 * E))


_QP = _q(1.0)


def _lat_from_authalic(beta: Column) -> Column:
    return (beta + (E2 / 3 + 31 * E2 ** 2 / 180 + 517 * E2 ** 3 / 5040) * F.sin(2 * beta)
            + (23 * E2 ** 2 / 360 + 251 * E2 ** 3 / 3780) * F.sin(4 * beta) + 761 * E2 ** 3 / 45360 * F.sin(6 * beta))


def _asin_safe(v: Column) -> Column:
    return F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v)))


def forward(lon: Column, lat: Column, epsg: int) -> Column:
    """Longitude and latitude to map coordinates (struct x, y)."""
    p = PROJECTIONS[epsg]
    phi, lam = F.radians(lat), F.radians(lon - p.lon0)
    if p.kind == "tm":
        s = F.sin(phi)
        t = F.sinh(F.atanh(s) - 2 * math.sqrt(N) / (1 + N) * F.atanh(2 * math.sqrt(N) / (1 + N) * s))
        xi, eta = F.atan2(t, F.cos(lam)), F.asinh(F.sin(lam) / F.hypot(t, F.cos(lam)))
        e, n = eta, xi
        for j, a in enumerate(_ALPHA, 1):
            e = e + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
            n = n + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        x, y = p.fe + p.k0 * _KR * e, p.fn + p.k0 * _KR * n
    elif p.kind == "albers":
        n_, c, rho0 = _albers(p)
        rho = A * F.sqrt(c - n_ * _q(F.sin(phi))) / n_
        x, y = p.fe + rho * F.sin(n_ * lam), p.fn + rho0 - rho * F.cos(n_ * lam)
    else:
        b0, rq, d = _laea(p)
        beta = _asin_safe(_q(F.sin(phi)) / _QP)
        b = rq * F.sqrt(2 / (1 + math.sin(b0) * F.sin(beta) + math.cos(b0) * F.cos(beta) * F.cos(lam)))
        x = p.fe + b * d * F.cos(beta) * F.sin(lam)
        y = p.fn + b / d * (math.cos(b0) * F.sin(beta) - math.sin(b0) * F.cos(beta) * F.cos(lam))
    return F.struct(x.alias("x"), y.alias("y"))


def inverse(x: Column, y: Column, epsg: int) -> Column:
    """Map coordinates to longitude and latitude (struct lon, lat)."""
    p = PROJECTIONS[epsg]
    if p.kind == "tm":
        xi, eta = (y - p.fn) / (p.k0 * _KR), (x - p.fe) / (p.k0 * _KR)
        xp, ep = xi, eta
        for j, b in enumerate(_BETA, 1):
            xp = xp - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
            ep = ep - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        chi = F.asin(F.sin(xp) / F.cosh(ep))
        phi = chi
        for j, dl in enumerate(_DELTA, 1):
            phi = phi + dl * F.sin(2 * j * chi)
        lam = F.atan2(F.sinh(ep), F.cos(xp))
    elif p.kind == "albers":
        n_, c, rho0 = _albers(p)
        dx, dy = x - p.fe, rho0 - (y - p.fn)
        rho = F.hypot(dx, dy)
        q = (c - (rho * n_ / A) * (rho * n_ / A)) / n_
        phi, lam = _lat_from_authalic(_asin_safe(q / _QP)), F.atan2(dx, dy) / n_
    else:
        b0, rq, d = _laea(p)
        dx, dy = (x - p.fe) / d, (y - p.fn) * d
        rho = F.hypot(dx, dy)
        c = 2 * _asin_safe(rho / (2 * rq))
        beta = F.when(rho == 0, F.lit(b0)).otherwise(_asin_safe(F.cos(c) * math.sin(b0) + dy * F.sin(c) * math.cos(b0) / F.nullif(rho, F.lit(0.0))))
        phi = _lat_from_authalic(beta)
        lam = F.atan2(dx * F.sin(c), rho * math.cos(b0) * F.cos(c) - dy * math.sin(b0) * F.sin(c))
    return F.struct((F.degrees(lam) + p.lon0).alias("lon"), F.degrees(phi).alias("lat"))


def _albers(p: Projection):
    m = lambda deg: math.cos(math.radians(deg)) / math.sqrt(1 - E2 * math.sin(math.radians(deg)) ** 2)
    q = lambda deg: _q(math.sin(math.radians(deg)))
    n_ = (m(p.lat1) ** 2 - m(p.lat2) ** 2) / (q(p.lat2) - q(p.lat1))
    c = m(p.lat1) ** 2 + n_ * q(p.lat1)
    return n_, c, A * math.sqrt(c - n_ * q(p.lat0)) / n_


def _laea(p: Projection):
    s0 = math.sin(math.radians(p.lat0))
    b0, rq = math.asin(_q(s0) / _QP), A * math.sqrt(_QP / 2)
    d = A * math.cos(math.radians(p.lat0)) / math.sqrt(1 - E2 * s0 * s0) / (rq * math.cos(b0))
    return b0, rq, d


def reproject_columns(x: Column, y: Column, source: int, target: int) -> Column:
    """Between two known systems; 4326 means longitude, latitude."""
    if source == target:
        return F.struct(x.alias("x"), y.alias("y"))
    if source == 4326:
        return forward(x, y, target)
    # the position is bound once through a one-element array; written out, it would be repeated in every term
    def leave(g: Column) -> Column:
        if target == 4326:
            return F.struct(g["lon"].alias("x"), g["lat"].alias("y"))
        return forward(g["lon"], g["lat"], target)

    return F.transform(F.array(inverse(x, y, source)), leave)[0]


def reproject(df: DataFrame, source: int, target: int, x: str = "x", y: str = "y") -> DataFrame:
    return df.withColumn("_p", reproject_columns(F.col(x), F.col(y), source, target)).withColumn(x, F.col("_p.x")).withColumn(
        y, F.col("_p.y")).drop("_p")


def orthometric(points: DataFrame, grid: DataFrame, lon0: float, lat0: float, step: float, point_id: str = "id", h: str = "h_te_ellipsoid") -> DataFrame:
    """Height above the geoid: bilinear undulation from the four grid nodes (row, col, n_value; row grows north), NULL outside."""
    c, r = (F.col("lon") - lon0) / step, (F.col("lat") - lat0) / step
    # the four nodes of a grid cell are put into one row, so that a point is shuffled once and no pairs are grouped
    corners = [(0, 0), (0, 1), (1, 0), (1, 1)]
    node = F.explode(F.array(*[F.struct((F.col("row") - i).alias("_r"), (F.col("col") - j).alias("_c"), F.lit(2 * i + j).alias("_k")) for i, j in corners]))
    g = grid.select(node.alias("_n"), "n_value").select("_n.*", "n_value")
    g = g.groupBy("_r", "_c").agg(F.count("n_value").alias("_count"), *[F.max(F.when(F.col("_k") == k, F.col("n_value"))).alias(f"_n{k}") for k in range(4)])
    g = g.filter("_count = 4").drop("_count")
    p = points.withColumn("_pc", F.floor(c)).withColumn("_pr", F.floor(r)).withColumn("_u", c - F.floor(c)).withColumn("_v", r - F.floor(r))
    s = p.join(g, (F.col("_pr") == F.col("_r")) & (F.col("_pc") == F.col("_c")), "left")
    weight = lambda i, j: (F.col("_v") if i else 1 - F.col("_v")) * (F.col("_u") if j else 1 - F.col("_u"))
    n = sum((weight(i, j) * F.col(f"_n{2 * i + j}") for i, j in corners[1:]), weight(0, 0) * F.col("_n0"))
    return s.withColumn("geoid_N", n).drop("_pc", "_pr", "_u", "_v", "_r", "_c", *[f"_n{k}" for k in range(4)]).withColumn("h_te_ortho", F.col(h) - F.col("geoid_N"))
