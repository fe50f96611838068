"""Lidar granules."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bermline.operators.cells import point_in_polygon
from bermline.operators.rows import present, quality_rules

STEP_S = 0.0028  # fixed value: time offset between 20 m sub-points

_D = ["lat", "lon", "delta_time", "h_te_median", "h_te_uncertainty", "n_te_photons", "snr", "night_flag", "layer_flag", "cloud_flag_atm",
      "msw_flag", "sat_flag", "terrain_flg", "dem_h"]
SUB = T.StructType([T.StructField(c, T.DoubleType()) for c in ("lat", "lon", "h")])
GRANULE = T.StructType([T.StructField("granule", T.StringType()), T.StructField("beam", T.StringType()), T.StructField("seg", T.LongType()),
                        *[T.StructField(c, T.DoubleType()) for c in _D], T.StructField("sub20m", T.ArrayType(SUB))])


def flatten_granules(df: DataFrame, aoi: DataFrame | None = None, use_20m: bool = True, rules: dict | None = None) -> DataFrame:
    """Nested segments to quality-passing points.

    With sub-points, a segment is valid when any of its five heights is; it
    yields its valid sub-points (time + 0.0028 s each), inheriting the flags.
    A segment without a sub-point array falls back to its 100 m value. Fill
    values count as missing, missing flags pass. ``aoi``: polygons (lon, lat).
    """
    d = df.withColumns({c: present(F.col(c)) for c in _D if c not in ("lat", "lon", "delta_time")})
    sub = F.transform(F.coalesce("sub20m", F.array().cast(T.ArrayType(SUB))), lambda s: F.struct(
        present(s["lat"]).alias("lat"), present(s["lon"]).alias("lon"), present(s["h"]).alias("h")))
    has_sub = F.col("sub20m").isNotNull() & F.lit(use_20m)
    d = d.withColumn("_use", has_sub).withColumn("_s", F.when(has_sub, sub))
    valid = F.when(F.col("_use"), F.exists(F.coalesce("_s", F.array().cast(T.ArrayType(SUB))), lambda s: s["h"].isNotNull())).otherwise(F.col("h_te_median").isNotNull())
    for r in (quality_rules() if rules is None else rules).values():
        valid = valid & r
    d = d.filter(valid)
    if aoi is not None:
        d = point_in_polygon(d.withColumn("x", F.col("lon")).withColumn("y", F.col("lat")), aoi, size=1.0).drop("x", "y")
    own = F.array(F.struct(F.col("lat"), F.col("lon"), F.col("h_te_median").alias("h")))
    d = d.select("*", F.posexplode(F.when(F.col("_use"), F.col("_s")).otherwise(own)).alias("_j", "_p"))
    d = d.filter(F.col("_p.h").isNotNull() & F.col("_p.lat").isNotNull() & F.col("_p.lon").isNotNull())
    return d.select(
        F.col("_p.lon").alias("lon"), F.col("_p.lat").alias("lat"), F.when(F.col("_use"), "20m").otherwise("100m").alias("res"), "beam", "granule", "seg",
        F.when(F.col("_use"), F.col("delta_time") + STEP_S * F.col("_j")).otherwise(F.col("delta_time")).alias("delta_time"),
        F.col("_p.h").alias("h_te_ellipsoid"), "h_te_uncertainty", F.coalesce(F.col("n_te_photons").cast("int"), F.lit(-1)).alias("n_te_photons"),
        "snr", "night_flag", "layer_flag", "cloud_flag_atm", "msw_flag", "sat_flag", "terrain_flg", "dem_h")
