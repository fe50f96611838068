"""Radar scene listings."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def list_files(spark: SparkSession, folder: str, glob: str = "*.tif") -> DataFrame:
    """path, length of the files below a folder; contents are not read."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
            .select("path", "length"))


def list_scenes(files: DataFrame, pol: str, union_calibrated: bool = False) -> DataFrame:
    """Files of the best name pattern per folder: sigma0, else gamma0, else grd, else any name with the polarisation.

    ``union_calibrated`` takes sigma0 and gamma0 together.
    """
    d = files.withColumn("folder", F.regexp_extract("path", r"^(.*)/[^/]*$", 1)).withColumn("name", F.regexp_extract("path", r"([^/]*)$", 1))
    ends = lambda s: F.col("name").endswith(f"_{pol}{s}")
    rank = (F.when(ends("_sigma0-elp.tif"), 1).when(ends("_gamma0-elp.tif"), 1 if union_calibrated else 2).when(ends("_grd_elp.tif"), 3)
            .when(F.col("name").contains(pol) & F.col("name").endswith(".tif"), 4))
    d = d.withColumn("rank", rank).filter(F.col("rank").isNotNull())
    best = d.groupBy("folder").agg(F.min("rank").alias("_b"))
    return d.join(best, "folder").filter(F.col("rank") == F.col("_b")).drop("_b")


def scene_inventory(scenes: DataFrame, by=("orbit", "pol")) -> DataFrame:
    """Count, first, last and distinct dates from the time stamp in the name."""
    day = F.nullif(F.regexp_extract("name", r"(\d{8})T\d{6}", 1), F.lit(""))
    return scenes.withColumn("_d", day).groupBy(*by).agg(F.count(F.lit(1)).alias("n_scenes"), F.min("_d").alias("date_min"), F.max("_d").alias("date_max"),
                                                         F.count_distinct("_d").alias("n_unique_dates"))


def pending(manifest: DataFrame, existing: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Manifest rows (name, size) without a present file of at least (1 - tolerance) of the size."""
    have = existing.select(F.col("name").alias("_n"), F.col("size").alias("_s"))
    return manifest.join(have, (F.col("name") == F.col("_n")) & (F.col("_s") >= F.col("size") * (1 - tolerance)), "left_anti")
