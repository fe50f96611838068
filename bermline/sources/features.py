"""Vector layers, rasters and patches at rest."""
from __future__ import annotations

import io
import os
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bermline.functions import geometry as G
from bermline.functions.crs import PROJECTIONS, reproject_columns

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
PARTS = T.ArrayType(T.ArrayType(POINT))

PATCH_METADATA = T.StructType([
    T.StructField("patch_id", T.StringType()), T.StructField("patch_type", T.StringType()), T.StructField("category", T.StringType()),
    T.StructField("center_x", T.DoubleType()), T.StructField("center_y", T.DoubleType()), T.StructField("source_idx", T.LongType()),
    T.StructField("uparea", T.DoubleType()), T.StructField("comid", T.LongType()), T.StructField("basin_id", T.LongType()),
    T.StructField("n_label_px", T.IntegerType()), T.StructField("npz_path", T.StringType())])


def with_bounds(df: DataFrame, parts: str = "parts") -> DataFrame:
    """Box columns xmin..ymax of a multi-part geometry, stored so that a bbox filter reaches the scan."""
    return df.withColumn("_b", G.bounds(F.flatten(F.col(parts)))).select("*", "_b.*").drop("_b")


def write_features(df: DataFrame, path: str, epsg: int, parts: str = "parts", mode: str = "overwrite") -> None:
    """Parquet layer with box columns and an epsg column, ordered by box so that row groups can be skipped."""
    d = with_bounds(df.drop("xmin", "ymin", "xmax", "ymax"), parts).withColumn("epsg", F.lit(epsg))
    d.repartitionByRange("xmin", "ymin").sortWithinPartitions("xmin", "ymin").write.mode(mode).parquet(path)


def _moved(parts: Column, source: int, target: int) -> Column:
    return F.transform(parts, lambda part: F.transform(part, lambda q: reproject_columns(q["x"], q["y"], source, target)))


def read_features(spark: SparkSession, paths: str | Sequence[str], bbox: Sequence[float] | None = None, epsg: int | None = None,
                  assume_epsg: int | None = None, parts: str = "parts", schema: T.StructType | None = None) -> DataFrame:
    """Read one or several layers (Parquet; JSON when the name ends so), filter by box, reproject to ``epsg``.

    Layers are aligned by column name. The box is in the layer's own system. A row whose system is unknown or NULL raises.
    """
    out = None
    for p in [paths] if isinstance(paths, str) else paths:
        reader = spark.read.schema(schema) if schema is not None else spark.read
        d = reader.json(p) if p.rstrip("/").endswith((".json", ".geojson")) else reader.parquet(p)
        if bbox is not None:
            d = d.filter((F.col("xmax") >= bbox[0]) & (F.col("xmin") <= bbox[2]) & (F.col("ymax") >= bbox[1]) & (F.col("ymin") <= bbox[3]))
        if "epsg" not in d.columns:
            d = d.withColumn("epsg", F.lit(assume_epsg or epsg))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    if epsg is None:
        return out
    # one branch for each known system; a row of any other, or without one, fails instead of keeping its old position
    unknown = F.raise_error(F.concat(F.lit("unknown coordinate system "), F.coalesce(F.col("epsg").cast("string"), F.lit("NULL"))))
    moved = F.when(F.col("epsg") == epsg, F.col(parts))
    for source in sorted({4326, *PROJECTIONS} - {epsg}):
        moved = moved.when(F.col("epsg") == source, _moved(F.col(parts), source, epsg))
    moved = moved.otherwise(unknown.cast(out.schema[parts].dataType))
    d = out.withColumn(parts, moved).withColumn("epsg", F.lit(epsg)).drop("xmin", "ymin", "xmax", "ymax")
    return with_bounds(d, parts)


def read_patch_metadata(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """CSV metadata per region with a fixed schema and a ``region`` column."""
    out = None
    for region, path in paths.items():
        d = spark.read.schema(PATCH_METADATA).csv(path, header=True).withColumn("region", F.lit(region))
        out = d if out is None else out.unionByName(d)
    return out


def write_patches(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Patches and metadata as Parquet by region and split."""
    parts = [c for c in ("region", "split") if c in df.columns]
    w = df.write.mode(mode)
    (w.partitionBy(*parts) if parts else w).parquet(path)


def write_patches_npz(df: DataFrame, folder: str, patch_id: str = "patch_id", channels: str = "channels", label: str = "label") -> DataFrame:
    """One compressed ``.npz`` per patch in a shared folder, written by the tasks; returns id, path and label count.

    A file is written under a temporary name and renamed, so a retried task leaves whole files only.
    """
    def run(batches):
        os.makedirs(folder, exist_ok=True)
        for pdf in batches:
            rows = []
            for pid, ch, lab in zip(pdf[patch_id], pdf[channels], pdf[label]):
                n = int(round(len(lab) ** 0.5))
                arrays = {k: np.asarray(v, np.float32).reshape(n, n) for k, v in dict(ch).items()}
                arrays["label"] = np.asarray(lab, np.uint8).reshape(n, n)
                buf = io.BytesIO()
                np.savez_compressed(buf, **arrays)
                final = os.path.join(folder, f"{pid}.npz")
                tmp = f"{final}.{os.getpid()}.part"
                with open(tmp, "wb") as f:
                    f.write(buf.getvalue())
                os.replace(tmp, final)
                rows.append((pid, final, int(arrays["label"].sum())))
            yield pd.DataFrame(rows, columns=["patch_id", "npz_path", "n_label_px"])

    return df.select(patch_id, channels, label).mapInPandas(run, "patch_id string, npz_path string, n_label_px int")


def read_patches_npz(spark: SparkSession, folder: str, label: str = "label") -> DataFrame:
    """``patch_id, channels MAP, label ARRAY, n`` from a folder of ``.npz`` files; persist the result as Parquet."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(folder).select("path", "content")

    def run(batches):
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                z = np.load(io.BytesIO(content))
                lab = z[label] if label in z.files else None
                ch = {k: z[k].astype(np.float32).ravel().tolist() for k in z.files if k != label}
                n = int(z[z.files[0]].shape[0])
                rows.append((os.path.splitext(os.path.basename(path))[0], ch, None if lab is None else lab.astype(np.int8).ravel().tolist(), n))
            yield pd.DataFrame(rows, columns=["patch_id", "channels", "label", "n"])

    return files.mapInPandas(run, "patch_id string, channels map<string, array<float>>, label array<tinyint>, n int")


def write_raster(pixels: DataFrame, path: str, meta: dict, nodata: float | None = None, bands: Sequence[str] = ("value",), mode: str = "overwrite") -> None:
    """Pixel table (one float column per band) and a one-row ``meta`` table beside it."""
    p = pixels.select("row", "col", *[F.col(b).cast("float").alias(b) for b in bands])
    p.repartitionByRange("row", "col").sortWithinPartitions("row", "col").write.mode(mode).parquet(f"{path}/pixels")
    m = dict(meta, nodata=nodata, bands=list(bands))
    schema = "x0 double, y0 double, res double, nrows int, ncols int, epsg int, nodata double, bands array<string>"
    pixels.sparkSession.createDataFrame([tuple(m.get(f.split()[0]) for f in schema.split(", "))], schema).coalesce(1).write.mode(mode).parquet(f"{path}/meta")


def read_raster(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/pixels"), spark.read.parquet(f"{path}/meta")
