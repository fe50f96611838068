"""Views over the given tables in the shape of the domain tables, for Spark and (as text) for SQL.

Positions are derived from the keys along a strip that grows with the tables,
so the number of neighbours of a row stays the same at every scale.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def reaches(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("comid"), F.col("o_totalprice").alias("uparea"))
    return o.selectExpr(
        "comid", "CASE WHEN comid < 64 THEN 0 ELSE comid div 2 END AS next_down", "uparea",
        "CAST((comid div 100) * 20 + (37 * comid) % 17 AS DOUBLE) AS x",
        "CAST((comid % 100) * 20 + (91 * comid) % 13 AS DOUBLE) AS y")


def points(spark, d):
    return table(spark, d, "lineitem").selectExpr(
        "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT), CAST(l_extendedprice * 100 AS BIGINT)) AS id",
        "l_orderkey AS comid",
        "CAST((l_orderkey div 100) * 20 + l_partkey % 20 AS DOUBLE) AS x",
        "CAST((l_orderkey % 100) * 20 + l_suppkey % 20 AS DOUBLE) AS y",
        "l_quantity AS h", "l_discount * 100 - 4 AS dz", "l_tax * 50 AS canopy", "l_extendedprice AS price",
        "l_returnflag AS flag")


def lines(spark, d):
    return table(spark, d, "part").selectExpr(
        "p_partkey AS line_id", "p_type AS kind", "p_size AS size",
        "array(struct(1.5D * p_partkey AS x, 40.0D * p_size AS y), "
        "struct(1.5D * p_partkey + 60 AS x, 40.0D * p_size + 20 AS y), "
        "struct(1.5D * p_partkey + 60 + p_retailprice / 20 AS x, 40.0D * p_size + 80 AS y)) AS pts")


def tracks(spark, d):
    e = table(spark, d, "events")
    return e.select(
        "event_id", F.col("user_id").alias("track"), F.col("event_type").alias("beam"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1e9).alias("x"),
        F.col("value").alias("y"), F.col("value").alias("h"), F.col("ts").cast("timestamp").alias("ts"))


def patches(spark, d):
    return table(spark, d, "embeddings").selectExpr(
        "vec_id", "format_string('p_%07d', vec_id) AS patch_id", "concat('r', label % 2) AS region",
        "CASE label % 3 WHEN 0 THEN 'L' WHEN 1 THEN 'M' END AS category",
        "CASE WHEN label < 5 THEN 'positive' ELSE 'negative' END AS patch_type",
        "CAST(label AS BIGINT) AS label_id", "CAST(embedding AS ARRAY<DOUBLE>) AS value",
        "transform(embedding, v -> least(1.0D, greatest(0.0D, CAST(v AS DOUBLE) + 0.5D))) AS prob",
        "transform(embedding, (v, i) -> CASE WHEN ((i * 7 + vec_id) % 3 = 0 AND v > -0.05) OR v > 0.15 THEN 1 ELSE 0 END) AS label")


def pixels(spark, d):
    """One row per array element: raster_id, row, col (8 x 8), value, score, truth."""
    p = patches(spark, d).select("vec_id", "label_id", F.posexplode(F.arrays_zip("value", "prob", "label")).alias("i", "_z"))
    return p.selectExpr(
        "vec_id AS raster_id", "label_id", "CAST(i AS BIGINT) AS i", "CAST(i div 8 AS BIGINT) AS row", "CAST(i % 8 AS BIGINT) AS col",
        "_z.value AS value", "_z.prob AS score", "_z.label AS truth")


def mosaic(spark, d):
    """All patches laid out as one raster of 16 patches per row band."""
    return pixels(spark, d).selectExpr(
        "raster_id div 16 * 8 + row AS row", "raster_id % 16 * 8 + col AS col", "value", "score", "truth", "raster_id")


def results(spark, d):
    from bermline.operators.metrics import confusion_counts, count_metrics
    p = patches(spark, d).select("patch_id", "region", "category", "patch_type", "prob", "label")
    return count_metrics(confusion_counts(p))


def docs(spark, d):
    x = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    y = table(spark, d, "labels")
    return x.join(y, "doc_id").selectExpr(
        "doc_id", "lang AS region", "source", "CASE WHEN n_chars >= 1000 THEN 'L' ELSE 'M' END AS category",
        "CASE WHEN quality = 1 THEN 'positive' ELSE 'negative' END AS patch_type", "n_chars",
        "CAST(quality AS DOUBLE) AS truth", "CAST(1 - toxic AS DOUBLE) AS score")


def hourly(spark, d):
    """run, hour (index from the first day), volume in 1e6 m3, largest level change of the hour."""
    e = table(spark, d, "events")
    return (e.groupBy(F.col("event_type").alias("run"), F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("_h"))
            .agg((F.sum("value") / 1000).alias("volume_mil_m3"), F.max("value").alias("dz_max_m"))
            .select("run", F.floor(F.unix_micros("_h") / 3.6e9 - 473352).alias("hour"), "volume_mil_m3", "dz_max_m"))


def cells_hourly(spark, d):
    """Levels per run, cell and hour: ten steps derived from each pixel of the mosaic."""
    m = mosaic(spark, d).select("row", "col", "value", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("hour"))
    return m.selectExpr(
        "concat('run', row div 8 % 2) AS run", "CAST(hour AS BIGINT) AS hour", "row", "col",
        "value * hour / 9.0D + 0.1D AS zs", "0.02D AS zb")


def segments(spark, d):
    """Line items as levee segments with reach key."""
    return points(spark, d).selectExpr("id AS segment_id", "x", "y", "price / 100 AS length_m")


def scenes(spark, d):
    """Suppliers as scene footprints on a cell grid of 20 x 20 per block of 100 suppliers."""
    return table(spark, d, "supplier").selectExpr(
        "s_suppkey AS scene_id", "s_suppkey div 100 AS block",
        "CAST(s_suppkey * 7 % 20 AS BIGINT) AS cx0", "CAST(s_suppkey * 13 % 20 AS BIGINT) AS cy0",
        "4 + s_suppkey % 9 AS w", "4 + s_nationkey % 7 AS hh")


SQL = {
    "reaches": """SELECT o_orderkey AS comid, CASE WHEN o_orderkey < 64 THEN 0 ELSE o_orderkey // 2 END AS next_down,
        o_totalprice AS uparea, CAST((o_orderkey // 100) * 20 + (37 * o_orderkey) % 17 AS DOUBLE) AS x,
        CAST((o_orderkey % 100) * 20 + (91 * o_orderkey) % 13 AS DOUBLE) AS y FROM orders""",
    "points": """SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(trunc(l_quantity) AS BIGINT),
        CAST(trunc(l_extendedprice * 100) AS BIGINT)) AS id, l_orderkey AS comid,
        CAST((l_orderkey // 100) * 20 + l_partkey % 20 AS DOUBLE) AS x,
        CAST((l_orderkey % 100) * 20 + l_suppkey % 20 AS DOUBLE) AS y, l_quantity AS h, l_discount * 100 - 4 AS dz,
        l_tax * 50 AS canopy, l_extendedprice AS price, l_returnflag AS flag FROM lineitem""",
    "lines": """SELECT p_partkey AS line_id, p_type AS kind, p_size AS size, 1.5 * p_partkey AS ax, 40.0 * p_size AS ay,
        1.5 * p_partkey + 60 AS bx, 40.0 * p_size + 20 AS by_, 1.5 * p_partkey + 60 + p_retailprice / 20 AS cx,
        40.0 * p_size + 80 AS cy FROM part""",
    "line_edges": """SELECT line_id, 0 AS edge, CAST(ax AS DOUBLE) AS x0, CAST(ay AS DOUBLE) AS y0, CAST(bx AS DOUBLE) AS x1, CAST(by_ AS DOUBLE) AS y1 FROM lines
        UNION ALL SELECT line_id, 1, CAST(bx AS DOUBLE), CAST(by_ AS DOUBLE), CAST(cx AS DOUBLE), CAST(cy AS DOUBLE) FROM lines""",
    "line_len": "SELECT line_id, sum(sqrt((x1-x0)^2 + (y1-y0)^2)) AS len FROM line_edges GROUP BY line_id",
    "tracks": """SELECT event_id, user_id AS track, event_type AS beam, epoch_us(ts) / 1e6 AS t, epoch_us(ts) / 1e9 AS x,
        value AS y, value AS h, ts FROM events""",
    "px0": "SELECT vec_id, label AS label_id, unnest(range(64)) AS i, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings",
    "pixels": """SELECT vec_id AS raster_id, CAST(label_id AS BIGINT) AS label_id, i, i // 8 AS row, i % 8 AS col, value,
        least(1.0, greatest(0.0, value + 0.5)) AS score,
        CASE WHEN ((i * 7 + vec_id) % 3 = 0 AND value > -0.05) OR value > 0.15 THEN 1 ELSE 0 END AS truth FROM px0""",
    "patch_meta": """SELECT vec_id, printf('p_%07d', vec_id) AS patch_id, 'r' || (label % 2) AS region,
        CASE label % 3 WHEN 0 THEN 'L' WHEN 1 THEN 'M' END AS category,
        CASE WHEN label < 5 THEN 'positive' ELSE 'negative' END AS patch_type, label AS label_id FROM embeddings""",
    "mosaic": "SELECT raster_id // 16 * 8 + row AS row, raster_id % 16 * 8 + col AS col, value, score, truth, raster_id FROM pixels",
    "confusion": """SELECT m.patch_id, m.region, m.category, m.patch_type,
        count(*) FILTER (score > 0.5 AND truth = 1) AS tp, count(*) FILTER (score > 0.5 AND truth = 0) AS fp,
        count(*) FILTER (score <= 0.5 AND truth = 1) AS fn, count(*) FILTER (score <= 0.5 AND truth = 0) AS tn
        FROM pixels p JOIN patch_meta m ON p.raster_id = m.vec_id GROUP BY ALL""",
    "results0": "SELECT *, tp / (tp + fp + 1e-6) AS precision, tp / (tp + fn + 1e-6) AS recall, tp / (tp + fp + fn + 1e-6) AS iou, 2 * tp / (2 * tp + fp + fn + 1e-6) AS dice FROM confusion",
    "results": "SELECT *, 2 * precision * recall / (precision + recall + 1e-6) AS f1 FROM results0",
    "docs": """SELECT d.doc_id, lang AS region, source, CASE WHEN n_chars >= 1000 THEN 'L' ELSE 'M' END AS category,
        CASE WHEN quality = 1 THEN 'positive' ELSE 'negative' END AS patch_type, n_chars, CAST(quality AS DOUBLE) AS truth,
        CAST(1 - toxic AS DOUBLE) AS score FROM documents d JOIN labels l USING (doc_id)""",
    "hourly": """SELECT event_type AS run, CAST(epoch_us(date_trunc('hour', ts)) // 3600000000 - 473352 AS BIGINT) AS hour,
        sum(value) / 1000 AS volume_mil_m3, max(value) AS dz_max_m FROM events GROUP BY 1, 2""",
    "cells_hourly": """SELECT 'run' || (row // 8 % 2) AS run, hour, row, col, value * hour / 9.0 + 0.1 AS zs, 0.02 AS zb
        FROM mosaic, range(10) t(hour)""",
    "segments": "SELECT id AS segment_id, x, y, price / 100 AS length_m FROM points",
    "scenes": """SELECT s_suppkey AS scene_id, s_suppkey // 100 AS block, s_suppkey * 7 % 20 AS cx0, s_suppkey * 13 % 20 AS cy0,
        4 + s_suppkey % 9 AS w, 4 + s_nationkey % 7 AS hh FROM supplier""",
}
