"""Incremental twins of batch operators."""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from bermline.sources.lidar import GRANULE, flatten_granules


def stream_granules(spark: SparkSession, path: str, schema: T.StructType = GRANULE, max_files: int | None = None, **kw) -> DataFrame:
    """Flattened points of granule files as they arrive; the file source and the checkpoint make each file count once."""
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return flatten_granules(r.parquet(path), **kw)


def ingest_granules(spark: SparkSession, path: str, out: str, checkpoint: str, **kw) -> None:
    """Process what is new and stop; a second run adds only new files."""
    q = (stream_granules(spark, path, **kw).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()


def stream_moments(stream: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Running count, mean and population deviation per key, for ``update`` mode."""
    return stream.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def run_updates(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Append every batch of updated rows with its batch id to a table; the last batch of a key is its state."""
    def sink(df: DataFrame, batch: int) -> None:
        # the folder name carries the batch id; a repeated batch replaces its own folder
        df.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    q = stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
    q.awaitTermination()


def latest_updates(spark: SparkSession, out: str, keys: Sequence[str]) -> DataFrame:
    d = spark.read.parquet(out)
    rest = [c for c in d.columns if c not in keys and c != "batch"]
    m = d.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_m"))
    return m.select(*keys, *[F.col(f"_m.{c}").alias(c) for c in rest])


def hourly_volumes(stream: DataFrame, watermark: str = "1 hour", ts: str = "ts", value: str = "value", run: str = "run") -> DataFrame:
    """Tumbling hourly volume per run; rows later than the watermark drop out, an hour is emitted when it is closed."""
    return (stream.withWatermark(ts, watermark).groupBy(F.col(run), F.window(ts, "1 hour").alias("w"))
            .agg((F.sum(value) / 1000).alias("volume_mil_m3"), F.max(value).alias("dz_max_m"))
            .select(run, F.col("w.start").alias("hour_start"), "volume_mil_m3", "dz_max_m"))


class _Lag(StatefulProcessor):
    """Keeps the last closed hour of a run and emits the change to it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._last = handle.getValueState("last", "volume double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        d = pd.concat(list(rows)).sort_values("hour_start")
        prev = self._last.get()[0] if self._last.exists() else None
        out = []
        for h, v, z, q in zip(d["hour_start"], d["volume_mil_m3"], d["dz_max_m"], d["q_in"]):
            dv = None if prev is None else (v - prev) * 1e6 / 3600.0
            out.append((key[0], h, v, z, dv, None if dv is None or not q or pd.isna(q) else dv / q * 100))
            prev = v
        self._last.update((float(prev),))
        yield pd.DataFrame(out, columns=["run", "hour_start", "volume_mil_m3", "dz_max_m", "dV_dt_m3s", "dV_dt_pct_inflow"])

    def close(self) -> None:
        pass


def stream_steadiness(hours: DataFrame, inflow: DataFrame, pct: float = 1.0, dz: float = 0.05) -> DataFrame:
    """Change between closed hours and the steady flag, from the output of :func:`hourly_volumes`.

    The state is one number per run. Closed hours arrive in event-time order
    because the watermark closes them.
    """
    h = hours.join(inflow.select("run", "q_in"), "run", "left")
    d = h.groupBy("run").transformWithStateInPandas(
        _Lag(), "run string, hour_start timestamp, volume_mil_m3 double, dz_max_m double, dV_dt_m3s double, dV_dt_pct_inflow double", "Append", "None")
    return d.withColumn("steady", F.coalesce(F.abs("dV_dt_pct_inflow") < pct, F.col("dz_max_m") < dz))
