"""Session settings the operators rely on, and reliable lineage cutting."""
from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "bermline", master: str | None = None, **conf) -> SparkSession:
    """A session with UTC timestamps, AQE and skew handling switched on."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # split a hot cell even where the next aggregation then needs a shuffle of its own
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        # grouped percentiles and lists: many small groups per task are normal here
        "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "65536",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update({k: str(v) for k, v in conf.items()})
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster.

    Only a local session without any setting gets a folder of its own: on a
    cluster a machine-local folder would be lost with its executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        configured = tempfile.mkdtemp(prefix="spark-ckpt-", dir="/tmp")
    sc.setCheckpointDir(configured)
    return configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    Iterative operators call this once per round, so that neither the plan nor
    the recomputation after a lost executor grows with the number of rounds.
    They give the round before to ``drop_cut``, or the disk would fill with them.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    cut = df.checkpoint(eager=True)
    # A checkpoint keeps the planner's size estimate, and a join's estimate is the product of its sides: in a loop the number
    # of its digits doubles with every round, until the planner only multiplies. Such an estimate is left behind as well.
    plan = cut._jdf.queryExecution()
    files = plan.analyzed().rdd().getCheckpointFile().get()
    if plan.optimizedPlan().stats().sizeInBytes() >= 2 ** 62:
        cut = DataFrame(spark._jsparkSession.internalCreateDataFrame(plan.toRdd(), cut._jdf.schema(), False), spark)
    cut._checkpoint_files = files
    return cut


def drop_cut(df: DataFrame) -> None:
    """Delete the files of a cut (as ``cut_lineage`` returned it) that nothing reads any more."""
    files = getattr(df, "_checkpoint_files", None)
    if files:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(files)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
