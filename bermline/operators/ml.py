"""Boosted trees on sampled pixels and their feature importance."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def class_weights(sample: DataFrame, label: str = "label", weight: str | None = None, out: str = "w") -> DataFrame:
    """Row weight times negatives/positives for positive rows."""
    c = sample.agg((F.count_if(F.col(label) == 0) / F.greatest(F.count_if(F.col(label) == 1), F.lit(1))).alias("_s"))
    base = F.col(weight) if weight else F.lit(1.0)
    return sample.crossJoin(c).withColumn(out, F.when(F.col(label) == 1, base * F.col("_s")).otherwise(base)).drop("_s")  # one row


def train_trees(sample: DataFrame, features: Sequence[str], label: str = "label", weight: str | None = None, seed: int = 42,
                max_iter: int = 100, max_depth: int = 6, step: float = 0.05, subsample: float = 0.8):
    """Gradient-boosted trees with class and row weights; training is distributed by Spark ML."""
    d = class_weights(sample.dropna(subset=list(features)), label, weight)
    d = VectorAssembler(inputCols=list(features), outputCol="_features").transform(d).withColumn("_label", F.col(label).cast("double"))
    gbt = GBTClassifier(featuresCol="_features", labelCol="_label", weightCol="w", maxIter=max_iter, maxDepth=max_depth,
                        stepSize=step, subsamplingRate=subsample, seed=seed)
    return gbt.fit(d)


def score_trees(df: DataFrame, model, features: Sequence[str], out: str = "score") -> DataFrame:
    """Probability of the positive class; rows with a missing feature stay NULL."""
    d = VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="keep").transform(df)
    ok = F.lit(True)
    for f in features:
        ok = ok & F.col(f).isNotNull()
    p = model.transform(d).withColumn(out, F.when(ok, vector_to_array("probability")[1]))
    return p.drop("_features", "rawPrediction", "probability", "prediction")


def importances(model, features: Sequence[str], spark) -> DataFrame:
    """Rank, feature, importance: one row per feature."""
    v = model.featureImportances.toArray()
    ordered = sorted(zip(features, v), key=lambda p: (-p[1], p[0]))
    return spark.createDataFrame([(k, f, float(x)) for k, (f, x) in enumerate(ordered, 1)], "rank int, feature string, importance double")
