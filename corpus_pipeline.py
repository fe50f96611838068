"""Training-data pipeline over ``documents``: quality, near duplicates, repeated passages, benchmark passages, mix.

Each stage takes (spark, docs, sf_dir) and returns documents with the columns it got; the last returns the mix, one row
for each document that is left. The runner writes each result and reads it again for the next stage.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bermline.llm.decontamination import contamination
from bermline.llm.joins import split_by_keys
from bermline.llm.mixing import mix_sources
from bermline.llm.ngram_join import near_duplicates
from bermline.llm.quality import THRESHOLD, fit_quality, score_quality
from bermline.llm.substrings import remove_repeats
from bermline.llm.text import bounded_batches
from bermline.session import cut_lineage


def _without(rows: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """Rows whose key is not among the distinct keys ``gone``; rows with a null key stay."""
    _, rest = split_by_keys(rows, key, gone)
    name = gone.columns[0]
    return rest if rest is not None else rows.join(gone, rows[key] == gone[name], "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labelled ones that are not held out, doesn't reject."""
    bounded_batches(spark)
    weights = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_quality(docs, weights, keep=docs.columns, out="_kept_score").filter(F.col("_kept_score") >= THRESHOLD).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates. Rows without an id stay."""
    bounded_batches(spark)
    classes = near_duplicates(docs)
    return _without(docs, "doc_id", cut_lineage(classes.filter("doc_id <> class_id").select("doc_id")))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that earlier documents have; a document that loses every word goes."""
    bounded_batches(spark)
    own = {c: f"_own_{c}" for c in ("n_words", "n_removed", "kept_text") if c in docs.columns}
    cut = remove_repeats(docs.withColumnsRenamed(own))
    lost = F.col("n_removed") > 0
    cut = cut.filter(~lost | (F.col("n_removed") < F.col("n_words"))).withColumn("text", F.when(lost, F.col("kept_text")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(lost, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return cut.drop("n_words", "n_removed", "kept_text").withColumnsRenamed({v: k for k, v in own.items()}).select(*docs.columns)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    gone = cut_lineage(found.filter("contaminated").select(F.xxhash64("doc_id", "text_hash").alias("_gone")).distinct())
    name = "_document" + "_" * max(map(len, docs.columns))  # longer than any column of the table
    keyed = docs.withColumn(name, F.xxhash64("doc_id", F.xxhash64(F.coalesce(F.col("text"), F.lit("")))))
    return _without(keyed, name, gone).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often each document is taken, so that sources come to their target weights."""
    return mix_sources(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_copies", near_copies),
    ("repeated_passages", repeated_passages),
    ("benchmark_passages", benchmark_passages),
    ("mix", mix),
]
ORACLE_SQL = None  # a trained classifier and a balanced draw have no SQL form; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents that pass the stages; each stage is cut off from the one before."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
