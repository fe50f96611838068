"""License scan: ordered signature rules behind a keyword prefilter, overlaps resolved by priority and containment.

A document's words meet the rules on their keyword; only there, and only if the rule's second word is near, its two
expressions are tried on the words before and behind. Of detections where one lies inside another of at least its
priority, the outer one stays. Only DataFrame functions run.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bermline.llm.decontamination import exact_words, raw_words, text_key
from bermline.llm.license_rules import REACH, Rule, rules
from bermline.session import cut_lineage


def rule_table(spark, listed: list[Rule]) -> DataFrame:
    """The rules as rows; a few hundred literals, small enough to be known to every task."""
    return spark.createDataFrame(listed, "rule int, label string, keyword string, before string, after string, near string, priority int, weight double, base boolean")


def detections(docs: DataFrame, text: str = "text", listed: list[Rule] | None = None) -> DataFrame:
    """Every place where a rule matches: ``_hash, _more, start, end, rule, label, priority, weight, base`` (words from 0, end exclusive).

    One row for each place of a text and rule, however many rows have the text. Null texts have no words.
    """
    known = rule_table(docs.sparkSession, listed if listed is not None else rules())
    slim = docs.select(*text_key(F.col(text)), F.col(text).cast("string").alias("_text"))
    places = slim.select("_hash", "_more", F.posexplode(raw_words(F.col("_text"))).alias("_pos", "_word"))
    met = cut_lineage(places.join(F.broadcast(known.select("keyword").distinct()), F.lower("_word") == F.col("keyword")).select("_hash", "_more", "_pos", "keyword").distinct())
    low = F.greatest(F.col("_pos") - REACH, F.lit(0))
    before, behind = F.slice("_words", low + 1, F.col("_pos") - low), F.slice("_words", F.col("_pos") + 2, F.lit(REACH))
    lead = F.concat(F.array_join(before, " "), F.when(F.size(before) > 0, " ").otherwise(""), F.lit("|"))
    tail = F.concat(F.lit("|"), F.when(F.size(behind) > 0, " ").otherwise(""), F.array_join(behind, " "))
    around = exact_words(slim, met).filter(F.element_at("_words", F.col("_pos") + 1) == F.col("keyword")).select(
        "_hash", "_more", "_pos", F.col("keyword").alias("_key"), lead.alias("_lead"), tail.alias("_tail"))
    near = around.join(F.broadcast(known), (F.col("_key") == F.col("keyword")) & (F.col("_lead").contains(F.col("near")) | F.col("_tail").contains(F.col("near"))))
    blanks = lambda c: F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))
    ahead, after = F.regexp_substr("_lead", F.col("before")), F.regexp_substr("_tail", F.col("after"))
    found = near.select("_hash", "_more", "_pos", ahead.alias("_lead"), after.alias("_tail"), "rule", "label", "priority", "weight", "base").filter("_lead IS NOT NULL AND _tail IS NOT NULL")
    return found.select("_hash", "_more", (F.col("_pos") - blanks(F.col("_lead"))).alias("start"), (F.col("_pos") + 1 + blanks(F.col("_tail"))).alias("end"),
                        "rule", "label", "priority", "weight", "base").distinct()


def resolve(found: DataFrame) -> DataFrame:
    """Detections that stay: the base ones, and those not inside another one of at least their priority.

    Of equal intervals the higher priority stays, then the earlier rule.
    """
    order = Window.partitionBy("_hash", "_more").orderBy("start", F.desc("end"), F.desc("priority"), "rule").rowsBetween(Window.unboundedPreceding, -1)
    levels = sorted({r.priority for r in rules() if not r.base})
    own = found.filter("NOT base")
    for p in levels:  # furthest end so far among detections of at least this priority
        own = own.withColumn(f"_reach{p}", F.max(F.when(F.col("priority") >= p, F.col("end"))).over(order))
    reach = F.lit(None).cast("int")
    for p in levels:
        reach = F.when(F.col("priority") == p, F.col(f"_reach{p}")).otherwise(reach)
    stays = own.filter(reach.isNull() | (reach < F.col("end"))).select(*found.columns)
    return found.filter("base").unionByName(stays)


def scan_licenses(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``<id>, n_words, n_base, first_word, last_word, base_labels, labels, score, n_found``.

    ``n_base`` counts the places of base phrases, ``first_word`` and ``last_word`` are their smallest and largest start
    (null if none); labels are distinct, sorted and comma-joined, ``score`` is the largest weight of what stays (0 if
    nothing), ``n_found`` the number of detections that stay. Null and empty texts have no words and no labels. Results
    depend on the text alone: ids may be null or repeat, repeated rows repeat their result. Other columns are ignored.
    """
    kept = resolve(cut_lineage(detections(docs, text)))
    base = F.when(F.col("base"), F.col("start"))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    by_text = kept.groupBy("_hash", "_more").agg(
        F.count(base).alias("n_base"), F.min(base).cast("long").alias("first_word"), F.max(base).cast("long").alias("last_word"),
        joined(F.when(F.col("base"), F.col("label"))).alias("base_labels"), joined(F.col("label")).alias("labels"), F.max("weight").alias("score"), F.count(F.lit(1)).alias("n_found"))
    light = docs.select(F.col(id).alias("_id"), *text_key(F.col(text)), F.size(raw_words(F.col(text))).cast("long").alias("n_words"))
    zero = lambda c, v: F.coalesce(F.col(c), F.lit(v)).alias(c)
    return light.join(by_text, ["_hash", "_more"], "left").select(
        F.col("_id").alias(id), "n_words", zero("n_base", 0), "first_word", "last_word", zero("base_labels", ""), zero("labels", ""), zero("score", 0.0), zero("n_found", 0))
