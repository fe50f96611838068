"""Benchmark decontamination: a prefix-filtered set join between item windows and documents.

A window is ``size`` consecutive words of an item. Words are ordered by how rare they are in the documents. A document
contains a window only if it contains all its words, so the necessary prefix is one word: the rarest. Documents meet
windows on that word alone; the place of the word in the window then fixes where the window would have to start
(positional bound), the document must have enough words from there (length bound), and the item-sized slice is compared
word by word. Only DataFrame functions run.

Texts meet the vocabulary by the usual lower case, which is fast and merges at least what lower-casing A-Z does; the
exact words are only made of texts with a candidate.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bermline.llm.joins import split_by_keys
from bermline.llm.text import ALNUM
from bermline.session import cut_lineage

WINDOW = 13
BROADCAST_ROWS = 200_000  # window or vocabulary rows that are sent to every task; more are joined by a shuffle
RAW = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # the same words before A-Z are lower-cased
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def whole_text(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """Words of a text after lower-casing A-Z; null has none."""
    return F.regexp_extract_all(F.translate(whole_text(text), _UPPER, _LOWER), F.lit(ALNUM), F.lit(0))


def raw_words(text: Column) -> Column:
    """The same words as they stand."""
    return F.regexp_extract_all(whole_text(text), F.lit(RAW), F.lit(0))


def text_key(text: Column) -> list[Column]:
    """Two hashes that tell texts apart: ``_hash`` (64 bits) and ``_more`` (32 bits)."""
    return [F.xxhash64(whole_text(text)).alias("_hash"), F.hash(whole_text(text)).alias("_more")]


def exact_words(texts: DataFrame, candidates: DataFrame) -> DataFrame:
    """``candidates`` with the exact ``_words`` of their text; ``texts`` has ``_hash, _more, _text``. Copies of a text are merged in each task."""
    some, _ = split_by_keys(texts, "_hash", candidates.select("_hash").distinct())
    once = some.groupBy("_hash", "_more").agg(F.first("_text").alias("_text"))
    return once.select("_hash", "_more", words_of(F.col("_text")).alias("_words")).join(candidates, ["_hash", "_more"])


def _known_everywhere(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def item_windows(items: DataFrame, size: int, item: str, text: str) -> DataFrame:
    """Distinct ``_window`` (words joined by spaces) of each ``_item``; an item of fewer words is one window."""
    w = items.filter(F.col(item).isNotNull()).select(F.col(item).cast("string").alias("_item"), words_of(F.col(text)).alias("_w")).filter("size(_w) > 0")
    return w.select("_item", "_w", F.explode(F.sequence(F.lit(1), F.greatest(F.size("_w") - (size - 1), F.lit(1)))).alias("_i")).select(
        "_item", F.array_join(F.slice("_w", F.col("_i"), F.lit(size)), " ").alias("_window")).distinct()


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW, id: str = "doc_id", text: str = "text",
                  item: str = "item_id", item_text: str = "text", share: int = 20) -> DataFrame:
    """One row per row of ``docs``: ``<id>, text_hash, n_words, n_hit, items, contaminated``.

    ``n_hit`` words lie inside an occurrence of some window; ``items`` are the ids (strings, sorted) of the items with an
    occurring window. ``contaminated``: at least one word is hit, and at least 1/``share`` of all words. Null and empty
    texts have no words; items without words or with a null id are left out; a repeated item counts once. Results depend
    on the text alone, so ids may be null or repeat, and repeated rows repeat their result. Other columns are ignored.
    """
    slim = docs.select(*text_key(F.col(text)), F.col(text).cast("string").alias("_text"))
    owners = item_windows(items, size, item, item_text)
    windows = owners.select("_window").distinct().select("_window", F.split("_window", " ").alias("_w"))
    vocabulary = windows.select(F.explode("_w").alias("_v")).select(F.lower("_v").alias("_known")).distinct()
    counts = (slim.select(F.explode(raw_words(F.col("_text"))).alias("_word")).join(_known_everywhere(vocabulary), F.lower("_word") == F.col("_known"))
              .groupBy("_known").agg(F.count(F.lit(1)).alias("_count")))
    # a window with a word that no document has cannot occur: the inner join drops the word, the size check the window
    ranked = (windows.select("_window", F.size("_w").alias("_len"), F.posexplode("_w").alias("_at", "_v")).join(counts, F.lower("_v") == F.col("_known"))
              .groupBy("_window", "_len").agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("_count", "_known", "_at")).alias("_rare")).filter("_n = _len"))
    probes = cut_lineage(ranked.select("_window", "_len", F.col("_rare._known").alias("_rare"), F.col("_rare._at").alias("_at")))
    places = slim.select("_hash", "_more", F.posexplode(raw_words(F.col("_text"))).alias("_pos", "_word"))
    start = F.col("_pos") - F.col("_at")
    met = places.join(_known_everywhere(probes), (F.lower("_word") == F.col("_rare")) & (start >= 0))
    met = cut_lineage(met.select("_hash", "_more", start.alias("_start"), "_len", "_window").distinct())
    found = exact_words(slim, met).filter((F.col("_start") + F.col("_len") <= F.size("_words"))
                                          & (F.array_join(F.slice("_words", F.col("_start") + 1, F.col("_len")), " ") == F.col("_window")))
    hits = cut_lineage(found.select("_hash", "_more", "_start", "_len", "_window").distinct())
    covered = hits.select("_hash", "_more", F.explode(F.sequence("_start", F.col("_start") + F.col("_len") - 1)).alias("_p")).distinct().groupBy(
        "_hash", "_more").agg(F.count(F.lit(1)).alias("_hit"))
    named = hits.select("_hash", "_more", "_window").distinct().join(owners, "_window").groupBy("_hash", "_more").agg(F.array_sort(F.collect_set("_item")).alias("_items"))
    light = docs.select(F.col(id).alias("_id"), *text_key(F.col(text)), F.size(raw_words(F.col(text))).cast("long").alias("n_words"))
    out = light.join(covered.join(named, ["_hash", "_more"]), ["_hash", "_more"], "left")
    n_hit = F.coalesce("_hit", F.lit(0)).cast("long")
    return out.select(F.col("_id").alias(id), F.col("_hash").alias("text_hash"), "n_words", n_hit.alias("n_hit"),
                      F.coalesce("_items", F.array().cast("array<string>")).alias("items"), ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"))
