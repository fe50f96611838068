"""One query per operator, with production parameters, over its whole table."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bermline.llm.chat import format_conversations, masked_text, read_turns
from bermline.llm.decontamination import contamination
from bermline.llm.extraction import extract, fit_extractor
from bermline.llm.filter_audit import audit_documents
from bermline.llm.fingerprints import compare_neighbours
from bermline.llm.language import fit_languages, identify
from bermline.llm.licenses import scan_licenses
from bermline.llm.mixing import mix_sources
from bermline.llm.ngram_join import near_duplicates
from bermline.llm.quality import THRESHOLD, fit_quality, score_quality
from bermline.llm.ranked_search import rank_documents
from bermline.llm.registry import QUERIES, SQL, query  # noqa: F401
from bermline.llm.sampling import held_out
from bermline.llm.substrings import remove_repeats
from bermline.llm.suffix_dedup import remove_repeated_bytes
from bermline.llm.text import ALNUM, SPACED


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


OP6_SQL = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{SPACED}') AS ws FROM documents),
     win AS (SELECT doc_id, i, array_to_string(ws[i : i + 49], ' ') AS k FROM w, unnest(range(1, len(ws) - 48)) r(i)),
     firsts AS (SELECT k, min(doc_id) AS first_id FROM win GROUP BY k HAVING min(doc_id) < max(doc_id)),
     gone AS (SELECT DISTINCT doc_id, i + o AS p FROM win JOIN firsts USING (k), range(50) r(o) WHERE doc_id > first_id),
     words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
     kept AS (SELECT words.doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n_kept, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)"""


@query("op6_substring_dedup", OP6_SQL)
def op6(spark, d):
    return remove_repeats(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP2_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{ALNUM}') AS ws FROM documents),
     g AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS k FROM w, unnest(range(1, greatest(len(ws) - 3, 2))) r(i) WHERE len(ws) > 0),
     sz AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
     pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b USING (k) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
     link AS MATERIALIZED (SELECT a, b FROM pairs JOIN sz x ON x.doc_id = a JOIN sz y ON y.doc_id = b WHERE 5 * c >= 4 * (x.n + y.n - c)),
     reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT reach.doc_id, link.b FROM reach JOIN link ON link.a = reach.other)
SELECT doc_id, min(other) AS class_id, (SELECT count(*) FROM link WHERE link.a = reach.doc_id) AS n_links FROM reach GROUP BY doc_id"""


@query("op2_ngram_jaccard_join", OP2_SQL)
def op2(spark, d):
    return near_duplicates(table(spark, d, "documents").select("doc_id", "text"))


OP5_SQL = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{ALNUM}') AS ws FROM documents),
     b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{ALNUM}') AS ws FROM benchmark),
     win AS (SELECT DISTINCT item_id, least(len(ws), 13) AS n, array_to_string(ws[i : i + least(len(ws), 13) - 1], ' ') AS k FROM b, unnest(range(1, greatest(len(ws) - 11, 2))) r(i) WHERE len(ws) > 0),
     sizes AS (SELECT DISTINCT n FROM win),
     places AS (SELECT doc_id, i, n, array_to_string(ws[i : i + n - 1], ' ') AS k FROM w, sizes, unnest(range(1, len(ws) + 1)) r(i) WHERE i + n - 1 <= len(ws)),
     hits AS (SELECT DISTINCT doc_id, i, places.n, item_id FROM places JOIN win USING (k)),
     cover AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY 1),
     named AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS t FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hits) GROUP BY 1)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(t, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM w LEFT JOIN cover USING (doc_id) LEFT JOIN named USING (doc_id)"""


@query("op5_benchmark_decontamination", OP5_SQL)
def op5(spark, d):
    found = contamination(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


@query("op4_license_scans")
def op4(spark, d):
    return scan_licenses(table(spark, d, "documents").select("doc_id", "text"))


@query("op3_quality_classifier")
def op3(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    scored = score_quality(docs, fit_quality(docs, table(spark, d, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


@query("op1_language_id")
def op1(spark, d):
    docs = table(spark, d, "documents")
    told = identify(docs, fit_languages(docs), keep=["doc_id"])
    return told.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


@query("op7_document_fingerprints")
def op7(spark, d):
    seen = compare_neighbours(table(spark, d, "documents").select("doc_id", "text"))
    return seen.select("doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


@query("op8_mixing_sources_to_target_weights")
def op8(spark, d):
    return mix_sources(table(spark, d, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP10_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(24 + length(replace(replace(role, '\', '\\'), '<|', '\<|')) + length(replace(replace(text, '\', '\\'), '<|', '\<|')))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id"""


@query("op10_chat_formatting", OP10_SQL)
def op10(spark, d):
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    made = format_conversations(table(spark, d, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra))
    loss = masked_text(F.col("formatted"), F.col("loss_start"), F.col("loss_end"))
    digests = made.select("conv_id", F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
    turns = read_turns(made).groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), F.array_sort(F.collect_list(F.struct("pos", "role", "text"))).alias("_turns"))
    text = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return digests.join(turns, digests["conv_id"].eqNullSafe(turns["conv_id"])).select(
        digests["conv_id"], "n_turns", F.sha2(text, 256).alias("turns_sha256"), "loss_chars", "loss_sha256", "formatted_chars")


@query("op9_html_extraction")
def op9(spark, d):
    return extract(table(spark, d, "pages"), fit_extractor(spark), keep=["page_id", "url"]).withColumn("n_chars", F.length("text").cast("long"))


OP12_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
     w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS first_id FROM d),
     f AS (SELECT doc_id, part, (len(ws) < 200)::INT + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::INT + 4 * (100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::INT
             + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * (doc_id > first_id)::INT AS fails FROM w),
     g AS (SELECT part, fails, count(*) AS n, count(*) FILTER (quality = 1) AS n_good, count(*) FILTER (toxic = 1) AS n_toxic FROM f LEFT JOIN labels USING (doc_id) GROUP BY 1, 2),
     l AS (SELECT unnest([0, 1, 2, 3, 4]) AS k),
     o AS (SELECT [a.k, b.k, c.k, d.k, e.k] AS ks FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
     s AS (SELECT array_to_string(['ABCDE'[x + 1] for x in ks], '') AS filter_order, step::INT AS step, (1 << ks[step])::INT AS own,
             coalesce(list_sum([1 << x for x in ks[1 : step - 1]]), 0)::INT AS before FROM o, range(1, 6) r(step)),
     x AS (SELECT *, (fails & own) > 0 AS o, (fails & before) > 0 AS b FROM g, s)
SELECT part, filter_order, step, coalesce(sum(n) FILTER (NOT o AND NOT b), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (o AND NOT b), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (o AND b), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails = own), 0)::BIGINT AS unique_fails,
  coalesce(sum(n_good) FILTER (o AND NOT b), 0)::BIGINT AS good_lost, coalesce(sum(n_toxic) FILTER (o AND NOT b), 0)::BIGINT AS toxic_lost,
  coalesce(sum(n * 120 // greatest(bit_count(fails), 1)) FILTER (o), 0)::BIGINT AS shapley
FROM x GROUP BY 1, 2, 3"""


@query("op12_filter_interaction_audit", OP12_SQL)
def op12(spark, d):
    return audit_documents(table(spark, d, "documents"), table(spark, d, "labels"))


OP11_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{ALNUM}') AS ws FROM documents),
     i AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{ALNUM}')) AS term FROM benchmark),
     q AS (SELECT item_id, term, count(*) AS repeats FROM i GROUP BY 1, 2),
     total AS (SELECT count(*) FILTER (len(ws) > 0) AS nn, sum(len(ws))::BIGINT AS ll FROM d),
     words AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS term FROM d),
     tf AS (SELECT doc_id, n, term, count(*) AS tf FROM words SEMI JOIN q USING (term) GROUP BY 1, 2, 3),
     df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
     w AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM df, total),
     s AS (SELECT item_id, doc_id, sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * nn) // ll))))::BIGINT AS score
           FROM q JOIN w USING (term) JOIN tf USING (term), total GROUP BY 1, 2),
     r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 10"""


@query("op11_ranked_lexical_search", OP11_SQL)
def op11(spark, d):
    return rank_documents(table(spark, d, "documents"), table(spark, d, "benchmark"))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS hx FROM documents),
     c AS (SELECT doc_id, a, substr(hx, 2 * a + 1, 2 * 699) AS hx FROM d, unnest(range(0, greatest(len(hx) // 2 - 199, 0), 500)) r(a)),
     s AS (SELECT doc_id, a + p AS p, md5(substr(hx, 2 * p + 1, 400)) AS k FROM c, unnest(range(0, len(hx) // 2 - 199)) r(p)),
     twice AS (SELECT k FROM s GROUP BY k HAVING count(*) > 1),
     hit AS (SELECT doc_id, p, p > coalesce(lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 200, -1) AS opens FROM s SEMI JOIN twice USING (k)),
     numbered AS (SELECT doc_id, p, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM hit),
     runs AS (SELECT doc_id, min(p) AS a, max(p) + 200 AS z FROM numbered GROUP BY doc_id, run),
     gaps AS (SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS z0, a, z FROM runs),
     told AS (SELECT doc_id, count(*) AS n_spans, sum(z - a) AS n_removed, string_agg(substr(hx, 2 * z0 + 1, 2 * (a - z0)), '' ORDER BY a) || substr(any_value(hx), 2 * max(z) + 1) AS kept
              FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, len(hx) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, hx))) AS kept_sha256
FROM d LEFT JOIN told USING (doc_id)"""


@query("op13_suffix_array_dedup", OP13_SQL)
def op13(spark, d):
    cut = remove_repeated_bytes(table(spark, d, "documents"), keep=["doc_id"])
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"))
