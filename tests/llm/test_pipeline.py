"""The pipeline's stages against brute force on one small corpus."""
import random

import pytest
from pyspark.sql import functions as F
from test_llm import SF, brute_links, brute_repeats, prose, words

import corpus_pipeline as P


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(11)
    rows = [(i, prose(r, 60), "en", f"s{i % 3}", 1) for i in range(30)]
    shared = prose(r, 60)
    rows += [(40, rows[0][1], "en", "s0", 1), (41, rows[1][1] + " more", "en", "s1", 1), (42, prose(r, 30) + " " + shared, "en", "s2", 1), (43, shared + "\n" + prose(r, 30), None, None, None),
             (44, None, "en", "s0", 0), (45, "", "en", "s0", 0), (None, prose(r, 20), "en", "s0", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_near_copies(spark, docs):
    rows = [(x.doc_id, x.text) for x in docs.collect() if x.doc_id is not None]
    keep = {id for id, (cls, _) in brute_links(rows).items() if id == cls} | {None}
    out = P.near_copies(spark, docs, SF)
    assert {x.doc_id for x in out.collect()} == keep and out.columns == docs.columns


def test_repeated_passages(spark, docs):
    extra = docs.withColumn("n_words", F.lit("mine"))
    out = P.repeated_passages(spark, extra, SF)
    assert out.schema.names == extra.schema.names
    want = {(id, t if cut else None) for (id, n, cut, t) in brute_repeats([(x.doc_id, x.text) for x in docs.collect()], 50) if not n or cut < n}
    text = {x.doc_id: x.text for x in docs.collect()}
    assert {(x.doc_id, x.text) for x in out.collect()} == {(id, text[id] if t is None else t) for id, t in want}
    assert all(x.n_chars == len(x.text) for x in out.collect() if x.text and x.text != text[x.doc_id])


def test_benchmark_passages(spark, docs):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    more = docs.unionByName(spark.createDataFrame([(90, "so " + item.upper(), "en", "s0", 1), (91, "long " * 9000 + item, "en", "s0", 1)], docs.schema))
    kept = {x.doc_id for x in P.benchmark_passages(spark, more, SF).collect()}
    n = len(words(item))
    assert 90 not in kept and (91 in kept) == (20 * n < n + 9000) and kept >= {x.doc_id for x in docs.collect()}


def test_stages_pass_on_columns(spark):
    out = spark.read.parquet(f"{SF}/documents.parquet")
    names = out.columns
    for name, stage in P.STAGES:
        before = out.count()
        out = stage(spark, out, SF)
        out.cache()
        assert 0 < out.count() <= before and (name == "mix" or out.columns == names)
    assert sorted(map(str, out.collect())) == sorted(map(str, P.run(spark, SF).collect()))
    for _, stage in P.STAGES:
        assert stage(spark, spark.read.parquet(f"{SF}/documents.parquet").filter("false"), SF).count() == 0
