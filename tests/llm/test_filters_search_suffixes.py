"""Ranked search, filter audit and suffix dedup against brute force, and their edge cases."""
import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bermline.llm import filter_audit, ranked_search, suffix_dedup
from bermline.llm.filter_audit import audit_documents, filter_interactions, measure_texts
from bermline.llm.queries import QUERIES
from bermline.llm.ranked_search import rank_documents
from bermline.llm.suffix_dedup import deep_shallow_sort, remove_repeated_bytes

DOCS = "doc_id long, text string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


# --- ranked search

def brute_ranking(docs, items, top=10):
    words = [(i, TERM.findall(lower(t))) for i, t in docs]
    n_docs, n_terms = sum(bool(w) for _, w in words), sum(len(w) for _, w in words)
    df, out = Counter(x for _, w in words for x in set(w)), []
    for item, text in dict.fromkeys(items):
        scored = []
        for id, w in words:
            tf, score = Counter(w), 0
            m = 25 + (75 * len(w) * n_docs) // n_terms if n_terms else 0
            for t in TERM.findall(lower(text)):
                if tf[t]:
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * tf[t]) // (1000 * tf[t] + 8 * m))
            if score > 0:
                scored.append((-score, id is None, id or 0, id))
        out += [(item, k + 1, id, -s) for k, (s, _, _, id) in enumerate(sorted(scored)[:top])]
    return Counter(out)


def found(df):
    return Counter((x.item_id, x["rank"], x.doc_id, x.score) for x in df.collect())


def test_search_equals_brute_force(spark):
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)] + ["Ärger", "ÄRGER", "café", "the"]
    text = lambda n: " ".join(r.choice(vocabulary[: r.choice([5, 20, 64])]) for _ in range(n))
    docs = [(i, text(r.randrange(0, 60))) for i in range(300)]
    docs += [(300, None), (301, ""), (302, "?!"), (None, text(20)), (5, "w1 w2 w3"), (5, "w1 w2 w3"), (303, text(30000)), *[(400 + i, "w7 w8 w9 The") for i in range(40)]]
    items = [(i, text(r.randrange(1, 30))) for i in range(12)] + [(20, None), (21, ""), (22, "unseen"), (23, "w7 w7 W8"), (23, "w7 w7 W8"), (23, "w1"), (None, "w2"), (24, " ".join(vocabulary * 3 + [f"z{i}" for i in range(90)]))]
    dd, ii = spark.createDataFrame([(a, b, 1.0) for a, b in docs], DOCS + ", score double"), spark.createDataFrame([(a, b, 0) for a, b in items], "item_id long, text string, rank int")
    want = brute_ranking(docs, items)
    assert found(rank_documents(dd, ii)) == want
    assert found(rank_documents(dd.repartition(7), ii, pass_bytes=200)) == want
    assert found(rank_documents(dd, ii, top=3)) == brute_ranking(docs, items, 3)


def test_search_without_rows(spark):
    empty, docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a b")], DOCS), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert rank_documents(empty, items).count() == 0 and rank_documents(docs, items.filter("false")).count() == 0
    assert rank_documents(docs, spark.createDataFrame([(1, None)], "item_id long, text string")).count() == 0


def test_search_scores_few_documents():
    """Most groups of masks end below the bound, in one block and over blocks."""
    import pyarrow as pa
    r = random.Random(9)
    texts = [" ".join(r.choice("a b c d e f g h".split()) for _ in range(12)) + (" rare" if i % 300 == 7 else "") for i in range(3000)]
    items = ranked_search.Items(["a rare b"])
    block = ranked_search.Block(items.vocabulary, pa.array(texts))
    block.factors(3000, 3000 * 12)
    df = np.diff(block.bounds)
    weights = np.array([ranked_search.term_weight(3000, x) for x in df])
    best = ranked_search.Best(10)
    scored = ranked_search.search_block(block, items.terms[0], weights[items.terms[0]], best, np.arange(3000), np.zeros(3000, bool))
    assert scored < 300 and all(i % 300 == 7 for i in best.id)


# --- filter audit

def brute_counts(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    return len(w), len(set(w)), len(t), sum("A" <= c <= "Z" for c in t), sum(c in "#$%&*|" for c in t)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("aB #é\n\x0b€😀Z %|"), max_size=40), min_size=1, max_size=6))
def test_transducer_equals_brute_force(texts):
    raw = [t.encode() for t in texts]
    got = filter_audit.transduce(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    assert list(zip(*(got[c].tolist() for c in filter_audit.COUNTS))) == [brute_counts(t) for t in texts]


def test_hash_table_tells_equal_hashes_apart():
    words = ["a", "b", "a", "x" * 70, "x" * 69 + "y", "x" * 70, "ab" * 10, "ab" * 9 + "ac", "b"]
    data = np.frombuffer("".join(words).encode(), np.uint8)
    end = np.cumsum([len(w) for w in words])
    row = np.array([0, 0, 0, 0, 0, 0, 1, 1, 1])
    got = filter_audit.distinct_words(data, end - [len(w) for w in words], end, row, 3, np.zeros(9, np.uint64))
    assert got.tolist() == [4, 3, 0]


def brute_audit(docs, labels):
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    firsts = defaultdict(list)
    for id, t, _ in docs:
        if id is not None:
            firsts[t or ""].append(id)
    rows = []
    for id, t, lang in docs:
        n, d, c, up, sign = brute_counts(t)
        own = firsts[t or ""]
        fails = {k for k, v in zip("ABCDE", (n < 200, 100 * d < 50 * n, 100 * up > 3 * c, sign > 0, any(id is None or x < id for x in own))) if v}
        rows.append((lang or "", fails, id is not None and id in good, id is not None and id in toxic))
    out, shapley = {}, Counter()
    for part in {p for p, *_ in rows}:
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                x = Counter()
                for p, fails, g, b in rows:
                    if p != part:
                        continue
                    early = bool(fails & set(order[: step - 1]))
                    x["kept"] += not early and f not in fails
                    gone = not early and f in fails
                    x["removed"] += gone
                    x["redundant"] += early and f in fails
                    x["unique"] += fails == {f}
                    x["good"] += gone and g
                    x["toxic"] += gone and b
                shapley[part, f] += x["removed"]
                out[part, "".join(order), step] = x
    return {(p, o, s): (x["kept"], x["removed"], x["redundant"], x["unique"], x["good"], x["toxic"], shapley[p, o[s - 1]]) for (p, o, s), x in out.items()}


def test_audit_equals_brute_force(spark):
    r = random.Random(8)
    word = lambda: r.choice(["house", "River", "UPPER", "tree", "x#y", "été"] + [f"n{i}" for i in range(150)])
    docs = [(i, " ".join(word() for _ in range(r.choice([20, 190, 210, 400]))), r.choice(["de", "en", None, ""])) for i in range(60)]
    docs += [(100 + i, docs[i % 5][1], "en") for i in range(12)] + [(200, None, None), (201, "", "de"), (None, docs[0][1], "de"), (None, None, None), (100, docs[0][1], "de"), (202, "a b " * 9000, "en")]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1])) for i in range(0, 110, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (999, 1, 1)]
    df = spark.createDataFrame([(*x, 0) for x in docs], "doc_id long, text string, lang string, n_words int")
    got = audit_documents(df, spark.createDataFrame([(*x, "z") for x in labels], "doc_id long, quality int, toxic int, lang string")).collect()
    assert {(x.part, x.filter_order, x.step): (x.kept, x.removed, x.redundant, x.unique_fails, x.good_lost, x.toxic_lost, x.shapley) for x in got} == brute_audit(docs, labels)
    assert len(got) == 3 * 600


def test_audit_edges(spark):
    docs, labels = spark.createDataFrame([], DOCS + ", lang string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit_documents(docs, labels).count() == 0
    rows = measure_texts(spark.createDataFrame([("A b", 7, 1)], "text string, n_words int, other int")).collect()
    assert [tuple(x) for x in rows] == [(1, 2, 2, 3, 1, 0)]
    one = filter_interactions(spark.range(3), {"x": F.col("id") > 0, "y": F.lit(None).cast("boolean")}, F.lit(None), F.lit(True), F.lit(False)).collect()
    assert {(x.part, x.filter_order, x.step, x.kept, x.removed, x.shapley) for x in one} == {("", "xy", 1, 1, 2, 4), ("", "xy", 2, 1, 0, 0), ("", "yx", 1, 3, 0, 0), ("", "yx", 2, 1, 2, 4)}
    with pytest.raises(ValueError):
        filter_interactions(spark.range(1), {"long": F.lit(True)}, F.lit(1), F.lit(True), F.lit(True))


# --- suffix dedup

@settings(max_examples=80, deadline=None)
@given(st.integers(8, 60), st.integers(1, 3), st.sampled_from([0, 8, 32]), st.randoms(use_true_random=False))
def test_order_and_common_prefixes(size, letters, shallow, r):
    text = bytes(r.randrange(97, 97 + letters) for _ in range(size + 200))
    start = np.array([r.randrange(0, 201) for _ in range(90)])
    bucket = np.array([r.randrange(0, 3) for _ in range(90)])
    order, common = deep_shallow_sort(np.frombuffer(text, np.uint8), start, size, bucket, shallow)
    key = lambda i: (bucket[i], text[start[i] : start[i] + size])
    assert [key(i) for i in order] == sorted(map(key, range(90)))
    for a, b, c in zip(order, order[1:], common[1:]):
        x, y = key(a), key(b)
        assert c == (next((k for k in range(size) if x[1][k] != y[1][k]), size) if x[0] == y[0] else 0)


def brute_repeats(docs, size):
    raw = [(t or "").encode() for _, t in docs]
    seen = Counter(x[p : p + size] for x in raw for p in range(len(x) - size + 1))
    out = []
    for (id, _), x in zip(docs, raw):
        gone = np.zeros(len(x) + 1, bool)
        for p in range(len(x) - size + 1):
            if seen[x[p : p + size]] > 1:
                gone[p : p + size] = True
        out.append((id, len(x), int(gone.sum()), int((gone[1:] < gone[:-1]).sum()), bytes(c for c, g in zip(x, gone) if not g)))
    return Counter(out)


def repeats_fixture():
    r = random.Random(12)
    text = lambda n: "".join(r.choice("abcd é") for _ in range(n))
    shared, line = text(300), text(90)
    docs = [(i, text(r.randrange(0, 200)) + (shared[r.randrange(0, 60) : r.randrange(200, 300)] if i % 2 else "") + text(r.randrange(0, 90)) + (line if i % 3 == 0 else "") + text(30)) for i in range(80)]
    base = text(900)
    near = [(200 + i, base[:k] + "X" + base[k + 1 :]) for i, k in enumerate(r.randrange(0, 900) for _ in range(40))]
    docs += near + [(300 + i, docs[1][1]) for i in range(5)] + [(None, docs[1][1]), (1, docs[1][1]), (310, None), (311, ""), (312, "ab" * 400), (313, "z" * 39), (314, "z" * 39), (315, "q" * 41), (316, text(30000)), (317, "é" * 60)]
    return docs


@pytest.mark.parametrize("size, gram, bound", [(40, 8, 20_000), (200, 32, 20_000), (40, 8, 4)])
def test_repeated_bytes_equal_brute_force(spark, size, gram, bound):
    docs = repeats_fixture()
    df = spark.createDataFrame([(a, b, 7, "k") for a, b in docs], DOCS + ", n_bytes int, _t1 string")
    got = remove_repeated_bytes(df.repartition(5), size, gram=gram, group_bound=bound)
    assert got.columns == ["doc_id", "_t1", "n_bytes", "n_removed", "n_spans", "kept_bytes"]
    assert Counter((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept_bytes)) for x in got.collect()) == brute_repeats(docs, size)


def test_repeated_bytes_in_pieces(spark, monkeypatch):
    """Segments that a piece of a long text cuts, and suffixes that are sorted in several parts."""
    docs = repeats_fixture()
    raw = [(t or "").encode() for _, t in docs]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    whole = suffix_dedup.segments(data, offsets, 40, 8)
    monkeypatch.setattr(suffix_dedup, "PIECE", 500)
    pieces = suffix_dedup.segments(data, offsets, 40, 8)
    each = lambda s: sorted((r, f + k, a - k) for r, f, n, a in zip(*(x.tolist() for x in s[:4])) for k in range(n))
    assert each(whole) == each(pieces) and len(pieces[0]) > len(whole[0])
    assert len(each(whole)) == sum(max(len(x) - 39, 0) for x in raw)
    text = np.frombuffer(("abcdefghij" * 30 + "k" * 50).encode(), np.uint8)
    cut = [text[a : a + 90] for a in (0, 10, 20, 5, 250, 255)]
    args = np.concatenate(cut), np.arange(6) * 90, np.full(6, 51), np.array([50, 50, 50, 50, 50, 45]), np.array([0, 0, 0, 0, 1, 1]), 40
    want = [x.tolist() for x in suffix_dedup.repeated_starts(*args)]
    monkeypatch.setattr(suffix_dedup, "WINDOWS", 20)
    assert [x.tolist() for x in suffix_dedup.repeated_starts(*args)] == want and want[0]


def test_repeated_bytes_without_rows(spark):
    assert remove_repeated_bytes(spark.createDataFrame([], DOCS)).count() == 0
    assert [tuple(x) for x in remove_repeated_bytes(spark.createDataFrame([(1, "a" * 199)], DOCS)).select("doc_id", "n_bytes", "n_removed", "n_spans").collect()] == [(1, 199, 0, 0)]
    assert [tuple(x) for x in remove_repeated_bytes(spark.createDataFrame([(1, "a" * 201)], DOCS)).select("doc_id", "n_bytes", "n_removed", "n_spans").collect()] == [(1, 201, 201, 1)]
    with pytest.raises(ValueError):
        remove_repeated_bytes(spark.createDataFrame([], DOCS), 4)


def test_suffix_query_digest(spark):
    d = "/root/testdata/sf0.001"
    docs = [(x.doc_id, x.text) for x in spark.read.parquet(f"{d}/documents.parquet").collect()]
    want = Counter((i, n, k, s, hashlib.sha256(t).hexdigest()) for (i, n, k, s, t), c in brute_repeats(docs, 200).items() for _ in range(c))
    assert Counter(tuple(x) for x in QUERIES["op13_suffix_array_dedup"](spark, d).collect()) == want
