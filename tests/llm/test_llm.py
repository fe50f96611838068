"""Every operator against brute force on small tables: nulls, empty and very long texts, ties, repeats, clashing columns, no rows."""
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from bermline.llm import chat, extraction, fingerprints, language, licenses, mixing, ngram_join, quality, text
from bermline.llm.decontamination import contamination
from bermline.llm.dom import read_page
from bermline.llm.joins import split_by_keys
from bermline.llm.labelled_pages import labelled_page
from bermline.llm.license_rules import BASE, rules
from bermline.llm.ngram_join import near_duplicates
from bermline.llm.queries import QUERIES, SQL
from bermline.llm.sampling import bounded_sample
from bermline.llm.substrings import COVER, PERIOD, remove_repeats
from check import compare, duck

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"
ASCII_LOWER = {a: a + 32 for a in range(65, 91)}


def words(t, alnum=True):
    return re.findall(text.ALNUM, (t or "").translate(ASCII_LOWER)) if alnum else re.findall(text.SPACED, t or "")


def prose(r, n, vocabulary=400):
    return " ".join("".join(r.choice("aeioubcdgklmnprst") for _ in range(2 + r.randrange(vocabulary) % 5)) for _ in range(n))


@pytest.mark.parametrize("name", [n for n in SQL if n in QUERIES])
def test_query_equals_sql(spark, name):
    assert compare(QUERIES[name](spark, SF), duck(SF), SQL[name]) is None


@pytest.mark.parametrize("name", [n for n in QUERIES if not n.startswith(("op11_", "op12_"))])
def test_query_reads_the_given_tables(spark, name):
    table = {"op9": "pages", "op10": "conversations"}.get(name.split("_")[0], "documents")
    rows = spark.read.parquet(f"{SF}/{table}.parquet")
    want = rows.select("conv_id").distinct().count() + 1 if table == "conversations" else rows.count()
    assert QUERIES[name](spark, SF).count() == want


def test_words_and_hashes():
    import pyarrow as pa
    texts = ["", None, "a", " b ", "Ünï É x9_y\x85z", "tail\x00head", "q" * 5000, "one\ttwo\x0bthree", "one", "two"]
    for alnum in (True, False):
        seen = {}
        for r0, r1, data, offsets in text.slices(pa.array(texts), 16):
            w = text.split_words(data, offsets, alnum)
            for i in range(r1 - r0):
                got = [bytes(w.data[w.start[k]:w.end[k]]).decode() for k in range(w.first[i], w.first[i + 1])]
                assert got == words(texts[r0 + i], alnum)
                for k, x in zip(range(w.first[i], w.first[i + 1]), got):
                    assert seen.setdefault(x, w.hash[k]) == w.hash[k]
        assert len(set(seen.values())) == len(seen)
    v = text.mix(np.arange(100, dtype=np.uint64))
    assert (text.rolling(v, 7)[13] == text.rolling(v[13:20], 7)[0]) and text.rolling(v[:3], 7).size == 0


# --- substring dedup

def brute_repeats(rows, window):
    first = defaultdict(lambda: None)
    for id, t in rows:
        w, key = words(t, False), 2**63 - 1 if id is None else id
        for i in range(len(w) - window + 1):
            k = tuple(w[i:i + window])
            first[k] = key if first[k] is None else min(first[k], key)
    out = []
    for id, t in rows:
        w, key = words(t, False), 2**63 - 1 if id is None else id
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i:i + window])] < key:
                gone |= set(range(i, i + window))
        out.append((id, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return Counter(out)


def test_cover_holds_every_difference():
    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))


@pytest.mark.parametrize("seed", range(3))
def test_substring_dedup_equals_brute_force(spark, seed):
    r = random.Random(seed)
    shared = [prose(r, n) for n in (49, 50, 51, 80, 120)]
    rows = [(i, " ".join(r.choice([prose(r, r.randrange(60)), r.choice(shared), r.choice(shared)[3:]]) for _ in range(3))) for i in range(40)]
    rows += [(5, rows[3][1]), (100, rows[3][1]), (100, rows[3][1]), (None, rows[3][1]), (None, prose(r, 70)), (101, None), (102, ""), (103, "\n\t "),
             (104, "la " * 3000), (105, "la " * 200), (106, prose(r, 9000)), (107, shared[0]), (108, shared[2])]
    df = spark.createDataFrame([(a, b, "x", 7, "mine") for a, b in rows], DOCS + ", kept_text string, other int, _id string").withColumn("_actions", F.lit(3))
    out = remove_repeats(df)
    assert set(out.columns) == {"doc_id", "text", "other", "_id", "_actions", "n_words", "n_removed", "kept_text"}
    assert {(x["_id"], x["_actions"]) for x in out.collect()} == {("mine", 3)}
    assert Counter(tuple(x) for x in out.select("doc_id", "n_words", "n_removed", "kept_text").collect()) == brute_repeats(rows, 50)


def test_texts_that_agree_in_one_hash_only_are_not_copies(spark, monkeypatch):
    import bermline.llm.substrings as module
    r = random.Random(4)
    rows = [(i, prose(r, 60)) for i in range(6)] + [(7, "so " * 70), (8, "so " * 70)]
    whole = module.spans
    monkeypatch.setattr(module, "spans", lambda h, a, z, base=0: whole(h, a, z, base) if base else whole(h, a, a, base))  # the first hash is the same for all texts
    run = module._wholes(50)
    import pyarrow as pa
    got = pa.Table.from_batches(list(run([pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array([t for _, t in rows])], names=["a", "b"])]))).to_pydict()
    assert len(set(got["_whole"])) == 1 and len(set(got["_whole2"])) == 7


def test_substring_dedup_shuffle_path_and_no_rows(spark, monkeypatch):
    r = random.Random(9)
    rows = [(i, prose(r, 55) if i % 3 else "to be or not " * 15) for i in range(12)]
    import bermline.llm.substrings as module
    monkeypatch.setattr(module, "split_by_keys", lambda rows, key, keys: split_by_keys(rows, key, keys, bound=0))
    out = remove_repeats(spark.createDataFrame(rows, DOCS)).select("doc_id", "n_words", "n_removed", "kept_text")
    assert Counter(map(tuple, out.collect())) == brute_repeats(rows, 50)
    assert remove_repeats(spark.createDataFrame([], DOCS)).count() == 0


# --- n-gram join

def brute_links(rows, n=5, s=0.8):
    sets = {}
    for id, t in rows:
        w = words(t)
        g = {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
        sets[id] = g
    link = {a: {b for b in sets if a != b and sets[a] and len(sets[a] & sets[b]) >= s * len(sets[a] | sets[b])} for a in sets}
    out = {}
    for a in link:
        seen, todo = {a}, [a]
        while todo:
            for b in link[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        out[a] = (min(seen), len(link[a]))
    return out


def test_ngram_join_equals_brute_force(spark, monkeypatch):
    r = random.Random(4)
    rows = [(i, prose(r, r.randrange(3, 150))) for i in range(60)]
    for i in range(60, 160):  # near copies of a few texts, some with several edits, and exact ones
        w = rows[i % 7][1].split()
        for _ in range(r.choice([0, 1, 1, 2, 4])):
            w[r.randrange(len(w))] = "edit" + str(r.randrange(1000))
        rows.append((i, " ".join(w)))
    rows += [(200, None), (201, ""), (202, "..."), (203, "Two words"), (204, "two, WORDS!"), (205, "a b c d e"), (206, "a b c d e f"), (207, "x " * 4000)]
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    monkeypatch.setattr(ngram_join, "STRIP", 3)
    df = spark.createDataFrame([(a, b, 1) for a, b in rows] + [(None, "a b c d e", 1)], DOCS + ", class_id int")
    got = {x.doc_id: (x.class_id, x.n_links) for x in near_duplicates(df).collect()}
    assert got == brute_links(rows)


def test_ngram_join_edges(spark):
    assert near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    out = near_duplicates(spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (3, None)], DOCS)).collect()
    assert sorted(map(tuple, out)) == [(1, 1, 1), (2, 1, 1), (3, 3, 0)]
    k = ngram_join.stop_depth(0.8)
    assert 1 - (1 - 0.8**k) ** ngram_join.TREES >= ngram_join.RECALL > 1 - (1 - 0.8 ** (k + 1)) ** ngram_join.TREES


def test_ngram_join_loses_no_link_of_a_large_group():
    pairs, k = 10_000 * 9_999 / 2, ngram_join.stop_depth(0.8)
    assert pairs * (1 - 0.8**k) ** ngram_join.TREES < 0.1  # all pairs at the threshold itself
    m = ngram_join.TREES * k
    least = 0.8 - ngram_join.SLACK * math.sqrt(0.8 * 0.2 / m)
    assert sum(math.comb(m, i) * 0.8**i * 0.2 ** (m - i) for i in range(m) if i / m < least) < 1e-9  # a pair left out by its sketch


# --- decontamination

def test_decontamination_equals_brute_force(spark):
    r = random.Random(5)
    items = [(i, prose(r, n)) for i, n in enumerate((40, 13, 14, 5, 1, 30))] + [(9, None), (10, "..."), (None, "null item"), (0, None), (11, "the"), (12, "b b b b b b b b b b b b b b b")]
    docs = [(i, prose(r, 30) + " " + r.choice([items[0][1][10:], items[1][1].upper(), items[3][1] + "! " + items[4][1], ""]) + " " + prose(r, 5)) for i in range(25)]
    docs += [(100, None), (101, ""), (102, "b " * 40), (103, items[5][1]), (103, items[1][1]), (103, items[1][1]), (None, items[1][1]), (104, prose(r, 9000) + " " + items[2][1]), (105, "the")]
    win = {tuple(w[i:i + 13]): None for _, t in items for w in [words(t)] for i in range(max(len(w) - 12, 1)) if w}
    owners = defaultdict(set)
    for id, t in items:
        w = words(t)
        for i in range(max(len(w) - 12, 1) if w else 0):
            if id is not None:
                owners[tuple(w[i:i + 13])].add(str(id))
    win = {k for k in win if owners[k]}
    want = Counter()
    for id, t in docs:
        w, hit, named = words(t), set(), set()
        for k in win:
            for i in range(len(w) - len(k) + 1):
                if tuple(w[i:i + len(k)]) == k:
                    hit |= set(range(i, i + len(k)))
                    named |= owners[k]
        want[id, len(w), len(hit), tuple(sorted(named)), len(hit) > 0 and 20 * len(hit) >= len(w)] += 1
    df = spark.createDataFrame([(a, b, 0) for a, b in docs], DOCS + ", n_hit int")
    got = contamination(df, spark.createDataFrame(items, "item_id long, text string"))
    assert Counter((x.doc_id, x.n_words, x.n_hit, tuple(x["items"]), x.contaminated) for x in got.collect()) == want


def test_decontamination_without_rows(spark):
    empty, one = spark.createDataFrame([], "item_id long, text string"), spark.createDataFrame([(1, "a b")], DOCS)
    assert contamination(one, empty).select("n_hit", "contaminated").first() == (0, False)
    assert contamination(spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a")], "item_id long, text string")).count() == 0


# --- licenses

def test_license_scan(spark):
    assert 200 <= len(rules()) and {r.keyword for r in rules()} >= {k for _, k, _, _ in BASE}
    rows = [
        (1, "Released under the MIT License. Licensed under the Apache License, Version 2.0."),
        (2, "CC BY-NC-SA 4.0, licensed under CC BY-NC-SA 4.0"),
        (3, "This work is licensed under the GNU General Public License, version 3."),
        (4, "mit dem Hund unter der Brücke"), (5, None), (6, ""), (7, "under the mit license under the mit license"), (8, "SPDX-License-Identifier: BSD-3-Clause"),
        (9, "mit " * 20000 + "under the MIT license"), (11, "under the mit licen\u017fe \u212a"), (7, "under the mit license under the mit license"), (None, "Apache License Version 2"), (10, "under the mit licenses"),
    ]
    got = {(x.doc_id, x.n_words): x for x in licenses.scan_licenses(spark.createDataFrame([(a, b, "z") for a, b in rows], DOCS + ", labels string")).collect()}
    at = lambda id: next(x for (i, _), x in got.items() if i == id)
    assert (at(1).n_base, at(1).first_word, at(1).last_word, at(1).base_labels, at(1).labels) == (2, 1, 8, "apache-2,mit", "apache-2,mit")
    assert at(2).n_base == 2 and at(2).base_labels == "cc-by-nc" and "cc-by-nc-sa" in at(2).labels
    assert at(3).labels == "gpl-3" and at(3).base_labels == "" and at(3).score == 1.0 and at(3).first_word is None
    assert at(4).labels == "" and at(4).score == 0 and at(5).n_words == at(6).n_words == 0
    assert (at(7).n_base, at(7).first_word, at(7).last_word) == (2, 0, 4) and at(8).labels == "bsd-3-clause"
    assert at(9).first_word == 20000 and at(None).base_labels == "apache-2" and at(10).n_base == 0
    assert licenses.scan_licenses(spark.createDataFrame(rows, DOCS)).count() == len(rows)
    assert licenses.scan_licenses(spark.createDataFrame([], DOCS)).count() == 0


def test_base_places_equal_brute_force(spark):
    phrases = {tuple(p.split()): label for p, label in (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))}
    got = {x.doc_id: x for x in QUERIES["op4_license_scans"](spark, SF).collect()}
    for x in spark.read.parquet(f"{SF}/documents.parquet").collect():
        w, places, labels = words(x.text), [], set()
        for p, label in phrases.items():
            at = [i for i in range(len(w) - len(p) + 1) if tuple(w[i:i + len(p)]) == p]
            places += at
            labels |= {label} if at else set()
        g = got[x.doc_id]
        assert (g.n_words, g.n_base, g.first_word, g.last_word, g.base_labels) == (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
        assert labels <= set(g.labels.split(","))


def brute_licenses(t):
    w, found = words(t), set()
    for rule in rules():
        for i in (i for i, x in enumerate(w) if x == rule.keyword):
            lead, tail = "".join(x + " " for x in w[max(i - 16, 0):i]) + "|", "|" + "".join(" " + x for x in w[i + 1:i + 17])
            a, b = re.search(rule.before, lead), re.search(rule.after, tail)
            if a and b and (rule.near in lead or rule.near in tail):
                found.add((i - a[0].count(" "), i + 1 + b[0].count(" "), rule))
    order = lambda d: (d[0], -d[1], -d[2].priority, d[2].rule)
    own = [d for d in found if not d[2].base]
    stays = [d for d in own if not any(order(e) < order(d) and e[1] >= d[1] and e[2].priority >= d[2].priority for e in own)] + [d for d in found if d[2].base]
    return ",".join(sorted({d[2].label for d in stays})), max((d[2].weight for d in stays), default=0.0), len(stays)


def test_license_labels_equal_brute_force(spark):
    r = random.Random(21)
    lines = ["Licensed under the Apache License, Version 2.0.", "under the terms of the GNU Lesser General Public License version 2.1", "CC BY-NC-ND 4.0", "MIT", "SPDX-License-Identifier: MIT-0",
             "the BSD 3-Clause license or the new BSD license", "released under Creative Commons Attribution Share-Alike 3.0", "mit license mit license", "license: zlib", "dual licensed under GPLv2 under MIT"]
    rows = [(i, " ".join(r.choice([*lines, prose(r, 6)]) for _ in range(5))) for i in range(80)]
    rows += [(x.doc_id + 1000, x.text) for x in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {x.doc_id: (x.labels, x.score, x.n_found) for x in licenses.scan_licenses(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {i: brute_licenses(t) for i, t in rows}


def test_versions_bare_names_and_license_bodies(spark):
    want = [("licensed under the GPL v3", "gpl-3"), ("under LGPL v2.1", "lgpl-2"), ("under the MPL v2.0", "mpl-2"), ("released under AGPL v3", "agpl-3"), ("available under the GPL.", "gpl"),
            ("under the LGPL", "lgpl"), ("under the AGPL", "agpl"), ("under the MPL", "mpl"), ("It has the GNU General Public License v3", "gpl-3"), ("GNU Lesser General Public License, version 2.1", "lgpl-2"),
            ("Eclipse Public License v2.0", "epl-2"), ("Apache License v2.0", "apache-2"), ("under CC BY-SA v4.0", "cc-by-sa"), ("under Artistic License v2.0", "artistic-2"), ("license: LGPLv3", "lgpl-3"),
            ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "mit"),
            ("Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software", "boost-1"),
            ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "isc"),
            ("Redistribution and use in source and binary forms, with or without modification, are permitted", "bsd"),
            ("In no event will the authors be held liable for any damages arising from the use of this software.", "zlib"),
            ("This is free and unencumbered software released into the public domain.", "unlicense"), ("the gpl and the mpl", ""), ("redistribution of wealth", ""),
            ("the tests run under ruby", ""), ("windows opened under x11", ""), ("rows stored under postgresql", ""), ("known under the general public", ""), ("under artistic direction", ""),
            ("under european union public procurement law", ""), ("under microsoft public cloud", ""), ("built under bsd", ""), ("under the business source of income", ""), ("provided under zlib", ""),
            ("licensed under Ruby", "ruby"), ("under the terms of the X11 license", "x11"), ("the PostgreSQL License", "postgresql"), ("released under the GNU General Public License", "gpl"),
            ("under the European Union Public Licence", "eupl"), ("under the Microsoft Public License", "ms-pl"), ("a BSD license", "bsd"), ("under the new BSD license", "bsd-3-clause"),
            ("Elastic License 2.0", "elastic-2"), ("the Server Side Public License", "sspl-1"), ("licensed under SSPL", "sspl-1"), ("the Business Source License", "busl-1.1"), ("under BUSL 1.1", "busl-1.1"),
            ("released under the Artistic License", "artistic"), ("under the Boost Software License", "boost-1")]
    got = {x.doc_id: x for x in licenses.scan_licenses(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(want)], DOCS)).collect()}
    assert [(t, got[i].labels) for i, (t, _) in enumerate(want)] == want and all((got[i].score > 0) == bool(label) for i, (_, label) in enumerate(want))
    assert {i: (x.labels, x.score, x.n_found) for i, x in got.items()} == {i: brute_licenses(t) for i, (t, _) in enumerate(want)}


def test_inner_detections_are_suppressed(spark):
    rows = [(1, 7, 0, 5, 1, "a", 2, 0.9, False), (1, 7, 1, 4, 2, "b", 2, 0.9, False), (1, 7, 1, 4, 3, "c", 3, 0.9, False), (1, 7, 0, 5, 4, "d", 2, 0.9, False),
            (1, 7, 4, 8, 5, "e", 1, 0.9, False), (1, 7, 1, 2, 6, "f", 5, 1.0, True), (2, 7, 1, 4, 7, "g", 1, 0.9, False)]
    df = spark.createDataFrame(rows, "_hash long, _more int, start int, end int, rule int, label string, priority int, weight double, base boolean")
    assert sorted(x.label for x in licenses.resolve(df).collect()) == ["a", "c", "e", "f", "g"]


# --- classifiers

def test_held_out_rule(spark):
    from bermline.llm.sampling import held_out
    rows = spark.range(200).withColumn("h", held_out(F.col("id"))).collect()
    assert all(x.h == (zlib.crc32(str(x.id).encode()) % 5 == 0) for x in rows)


def test_bounded_sample(spark):
    df = spark.range(5000).withColumn("c", F.when(F.col("id") < 4000, "a").when(F.col("id") < 4990, "b").otherwise("c"))
    got = bounded_sample(df, "c", 100, "id").collect()
    assert Counter(x.c for x in got) == {"a": 100, "b": 100, "c": 10} and {x.id for x in got} == {x.id for x in bounded_sample(df.repartition(7), "c", 100, "id").collect()}


def test_language_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    truth = {x.doc_id: x.lang for x in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = [x for x in QUERIES["op1_language_id"](spark, d).collect() if x.held_out]
    assert len(rows) > 150 and np.mean([x.lang_pred == truth[x.doc_id] for x in rows]) > 0.97 and all(0 <= x.score <= 1 for x in rows)


def test_language_edges(spark):
    r = random.Random(1)
    say = {"de": "der und nicht schön straße", "en": "the and of with thing", "fr": "le été où ça queue", "xx": "zq qz zzq qqz"}
    rows = [(i, " ".join(r.choice(v.split()) for _ in range(12)), k) for i, (k, v) in enumerate(list(say.items()) * 20)] + [(500, None, "de"), (501, "the and", None), (502, "", "en")]
    df = spark.createDataFrame(rows, DOCS + ", lang string")
    model = language.fit_languages(df)
    assert sorted(model.weights) == ["family germanic", "family romance", "family xx", "pair de en"]
    asked = spark.createDataFrame([(1, "und der der schön"), (2, None), (3, "123 ... !"), (4, ""), (5, "THE AND OF WITH"), (5, "THE AND OF WITH"), (None, "zzq qqz qz"), (6, "été " * 200000)],
                                  DOCS).withColumn("lang_pred", F.lit("old"))
    got = sorted((x.doc_id or -1, x.lang_pred) for x in language.identify(asked, model).collect())
    assert got == [(-1, "xx"), (1, "de"), (2, "und"), (3, "und"), (4, "und"), (5, "en"), (5, "en"), (6, "fr")]
    nothing = language.fit_languages(df.filter("false"))
    assert {x.lang_pred for x in language.identify(asked, nothing).collect()} == {"und"}
    assert language.identify(asked.filter("false"), model).count() == 0


def test_long_texts_are_hashed_whole(monkeypatch):
    t = "Été thing " * 300
    whole = language.letter_grams(t)
    monkeypatch.setattr(language, "PIECE", 900)
    assert np.abs(language.letter_grams(t) - whole).max() < 0.02


def test_quality_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    label = {x.doc_id: x.quality for x in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = [(x.score, label[x.doc_id]) for x in QUERIES["op3_quality_classifier"](spark, d).collect() if x.held_out and x.doc_id in label]
    good, bad = [s for s, y in rows if y == 1], [s for s, y in rows if y == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.95 and np.mean([g >= quality.THRESHOLD for g in good]) > 0.97


def test_follow_leader_equals_plain_updates():
    """The passes in plain Python with dictionaries; the last pass is averaged state by state."""
    rng = np.random.default_rng(3)
    rows = [np.unique(rng.integers(0, 60, rng.integers(0, 12))).astype(np.int32) for _ in range(80)]
    labels, importance = rng.integers(0, 2, 80).astype(float), rng.choice([0.4, 1.6], 80)
    z, n, total = Counter(), Counter(), Counter()
    def weight(i, z, n):
        if abs(z[i]) <= quality.L1:
            return 0.0
        return -(z[i] - (1 if z[i] > 0 else -1) * quality.L1) / ((quality.BETA + n[i] ** 0.5) / quality.ALPHA + quality.L2)
    for epoch in range(3):
        for x, y, c in zip(rows, labels, importance):
            scale = len(x) ** 0.5 or 1
            w = {i: weight(i, z, n) for i in x.tolist()}
            g = c * (1 / (1 + 2.718281828459045 ** -(sum(w.values()) / scale)) - y) / scale
            for i in w:
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / quality.ALPHA * w[i]
                n[i] += g * g
            if epoch == 2:
                total.update(z)
    mean = Counter({i: v / 80 for i, v in total.items()})
    at, w = quality.follow_leader(rows, labels, importance, 3)
    want = np.array([weight(i, mean, n) for i in range(60)])
    assert np.allclose(np.bincount(at, w, 60), want, atol=1e-9)


def test_quality_follows_the_share_of_a_thinned_label(spark):
    """Labels drawn 9 to 1 without regard to the text, more than the bound: scores stay near the share of label 1."""
    docs = spark.range(6000).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 12), i -> concat('w', pmod(xxhash64(id, i), 200)))) AS text")
    labels = spark.range(6000).selectExpr("id AS doc_id", "CASE WHEN pmod(xxhash64(id, 'l'), 10) = 0 THEN 0 ELSE 1 END AS quality")
    for one, share in ((labels, 0.9), (labels.selectExpr("doc_id", "1 - quality AS quality"), 0.1)):
        for most in (300, 1500, 10000):
            scores = [x.score for x in quality.score_quality(docs, quality.fit_quality(docs, one, most=most)).collect()]
            assert abs(np.mean(scores) - share) < 0.1, (share, most)


def test_quality_edges(spark):
    r = random.Random(3)
    docs = spark.createDataFrame([(i, prose(r, 40) if i % 2 else "### ***\n" * 20) for i in range(120)] + [(300, None), (301, ""), (302, "x " * 100000), (None, "a b"), (1, "other row")], DOCS)
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)] + [(1, 1), (301, 0), (5, None), (None, 1), (999, 1)], "doc_id long, quality int")
    w = quality.fit_quality(docs, labels)
    assert np.array_equal(w, quality.fit_quality(docs.repartition(5), labels))
    got = quality.score_quality(docs.withColumn("score", F.lit("old")), w).collect()
    assert len(got) == 125 and all(0 <= x.score <= 1 for x in got)
    by = {x.doc_id: x.score for x in got}
    assert np.mean([by[i] for i in range(3, 120, 2)]) > 0.8 and np.mean([by[i] for i in range(0, 120, 2)]) < 0.2
    none = quality.fit_quality(docs, labels.filter("false"))
    assert not none.any() and {x.score for x in quality.score_quality(docs, none).collect()} == {0.5}
    assert quality.score_quality(docs.filter("false"), w).count() == 0


def test_scores_do_not_depend_on_the_batch():
    texts = ["a b!! c", "", "UND UND und", "x\ny"]
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, raw)])
    index, counts = quality.features(np.frombuffer(b"".join(raw), np.uint8), offsets)
    for part, t in zip(np.split(index, np.cumsum(counts)[:-1]), raw):
        one, _ = quality.features(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
        assert part.tolist() == one.tolist()


# --- fingerprints

def test_fingerprints_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", 5)
    r = random.Random(8)
    rows = [(3 * i, prose(r, r.randrange(0, 60))) for i in range(40)] + [(7, None), (8, ""), (9, "abc"), (9, "abd"), (9, "abc"), (10, "é😀" * 30000), (None, "no id"), (500, prose(r, 40))]
    order = sorted(((-(2**63) if a is None else a, b or "", a) for a, b in rows), key=lambda x: (x[0], x[1].encode()))
    want = Counter()
    for k, (_, own, id) in enumerate(order):
        nxt, m = order[(k + 1) % len(order)][1], len(own) // 4
        want[id, len(own), own[:len(own) - m] + nxt[:m] if m else own] += 1
    got = fingerprints.compare_neighbours(spark.createDataFrame([(a, b, 1) for a, b in rows], DOCS + ", n_chars int")).collect()
    assert Counter((x.doc_id, x.n_chars, x.edited_text) for x in got) == want
    assert all(0 <= v <= 1 for x in got for v in (x.near_edited, x.near_next))
    assert fingerprints.compare_neighbours(spark.createDataFrame([], DOCS)).count() == 0
    alone = fingerprints.compare_neighbours(spark.createDataFrame([(1, "abcdefgh")], DOCS)).first()
    assert alone.edited_text == "abcdefab" and alone.near_next == 1.0


def test_syncmers_are_context_free(spark):
    r = random.Random(2)
    t = prose(r, 300)
    h, at = fingerprints.anchors(t)
    back = fingerprints.parse(fingerprints.fingerprint(h, at))
    assert (back[0] == h).all() and (back[1] == at).all()
    shifted = dict(zip((fingerprints.anchors("xyz" + t)[1] - 3).tolist(), fingerprints.anchors("xyz" + t)[0].tolist()))
    assert all(shifted[p] == x for p, x in zip(at.tolist(), h.tolist()))
    assert fingerprints.likeness(h, h) == 1 and fingerprints.likeness(h, h[:0]) == 0 and fingerprints.likeness(h[:0], h[:0]) == 1
    half = fingerprints.anchors(t[: len(t) // 2] + prose(r, 150))[0]
    assert 0.35 < fingerprints.likeness(h, half) < 0.65 and fingerprints.likeness(h, fingerprints.anchors(prose(r, 300))[0]) < 0.05
    got = fingerprints.fingerprint_texts(spark.createDataFrame([(1, None), (2, t)], DOCS)).collect()
    assert [x.fingerprint for x in sorted(got)] == ["", fingerprints.fingerprint(h, at)]


def test_short_texts_have_anchors(spark):
    r = random.Random(11)
    draw = lambda n: "".join(r.choice("abcdefghij klmnop") for _ in range(n))
    near = lambda a, b: fingerprints.likeness(fingerprints.anchors(a)[0], fingerprints.anchors(b)[0])
    for n in [*range(1, 120), 500]:
        t = draw(n)
        h, at = fingerprints.anchors(t)
        assert len(h) and all((x == y).all() for x, y in zip(fingerprints.parse(fingerprints.fingerprint(h, at)), (h, at))) and near(t, t) == 1
    for n in range(30, 2 * fingerprints.SURE):
        t, k = draw(n), r.randrange(n)
        assert near(t, draw(n)) < 0.1 and 0.6 < near(t, t[:k] + "#" + t[k + 1:]) < 1  # another text, one other character
        assert 0.5 < near(t, t[: n - n // 4] + draw(n // 4)) < 0.9 and near(t, t[n // 8 :]) > 0.85
    short, long = draw(40), draw(400)
    assert near(short, long) == 0 and near(short, short + long) < 0.5
    got = fingerprints.fingerprint_texts(spark.createDataFrame([(i, draw(30 + i)) for i in range(24)], DOCS))
    assert got.filter("fingerprint = ''").count() == 0 and got.select("fingerprint").distinct().count() == 24


# --- mixing

def test_mix_meets_its_targets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 16)
    r = random.Random(6)
    rows = [(i, "w " * r.choice([1, 5, 40, 300]), "hot" if i % 3 == 0 else f"s{i % 7}") for i in range(600)]
    rows += [(700, None, None), (701, "", None), (702, "a b", None), (702, "a b", None), (None, "c d e", "s1"), (703, "x " * 5000, "s2")]
    df = spark.createDataFrame([(*x, 1) for x in rows], DOCS + ", source string, size int")
    got = mixing.mix_sources(df).collect()
    assert len(got) == len(rows) and Counter(x["size"] for x in got) == Counter(len((t or "").split()) for _, t, _ in rows)
    sizes, taken, targets = Counter(), Counter(), {}
    for x in got:
        assert 0 <= x.taken <= 2 * x["size"] and x.taken == x.copies * x["size"]
        sizes[x.source] += x["size"]
        taken[x.source] += x.taken
        targets[x.source] = x.target
    assert abs(sum(targets.values()) - 1.5 * sum(sizes.values())) < 1e-6 and all(targets[s] <= 2 * sizes[s] + 1e-9 for s in sizes)
    assert all(abs(taken[s] - targets[s]) <= 310 for s in sizes if s != "s2")
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(df.repartition(9)).collect()))
    assert mixing.mix_sources(df.filter("false")).count() == 0


def test_targets_are_shared_anew(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 100), ("c", 100), (None, 90), ("é", 0)], "_source string, _size long")
    got = {x["_source"]: x.target for x in mixing.source_targets(sizes).collect()}
    # weights 3, 1, 2, 3, 1: "a" and "é" stop at once, then "c"; "b" and null share the rest alike
    assert got == pytest.approx({"a": 20, "é": 0, "c": 200, "b": 115, None: 115})


def test_flight_keeps_both_sums():
    r = np.random.default_rng(0)
    size, u = r.integers(1, 500, 1000).astype(float), r.random(1000)
    p = mixing.flight(size, np.full(1000, 0.37), u)
    assert ((p > 0) & (p < 1)).sum() <= 2 and abs(p.sum() - 370) < 1e-6 and abs((p * size).sum() - 0.37 * size.sum()) < 1e-4
    q = mixing.land(size, p)
    assert set(q.tolist()) <= {0.0, 1.0} and abs(q.sum() - 370) <= 2
    same = mixing.flight(np.full(50, 3.0), np.full(50, 0.5), u[:50])
    assert abs(same.sum() - 25) < 1e-9


# --- pages

def test_extraction(spark):
    model = extraction.fit_extractor(spark)
    pages = [
        ("<html><body><nav><ul><li><a href=x>Home</a></li></ul></nav><article><h1>T&amp;x</h1><p>One \n two<p>three <b>bold</b>!<br>four</article><footer>&copy; me</footer></body></html>",
         "T&x\nOne two\nthree bold!\nfour"),
        ("<div class='cookie-banner'>We use cookies</div><div class='content'><p>Hello</p><script>var a='<p>no</p>'</script></div><div id='comments'><p>nice post my friend</p></div>", "Hello"),
        ("<body><header><h1>Site</h1></header><main><p>Text &lt;b&gt; &#233;</p></main><aside><p>Other things to read</p></aside></body>", "Text <b> é"),
        (None, ""), ("", ""), ("<article><p>" + "<div>" * 3000 + "deep</article>", "deep"), ("<article>" + "<p>w</p>" * 5000 + "</article>", "\n".join("w" * 5000)),
    ]
    df = spark.createDataFrame([(i, h, "old") for i, (h, _) in enumerate(pages)], "page_id long, html string, text string")
    got = {x.page_id: x.text for x in extraction.extract(df, model).collect()}
    assert [got[i] for i in range(len(pages))] == [t for _, t in pages]
    assert extraction.extract(df.filter("false"), model).count() == 0


def test_extraction_keeps_embedded_text(spark):
    seen = lambda h: " ".join("".join(t for _, _, t in read_page(h).texts).split())
    assert seen("a <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>tex</annotation></math> b <svg><title/><desc>no</desc><text>in</text></svg> c") == "a x=2 b in c"
    assert seen("<select><option>no<option>no</select>a <textarea>no</textarea><script>no</script><template>no</template>b") == "a b"
    for tag in ("object", "math", "canvas", "noscript", "svg"):
        assert seen(f"<article><div>a <{tag}>in </div>b</article> c") == "a in b c"
    assert seen("<div>a <select><option>no</div>b") == seen("<p>a <select><option>no<p>b") == seen("<div>a <select><option>no<h2>b") == "a b"
    pages = ["<article><h1>Title</h1><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be the value of it</p><object data=f><p>The figure shows the sea</p></object><p>And so on</p></article>",
             "<article><p>The first part of the text</p><p>Here <object data=f>a film</p><p>The second part of the text</p></article>"]
    df = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")
    got = {x.page_id: x.text for x in extraction.extract(df, extraction.fit_extractor(spark)).collect()}
    assert got[0] == "Title\nLet x=2 be the value of it\nThe figure shows the sea\nAnd so on"
    assert got[1] == "The first part of the text\nHere a film\nThe second part of the text"


def test_marginals_equal_enumeration():
    counts = Counter()
    for k in range(60):
        counts.update(extraction.count_page(labelled_page(k)))
    m = extraction.TreeModel(counts)
    page = read_page("<div class=content><p>a b c<b>d</b></p><ul class=menu><li><a>x</a></li></ul></div>")
    got = m.marginals([read_page("<p>z"), page])[1]
    feats, n = extraction.text_features(page), len(page.tags)
    own = [np.array(m.evidence(t, a)) + m.own.get(f, (0, 0)) + m.prior for t, a, f in zip(page.tags, page.attrs, feats)]
    mass = np.zeros((n, 2))
    for code in range(1 << n):
        y = [(code >> k) & 1 for k in range(n)]
        w = np.exp(sum(own[k][y[k]] for k in range(n)) + sum(m.pairs.get(page.tags[k], m.pairs[""])[y[page.parents[k]], y[k]] for k in range(1, n)))
        for k in range(n):
            mass[k, y[k]] += w
    assert np.allclose(got, mass[:, 1] / mass.sum(axis=1))


def test_extraction_on_held_out_labelled_pages():
    counts = Counter()
    for k in range(300):
        counts.update(extraction.count_page(labelled_page(k)))
    m, right = extraction.TreeModel(counts), []
    for k in range(20_000, 20_100):
        page = read_page(labelled_page(k))
        share, labels = m.marginals([page])[0], [0]
        for i in range(1, len(page.tags)):
            told = re.search(r'data-label="(\d)"', page.attrs[i])
            labels.append(int(told[1]) if told else labels[page.parents[i]])
        right += [(share[o] > 0.5) == labels[o] for o, _, t in page.texts if t.strip()]
    assert np.mean(right) > 0.95


# --- chat

def test_chat_round_trip(spark):
    hard = ["", "\\", "<|", "\\<|end|>\n", "<|turn|>user<|says|>x<|end|>\n", "a\\\\<|b", "<|image:0|>", "\\### Assistant: </turn> ok", "é😀\n", "x" * 50000]
    r = random.Random(7)
    rows = [(c, t, r.choice(["user", "assistant", "system", "<|end|>", None]), r.choice([*hard, None])) for c in range(30) for t in range(r.randrange(1, 7))]
    rows += [(100, None, "user", "late"), (100, 1, "user", "b"), (100, 1, "user", "a"), (100, 1, "user", "a"), (None, 0, "assistant", "lost")]
    df = spark.createDataFrame([(*x, 0) for x in rows], "conv_id long, turn long, role string, text string, n_turns int")
    made = chat.format_conversations(df)
    want = defaultdict(list)
    for c, t, role, s in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or 0, x[2] is not None, (x[2] or "").encode(), (x[3] or "").encode())):
        want[c].append((role or "", s or ""))
    back = defaultdict(list)
    for x in sorted(chat.read_turns(made).collect(), key=lambda x: x.pos):
        back[x.conv_id].append((x.role, x.text))
    assert dict(back) == dict(want)
    loss = {x.conv_id: x.t for x in made.select("conv_id", chat.masked_text(F.col("formatted"), F.col("loss_start"), F.col("loss_end")).alias("t")).collect()}
    assert loss == {c: "".join(s for role, s in turns if role == "assistant") for c, turns in want.items()}
    assert chat.format_conversations(df.filter("false")).count() == 0


def test_chat_parts(spark):
    parts = [("text", "see <|image:9|>", None, None), ("image", None, "s3://a.png", 576), ("audio", None, "b.wav", 40), ("text", "and", None, None), ("document", None, "c.pdf", None), ("odd", "kept", None, None)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", [("text", "ok then", None, None), ("image", None, "d.png", 5)]), (2, 0, "user", None)], f"conv_id long, turn long, role string, content {chat.PARTS}")
    made = {x.conv_id: x for x in chat.format_conversations(df, content="content").collect()}
    assert [(a["index"], a.kind, a.ref, a.tokens) for a in made[1].attachments] == [(0, "image", "s3://a.png", 576), (1, "audio", "b.wav", 40), (2, "document", "c.pdf", 0), (3, "image", "d.png", 5)]
    turns = chat.read_back(made[1].formatted)
    assert turns[0][1] == [{"kind": "text", "text": "see <|image:9|>"}, {"kind": "image", "ref": "0"}, {"kind": "audio", "ref": "1"}, {"kind": "text", "text": "and"},
                           {"kind": "document", "ref": "2"}, {"kind": "text", "text": "kept"}]
    assert made[1].n_tokens == 576 + 40 + 5 + sum(map(chat.count_words, ("see <|image:9|>", "and", "kept", "ok then"))) and made[2].attachments == []
    a, b = made[1].loss_start[0], made[1].loss_end[0]
    assert made[1].formatted[a:b] == "ok then<|image:3|>"
