"""Licences, language identification, WARC, language-model scoring, shared helpers."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from oracle_check import compare, duck_connection
from quarry.llm import common as C
from quarry.llm import langid as L
from quarry.llm.licence import scan_licences
from quarry.llm.lm import score_texts, walk
from quarry.llm.queries import ORACLE_SQL, QUERIES
from quarry.llm.warc import LoserTree, archive, read_captures, records, url_key, write_warc

SF = "/root/testdata/sf0.01"
TEXT = "doc_id long, text string"


# --- helpers ---------------------------------------------------------------------------------
def plain_words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def test_words_are_told_apart_across_chunks():
    rng = random.Random(1)
    alphabet = "aAbB \t\n\x0b é漢\U0001F600"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(300)] + [None, "", "x" * 5000, " " * 300]
    rng.shuffle(texts)
    real, seen = C.CHUNK_BYTES, {}
    rows = {}
    for limit in (1, 97, 1 << 20):
        got = {}
        for i, j in C.row_chunks(C.string_buffers(pa.array(texts))[0], limit):
            for a, b, row, word in C.word_chunks(pa.array(texts, pa.string()).slice(i, j - i)):
                for r in range(a, b):
                    got[i + r] = word[row + a == r].tolist()
        rows[limit] = [got[i] for i in range(len(texts))]
    assert rows[1] == rows[97] == rows[1 << 20] and real == C.CHUNK_BYTES
    for t, ids in zip(texts, rows[97]):
        words = plain_words(t)
        assert len(words) == len(ids)
        for w, x in zip(words, ids):
            assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


# --- licences --------------------------------------------------------------------------------
def test_licences_match_sql(spark):
    name = "op5_licence_scan"
    ok, why = compare(QUERIES[name](spark, SF), duck_connection(SF), ORACLE_SQL[name])
    assert ok, why


@pytest.mark.parametrize("text,want", [
    ("Released under the MIT License.", ["MIT"]),
    ("x y\nRELEASED   under the\tMIT license", ["MIT"]),
    ("Licensed under the Apache License,\nVersion 2.0 (the \"License\"); you may not use this file except in compliance with "
     "the License. You may obtain a copy of the License at http", ["Apache-2.0"]),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
     "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
     "later version.", ["GPL-3.0-or-later"]),
    ("Licensed under CC BY-NC 4.0. All rights reserved.", ["CC-BY-NC-4.0", "All-Rights-Reserved"]),
    ("Released under the MIT License. Released under the MIT License.", ["MIT"]),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
     "conditions are met: Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
     "promote products derived from this software without specific prior written permission.", ["BSD-3-Clause"]),
    ("I lost my driving license.", []), ("", []), (None, []),
])
def test_licence_rules(spark, text, want):
    r = scan_licences(spark.createDataFrame([(1, text)], TEXT)).first()
    assert r["__licences"] == want


MIT_FILE = """MIT License

Copyright (c) 2023 Jane Doe

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED."""
BSD2_FILE = """BSD 2-Clause License

Copyright (c) 2023, Jane Doe

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD3_FILE = BSD2_FILE.replace("2-Clause", "3-Clause") + """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""


@pytest.mark.parametrize("name,file", [("MIT", MIT_FILE), ("BSD-2-Clause", BSD2_FILE), ("BSD-3-Clause", BSD3_FILE)])
def test_whole_licence_files(spark, name, file):
    lines = file.split("\n")
    forms = [file, file.replace("\n", "\r\n"), file.replace("\n", "\r"), "\n".join(("# " + x).rstrip() for x in lines),
             "\n".join("// " + x for x in lines), "/*\n" + "\n".join(" * " + x for x in lines) + "\n */\nint main;"]
    got = scan_licences(spark.createDataFrame(list(enumerate(forms)), TEXT)).orderBy("doc_id").collect()
    assert [r["__licences"] for r in got] == [[name]] * len(forms)


@pytest.mark.parametrize("text,want", [
    ("/* This program is free\n * software */", ["GplFree"]), ("# All rights\n# reserved.", ["AllRights"]),
    ("Released under\n\nthe MIT License.", ["MitRelease"]),  # found with a blank line inside, too
])
def test_known_sentences_across_comment_lines(spark, text, want):
    assert scan_licences(spark.createDataFrame([(1, text)], TEXT)).first()["__sentences"] == want


def test_licence_odd_rows(spark, odd_docs, no_docs):
    out = scan_licences(odd_docs)
    assert out.count() == 12 and out.where(F.size("__licences") > 0).count() == 0
    assert scan_licences(no_docs).count() == 0
    plan = QUERIES["op5_licence_scan"](spark, SF)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


# --- language --------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id % 2 = 0")
    return L.train(docs, rows=2000)


def test_held_out_accuracy_by_text_alone(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id % 2 = 1")
    out = L.identify(docs.select("doc_id", "text", F.col("lang").alias("truth")), model)
    right, n, kept = out.agg(F.avg((F.col("__language") == F.col("truth")).cast("int")), F.count("*"), F.avg(F.col("__kept").cast("int"))).first()
    assert n == 5000 and right > 0.98 and kept > 0.999


def test_short_texts_follow_their_evidence(spark, model):
    rows = [(i, "de la", "es", "h1") for i in range(50)] + [(99, "de la", None, "h1"), (100, "de la", None, "h2"), (101, "de la", "fr", "h2")]
    rows += [(200 + i, "El árbol que se dice en la casa es grande y la noche para los", "es", "h1") for i in range(50)]
    rows += [(300 + i, "La maison de la rue est dans une ville avec des arbres et les gens", "fr", "h2") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, decl string, h string")
    got = {r["doc_id"]: r["__language"] for r in L.identify(df, model, declared=F.col("decl"), host=F.col("h")).collect()}
    assert got[99] == "es" and got[101] == "fr" and got[100] == "fr"


def test_junk_is_rejected_and_odd_rows_pass(spark, model, odd_docs, no_docs):
    out = L.identify(odd_docs, model, declared=F.col("lang"), host=F.col("source"))
    assert out.columns == odd_docs.columns + ["__language", "__probability", "__text_language", "__kept"]
    got = [(r["doc_id"], r["__kept"], r["__language"]) for r in out.collect()]
    assert len(got) == 12
    assert all(not k and x is None for i, k, x in got if i in (3, 4, 5, 8))
    assert (7, True, "de") in got and (9, True, "en") in got
    noise = "".join(chr(random.Random(2).randrange(0x4E00, 0x9FFF)) for _ in range(200))
    assert not L.identify(spark.createDataFrame([(1, noise)], TEXT), model).first()["__kept"]
    assert L.identify(no_docs, model).count() == 0
    unfit = L.train(no_docs.select("lang", "text"))
    assert unfit.languages == [] and not any(r["__kept"] for r in L.identify(odd_docs, unfit).collect())


def test_rare_languages_are_known_at_every_size(spark):
    rng = random.Random(4)
    words = {"en": "the and house tree with night of a great", "eu": "etxea zuhaitza gaua eta handia dago mendian ura"}
    text = lambda x: " ".join(rng.choice(words[x].split()) for _ in range(30))
    rows = [(i, text("en"), "en") for i in range(3000)] + [(5000 + i, text("eu"), "EU") for i in range(25)]
    rows += [(6000 + i, "one text, many copies", "xx") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.train(df, rows=200)
    assert model.languages == ["en", "eu"] and abs(model.prior[1] - 25 / 3025) < 1e-3
    got = {r["doc_id"]: r["__language"] for r in L.identify(df, model, declared=F.col("lang")).collect()}
    assert all(got[5000 + i] == "eu" for i in range(25)) and all(got[i] == "en" for i in range(3000))


def test_texts_of_one_or_two_bytes_are_texts(spark, model):
    rows = [(1, "Ok", "en"), (2, "de", "es"), (3, "a", "fr"), (4, "é", "fr"), (5, "7", "en"), (6, "..", "de"), (7, "", "de"), (8, None, "en")]
    rows += [(100 + i, "the tree and the house in the night", "en") for i in range(30)]
    rows += [(200 + i, "la maison de la rue est dans une ville", "fr") for i in range(30)]
    rows += [(300 + i, "el árbol que se dice en la casa es grande", "es") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in L.identify(df, model, declared=F.col("lang")).collect()}
    assert all(got[i]["__kept"] and got[i]["__language"] and got[i]["__text_language"] for i in range(1, 5))
    assert got[2]["__language"] == "es" and got[4]["__language"] == "fr"
    assert not any(got[i]["__kept"] for i in range(5, 9))


def test_page_evidence(spark, model):
    rows = [(1, "http://a.b.example.fr/x", '<html class="x" lang="fr-CA"><script>var x</script><b>Bon&nbsp;jour</b><!-- no -->'),
            (2, None, None), (3, "not a url %", "<p>hi</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = df.select("page_id", *[c.alias(k) for k, c in L.page_evidence(df).items()]).collect()
    assert got[0].asDict() == {"page_id": 1, "text": got[0]["text"], "declared": "fr", "host": "a.b.example.fr", "suffix": "fr", "domain": "example.fr"}
    assert got[0]["text"].split() == ["Bon&nbsp;jour"]
    assert got[1]["host"] is None and got[1]["text"] == "" and got[2]["host"] is None


# --- WARC ------------------------------------------------------------------------------------
def test_warc_matches_sql(spark):
    out = QUERIES["op7_warc_merge"](spark, SF)
    ok, why = compare(out, duck_connection(SF), ORACLE_SQL["op7_warc_merge"])
    assert ok, why
    rows = out.orderBy("position").collect()
    assert [r["position"] for r in rows] == list(range(len(rows)))
    key = [(r["url_key"], r["captured"], r["page_id"]) for r in rows]
    assert key == sorted(key)


def test_warc_odd_rows(spark, tmp_path):
    big = "<p>é漢\U0001F600</p>\r\n\r\nWARC/1.1\r\n" * 20
    rows = [(5, "http://x.org/b", big, "z"), (3, "http://X.org:80/a", big, "z"), (9, "http://x.org/b", big, "z"), (3, "http://x.org/a", big, "z"),
            (None, None, big, None), (1, None, None, None), (2, "", "", "z"), (4, "bad\r\nurl: %", "small", "z"), (6, "http://x.org/b", "small", "z"),
            (7, "http://www.x.org/c", "y" * 3_000_000, "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, payload string").repartition(3)
    path = str(tmp_path / "w")
    write_warc(df, path, captured=F.timestamp_seconds(F.lit(100) - F.coalesce("page_id", F.lit(0))))
    out = read_captures(spark, path).orderBy("position").collect()
    assert len(out) == 10 and [r["position"] for r in out] == list(range(10))
    kinds = Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in out if r["payload_bytes"] == len(big.encode()))
    assert kinds == {(3, "response", None): 2, (5, "revisit", 3): 1, (9, "revisit", 3): 1, (None, "revisit", 3): 1}
    assert all(r["record_type"] == "response" for r in out if r["payload_bytes"] < 100)
    assert {r["payload_digest"] for r in out if r["page_id"] in (1, 2)} == {hashlib.sha256(b"").hexdigest()}
    assert [r["page_id"] for r in out if r["url_key"] == "org,x)/b"] == [9, 6, 5]  # by time
    assert archive(df.limit(0)).count() == 0


def test_records_of_several_gzip_members_and_damage():
    import gzip
    one = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nab\r\nc\r\n\r\n"
    data = gzip.compress(one) + gzip.compress(one + one)
    got = list(records(memoryview(data)))
    assert [(o, b) for o, _, b in got] == [(i * len(one), b"ab\r\nc") for i in range(3)]
    with pytest.raises(ValueError):
        list(records(memoryview(gzip.compress(one[:-6]))))


def test_a_changed_payload_is_an_error(spark, tmp_path):
    import gzip
    path = str(tmp_path / "w")
    write_warc(spark.createDataFrame([(1, "http://x", "hello")], "page_id long, url string, html string").coalesce(1), path)
    file = next((tmp_path / "w").glob("*.gz"))
    file.write_bytes(gzip.compress(gzip.decompress(file.read_bytes()).replace(b"hello", b"hallo")))
    next((tmp_path / "w").glob(".*.gz.crc")).write_bytes(b"")
    with pytest.raises(Exception):
        read_captures(spark, path).count()


@pytest.mark.parametrize("k", range(9))
def test_loser_tree(k):
    rng = random.Random(k)
    for _ in range(50):
        runs = [sorted(rng.randrange(20) for _ in range(rng.randrange(6))) for _ in range(k)]
        assert list(LoserTree(runs, lambda x: x)) == sorted(sum(runs, []))


def test_url_keys():
    assert url_key("https://WWW.Example.com:443/A?b=C#d") == "com,example)/a?b=c"
    assert url_key("http://example.com:8080") == "com,example:8080)/"
    assert url_key("") == "" and url_key("http://[bad") == "http://[bad"


# --- language model --------------------------------------------------------------------------
def brute_scores(docs, share):
    """The same model from dictionaries: [(tokens, known, N, base, score)] for (id, text, held out)."""
    toks = [plain_words(t) + ["</s>"] for _, t, _ in docs]
    train = [t for t, d in zip(toks, docs) if not d[2]]
    uni = Counter(w for t in train for w in t)
    n, v = sum(uni.values()), len(uni)
    least = max(1.0, share * n)
    vocab = {w for w, c in uni.items() if c >= least}
    history = {(): n, ("<s>",): len(train)} | {(w,): uni[w] for w in vocab if w != "</s>"}
    arcs = {}
    for length in (1, 2):
        seen = Counter()
        for t in train:
            s = ["<s>"] + t
            for i in range(length, len(s)):
                h = tuple(s[i - length:i])
                if h in history and s[i] in vocab:
                    seen[h + (s[i],)] += 1
        arcs |= {g: c for g, c in seen.items() if c >= 2}
        if length == 1:
            history |= {g: c for g, c in seen.items() if c >= max(2, least) and g[-1] != "</s>"}
    kept = Counter()
    for g, c in arcs.items():
        kept[g[:-1]] += c - 0.75

    def p(h, w):
        if not h:
            return (uni[w] + 1) / (n + v + 1)
        if h not in history:
            return p(h[1:], w)
        return max(0.0, arcs.get(h + (w,), 0.75) - 0.75) / history[h] + (1 - kept[h] / history[h]) * p(h[1:], w)
    out = []
    for t in toks:
        s = ["<s>"] + t
        out.append((len(t), sum(w in uni for w in t), n, sum(math.log10(p((), w)) for w in t),
                    sum(math.log10(p(tuple(s[max(0, i - 2):i]), s[i])) for i in range(1, len(s)))))
    return out


@pytest.mark.parametrize("share,block", [(5e-5, 16 << 20), (2e-3, 20_000)])
def test_scores_match_brute_force(spark, share, block):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    got = {r["doc_id"]: r for r in score_texts(df, held_out=held, state_share=share, block_bytes=block).collect()}
    docs = [(r["doc_id"], r["text"], zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2) for r in df.collect()]
    assert len(got) == len(docs)
    for d, want in zip(docs, brute_scores(docs, share)):
        r = got[d[0]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (*want[:3], d[2])
        assert math.isclose(r["base_score"], want[3], rel_tol=1e-9) and math.isclose(r["score"], want[4], rel_tol=1e-9)


def test_automaton_beats_unigrams_on_held_out_text(spark):
    rows = QUERIES["op8_backoff_scoring"](spark, SF).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert rows[0] > rows[1]


def test_lm_odd_rows(spark, odd_docs, no_docs):
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    rows = score_texts(odd_docs, held_out=held).collect()
    assert len(rows) == 12 and all(np.isfinite([r["score"], r["base_score"]]).all() for r in rows)
    assert [r["n_tokens"] for r in rows if r["doc_id"] in (3, 4, 5)] == [1, 1, 1]
    assert not any(r["held_out"] for r in rows if r["doc_id"] is None)
    assert [r["n_tokens"] for r in rows if r["doc_id"] == 7] == [60_001]
    none = score_texts(odd_docs, held_out=F.lit(True)).collect()
    assert all(r["score"] == 0.0 and r["train_tokens"] == 0 and r["n_known"] == 0 for r in none)
    assert score_texts(no_docs).count() == 0


def test_every_repeated_ngram_counts_whatever_its_share(spark):
    # of 120,000 words, each passage's stand 3 times: far under one in 20,000
    rng = random.Random(5)
    passages = [" ".join(f"w{p}x{i}" for i in range(12)) for p in range(10)]
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(400)) for _ in range(300)] + passages * 3
    rows = [(i, t, False) for i, t in enumerate(texts)] + [(1000 + i, t, True) for i, t in enumerate(passages)]
    df = spark.createDataFrame(rows, "doc_id long, text string, out boolean")
    got = {r["doc_id"]: r for r in score_texts(df, held_out=F.col("out"), block_bytes=20_000).collect()}
    for d, want in zip(rows, brute_scores(rows, 0.0)):
        r = got[d[0]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == want[:3]
        assert math.isclose(r["base_score"], want[3], rel_tol=1e-9) and math.isclose(r["score"], want[4], rel_tol=1e-9)
    assert all(got[1000 + i]["score"] > 0.3 * got[1000 + i]["base_score"] for i in range(10))


def test_buckets_and_spread_pairs_change_nothing(spark):
    """Pairs of words that each hold more than a bucket's share have their triples in many buckets; scores stay those of dictionaries."""
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["the", "of", "a", *(f"r{i}" for i in range(40))]) if rng.random() < 0.5 else "the" for _ in range(rng.randint(0, 300)))
             for _ in range(200)] + ["", None, "the", "the of"]
    rows = [(i, t, i % 7 == 2) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, out boolean").repartition(3)
    for block, bucket in ((3_000, 4_000), (20_000, 1_000), (1 << 20, 30_000)):
        got = {r["doc_id"]: r for r in score_texts(df, held_out=F.col("out"), block_bytes=block, bucket_bytes=bucket).collect()}
        assert len(got) == len(rows)
        for d, want in zip(rows, brute_scores([(i, t or "", o) for i, t, o in rows], 0.0)):
            r = got[d[0]]
            assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == want[:3]
            assert math.isclose(r["base_score"], want[3], rel_tol=1e-9) and math.isclose(r["score"], want[4], rel_tol=1e-9)


def test_walk_takes_failure_arcs():
    """Word 1 has no arc at state 2: the failure arcs to state 1 and the root are taken, and their weights counted."""
    arcs = {0 * 2 + 0: 0, 0 * 2 + 1: 1, 1 * 2 + 0: 2}
    assert walk([(0, 3), (3, 3)], [0, 0, 1], 1, arcs, [-1.0, -2.0, -0.5], [0, 0, 2], [0, 0, 1], [0.0, -0.25, -0.125], 2) == [-0.5 - (0.125 + 0.5) - (0.125 + 0.25 + 2.0), 0.0]


def test_own_sentences_need_no_known_word(spark):
    """What is passed over follows from the sentences given, not from the built-in ones."""
    from quarry.llm.licence import scan_licences as scan
    own = {"this file is dedicated to the public domain": "Domain", "do as you like": "Like", "v1.0 applies": "V"}
    texts = ["This file is dedicated to the public domain.", "Hello. Do as\n  you like!", "V1.0 applies", "nothing", None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    rules = [("PD", ["Domain"]), ("WTF", ["Like"]), ("V1", ["V"])]
    got = {r["doc_id"]: r["__licences"] for r in scan(docs, sentences=own, rules=rules).collect()}
    assert got == {0: ["PD"], 1: ["WTF"], 2: ["V1"], 3: [], 4: []}
    assert all(r["__sentences"] == [] for r in scan(docs, sentences={}, rules=rules).collect())


def test_one_language_threshold_at_every_size(spark):
    """Twelve Finnish texts make a language beside 450 English ones and beside 1500."""
    fi = [("fi", f"tämä on suomenkielinen lause numero {i} ja siinä on sanoja") for i in range(12)]
    for n in (450, 1500):
        rows = fi + [("en", f"this is the english sentence number {i} with some words") for i in range(n)]
        assert L.train(spark.createDataFrame(rows, "lang string, text string")).languages == ["en", "fi"]


def test_long_texts_are_walked_in_parts():
    """Parts of a text, each read from a little before its start, give the sums of a walk token by token, over arcs, failure arcs and no text."""
    rng = random.Random(3)
    words, pairs = 6, {}
    for u in range(4):  # states: the root, the start, a word each, and some pairs
        for v in rng.sample(range(4), 2):
            pairs[u, v] = 6 + len(pairs)
    states = 6 + len(pairs)
    arcs = {w: w for w in range(words)}
    target = [2 + w if w < 4 else 0 for w in range(words)]
    fail = [0] * 6 + [2 + v for _, v in pairs]
    for (u, v), s in zip(pairs, range(6, states)):
        arcs[(2 + u) * words + v] = len(target)
        target.append(s)
        for w in (w for x, w in pairs if x == v):
            arcs[s * words + w] = len(target)
            target.append(6 + list(pairs).index((v, w)))
    weight = [rng.uniform(-3, 0) for _ in target]
    fail_weight = [rng.uniform(-1, 0) for _ in fail]
    sizes = [0, 1, 7, 300, 0, 41]
    word = [rng.randrange(words) for _ in range(sum(sizes))]
    texts, at = [], 0
    for n in sizes:
        texts.append((at, at + n))
        at += n
    want = []
    for i, j in texts:
        state, total = 1, 0.0
        for w in word[i:j]:
            while state * words + w not in arcs:
                total += fail_weight[state]
                state = fail[state]
            total += weight[arcs[state * words + w]]
            state = target[arcs[state * words + w]]
        want.append(total)
    keys = np.array(sorted(arcs, key=arcs.get))
    for part in (2, 5, 64, 1000):
        assert walk(texts, word, 1, arcs, weight, target, fail, fail_weight, words, part) == want
        assert walk(texts, np.array(word), 1, keys, np.array(weight), np.array(target), np.array(fail), np.array(fail_weight), words, part) == want


def test_words_are_asked_for_in_packed_pieces(spark, odd_docs):
    """No word of a block is a row of a join, and a block holds numbers of words, no texts."""
    from quarry.llm import lm
    plan = score_texts(odd_docs)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "CoGroup" in plan
    docs = pa.table({"id": [1, None], "held_out": [False, True], "text": ["a B a", None]}).to_batches()
    block, = lm._blocks(1 << 20)(iter(docs))
    (_, ids, _, word, word_at, n, trained), = lm._docs([block.append_column("block", pa.array([0]))])
    t, _ = lm.tokens(docs[0].column("text"))
    assert ids.to_pylist() == [1, None] and n.tolist() == [4, 1] and word[word_at].tolist() == t.tolist() and trained.tolist() == [True] * 4 + [False]


@pytest.mark.parametrize("size", [50, 1 << 30])
def test_ngrams_are_ordered_alike_whatever_the_number_of_groups(size):
    from quarry.llm.lm import _distinct
    rng = np.random.default_rng(2)
    major, part, trained = rng.integers(0, 50, 3000), rng.integers(0, 40, 3000).astype(np.uint64) << np.uint64(33), rng.random(3000) < 0.5
    rep, inverse, own = _distinct(major, part, size, trained)
    pairs = list(zip(major.tolist(), part.tolist()))
    assert [pairs[i] for i in rep] == sorted(set(pairs)) and [sorted(set(pairs))[i] for i in inverse] == pairs
    count = Counter(p for p, t in zip(pairs, trained) if t)
    assert own.tolist() == [count[p] for p in sorted(set(pairs))]
