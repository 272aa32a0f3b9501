"""Spelling variants against brute force."""

import re
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from oracle_check import compare, duck_connection
from quarry.llm.queries import ORACLE_SQL, QUERIES
from quarry.llm.variants import decompose, grams_at, near_words, padded, spelling_variants

SF01 = "/root/testdata/sf0.01"
FIXED = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(docs, min_length=5, min_count=3, delete_every=97):
    n = Counter()
    for i, text in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(FIXED)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % delete_every == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            n[w] += 1
    n = {w: c for w, c in n.items() if len(w) >= min_length and c >= min_count}
    by = {w: [v for v in n if near(w, v)] for w in n}
    form = {}
    for w, vs in by.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(by[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect())


def test_matches_sql(spark):
    name = "op11_spelling_variants"
    ok, why = compare(QUERIES[name](spark, SF01), duck_connection(SF01), ORACLE_SQL[name])
    assert ok, why


@pytest.mark.parametrize("qmin,qmax,long_list", [(2, 4, 512), (2, 4, 3), (2, 3, 8), (3, 5, 512)])
def test_every_pair_of_a_dense_vocabulary(spark, qmin, qmax, long_list):
    """Few letters: bounds that spare no gram, long lists, and repeated grams in a word."""
    rng = np.random.default_rng(qmax)
    words = {"".join(w) for w in product("abé", repeat=5)}
    words |= {"".join(rng.choice(list("abc"), rng.integers(5, 12))) for _ in range(300)} | {"a" * k for k in range(5, 30)}
    words = sorted(words)
    words += ["x" * 70, "x" * 71, "x" * 69 + "y", "y" + "x" * 70]  # longer than what is compared at once
    vocabulary = spark.createDataFrame([(bytearray(w, "latin-1"), i + 1) for i, w in enumerate(words)], "word binary, n long")
    got = {(r["word"].decode("latin-1"), r["near"].decode("latin-1")) for r in near_words(vocabulary, qmin, qmax, long_list).collect()}
    assert got == {(a, b) for a in words for b in words if near(a, b)}


word = st.text("abcdé", min_size=5, max_size=9)


@settings(max_examples=300, deadline=None)
@given(word, st.integers(0, 9), st.sampled_from("dra"), st.sampled_from("abcdé"), st.sets(st.integers(0, 400), max_size=200))
def test_bound_holds(w, at, kind, letter, picks):
    """No edit spoils more grams than the bound says, whatever the dictionary."""
    at = at % len(w)
    v = {"d": w[:at] + w[at + 1:], "r": w[:at] + letter + w[at + 1:], "a": w[:at] + letter + w[at:]}[kind]
    offsets = np.array([0, len(w), len(w) + len(v)])
    o, flat = padded(offsets, np.frombuffer((w + v).encode("latin-1"), np.uint8), 3)
    every = np.unique(np.concatenate([grams_at(flat, q) for q in (2, 3)]))
    frequent = {int(every[i % len(every)]) for i in picks}
    # a gram that is frequent has frequent beginnings
    frequent = np.array(sorted(g for g in frequent if g >> 24 != 3 or (g >> 8 & 0xFFFF | 2 << 16) in frequent), np.int64)
    _, gram, word_, bound = decompose(o, flat, frequent, 2, 4)
    a, b = gram[word_ == 0].tolist(), gram[word_ == 1].tolist()
    common = sum((Counter(a) & Counter(b)).values())
    assert common >= len(a) - bound[0] and common >= len(b) - bound[1]


def test_small_texts(spark, odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.select("doc_id", "text").collect()]
    assert rows_of(spelling_variants(odd_docs)) == brute(rows)
    assert rows_of(spelling_variants(odd_docs, min_count=1, min_length=1, delete_every=2)) == brute(rows, 1, 1, 2)
    assert spelling_variants(no_docs).count() == 0


def test_forms_lead_to_roots(spark):
    text = ("colour " * 40 + "color " * 12 + "colors " * 6 + "colorss " * 3 + "Köln " * 3 + "KÖLN " * 3).strip()
    got = {r[0]: r for r in rows_of(spelling_variants(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string"),
                                                      min_length=4, delete_every=None))}
    assert got["colorss"][2] == "colour" and got["colors"][1] == "color" and got["colour"][1] is None
    assert got["köln"][3] == 3 and got["kÖln"][3] == 3  # only A-Z are lower-cased, and neither form is twice as common


def test_ratio_must_end_chains(spark, no_docs):
    with pytest.raises(ValueError):
        spelling_variants(no_docs, ratio=1)
