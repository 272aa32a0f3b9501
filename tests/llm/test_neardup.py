"""Near-duplicate join against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quarry.llm import neardup as N
from quarry.llm.queries import QUERIES


def sets(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(docs, k, percent=80):
    """Smallest id reachable for every (id, text)."""
    s = [sets(t, k) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in range(len(docs)):
        for b in range(a):
            both = len(s[a] & s[b])
            if s[a] and s[b] and 100 * both >= percent * (len(s[a]) + len(s[b]) - both):
                root[find(a)] = find(b)
    best = {}
    for x, (i, _) in enumerate(docs):
        best[find(x)] = min(best.get(find(x), i), i)
    return [(i, len(s[x]), best[find(x)]) for x, (i, _) in enumerate(docs)]


def corpus(seed=0):
    """Groups of copies, chains of near copies, borderline pairs and a passage that many share."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    out, passage = [], text(40)
    for _ in range(12):
        base = text(rng.randrange(20, 150))
        out += [" ".join(base)] * rng.randrange(1, 6)
        for _ in range(rng.randrange(8)):
            edit = list(base)
            for _ in range(rng.randrange(1, 6)):
                edit[rng.randrange(len(edit))] = rng.choice(words)
            out.append(" ".join(edit))
            base = edit if rng.random() < 0.5 else base
    out += [" ".join(text(60) + passage + text(60)) for _ in range(40)]
    out += ["", " \n", "a", "A", "a b c", "a b c", "A B C D"]
    rng.shuffle(out)
    return list(enumerate(out, 100))


@pytest.mark.parametrize("small,depth", [(1024, 8), (8, 8), (6, 2)])
def test_against_brute_force(spark, small, depth):
    docs = corpus(small)
    got = N.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), shingle=4, small_node=small, max_depth=depth)
    got = sorted(tuple(r) for r in got.select("doc_id", "__n", "__component").collect())
    assert got == sorted(brute(docs, 4))


def test_query_on_a_table(spark):
    sf = "/root/testdata/sf0.001"
    out = QUERIES["op4_minhash_near_dedup"](spark, sf).collect()
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out) == sorted(brute(docs, 4))
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out)


def test_odd_rows(spark, odd_docs, no_docs):
    out = N.near_duplicates(odd_docs, shingle=5)
    assert out.columns == odd_docs.columns + ["__n", "__component", "__winner"]
    rows = out.select("doc_id", "text", "__n", "__component", "__winner").collect()
    assert len(rows) == 12
    copies = [r for r in rows if (r["text"] or "").lower().startswith("one")]
    assert len(copies) == 4 and {r["__component"] for r in copies} == {1} and sum(r["__winner"] for r in copies) == 1
    assert all(r["__winner"] and r["__component"] == r["doc_id"] for r in rows if not (r["text"] or "").strip())
    assert [r["__n"] for r in rows if r["doc_id"] == 6] == [1]
    assert N.near_duplicates(no_docs).count() == 0


def test_null_ids_only(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (None, None)], "doc_id long, text string")
    rows = N.near_duplicates(df).collect()
    assert [r["__component"] for r in rows] == [None] * 3 and sum(r["__winner"] for r in rows) == 2


def test_components_of_long_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, x) for x in range(1001, 1300)] + [(5000, 5000)]
    got = {r["kid"]: r["comp"] for r in N.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(201)) and all(got[i] == 1000 for i in range(1000, 1300)) and 5000 not in got
    none = spark.createDataFrame([], "a long, b long")
    assert N.components(none).count() == 0


def test_one_large_group_makes_few_links(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    docs = [(300, " ".join(base))]
    for i in range(300):
        t = list(base)
        for _ in range(4):
            t[rng.randrange(200)] = f"x{rng.randrange(10 ** 6)}"
        docs.append((i, " ".join(t)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    seen = []
    real = N._Join.links

    def counted(self, members):
        out = real(self, members)
        seen.append(out.count())
        return out
    try:
        N._Join.links = counted
        out = N.near_duplicates(df, shingle=4, small_node=32).agg(F.countDistinct("__component")).first()[0]
    finally:
        N._Join.links = real
    assert out == 1
    assert sum(seen) < 2 * len(docs)  # a spanning forest per seed token, hardly anything after that
