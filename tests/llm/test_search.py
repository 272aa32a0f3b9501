"""Exact Hamming search and collision-counting neighbours."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import ann
from quarry.llm.ann import CollisionIndex, inner_product_neighbours
from quarry.llm.hamming import MultiIndex, hamming_top_k
from quarry.llm.queries import ORACLE_SQL, QUERIES
from oracle_check import compare, duck_connection

SF01 = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>, label int, id string, rank string, score string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, "a", "b", "c") for i, v in rows], SCHEMA)


def test_hamming_matches_sql(spark):
    name = "op1_exact_hamming_search"
    ok, why = compare(QUERIES[name](spark, SF01), duck_connection(SF01), ORACLE_SQL[name])
    assert ok, why


@pytest.mark.parametrize("bits", [8, 16])
@pytest.mark.parametrize("width", [1, 3, 8])
def test_multi_index_is_exact(bits, width):
    rng = np.random.default_rng(bits + width)
    codes = rng.integers(0, 256, (300, width), dtype=np.uint8)
    codes[100:200] = codes[0]  # a group of copies
    ids = rng.permutation(300).astype(np.int64)
    index = MultiIndex(ids, codes, bits)
    for q in range(0, 300, 17):
        d = np.bitwise_count(codes ^ codes[q]).sum(axis=1)
        want = sorted((int(x), int(i)) for x, i in zip(d, ids) if i != ids[q])[:12]
        got_ids, got = index.top(codes[q], int(ids[q]), 12)
        assert [(int(x), int(i)) for x, i in zip(got, got_ids)] == want


def test_search_ends_before_all_is_seen():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 256, (5000, 8), dtype=np.uint8)
    codes[:50, :7] = codes[0, :7]
    index = MultiIndex(np.arange(5000), codes)
    looked = []
    index.ids = np.arange(5000)
    real = np.bitwise_count
    try:
        np.bitwise_count = lambda x: looked.append(len(x)) or real(x)
        index.top(codes[0], 0, 10)
    finally:
        np.bitwise_count = real
    assert sum(looked) < 2500


def odd(spark):
    rng = np.random.default_rng(5)
    v = [[float(x) for x in r] for r in rng.standard_normal((30, 64))]
    rows = [(i, x) for i, x in enumerate(v)]
    rows += [(100, v[0]), (101, v[0]), (101, v[0]), (102, None), (103, []), (104, [0.0] * 64), (105, [float("nan")] + v[1][1:]),
             (106, [None] + v[1][1:]), (107, [float("inf")] + v[1][1:]), (None, v[2]), (108, v[3][:8]), (200, v[0])]
    return vectors(spark, rows), v


def test_hamming_odd_rows(spark):
    df, v = odd(spark)
    out = hamming_top_k(df, k=3).collect()
    by = {}
    for r in sorted(out, key=lambda r: (r["query_id"], r["rank"])):
        by.setdefault(r["query_id"], []).append((r["vec_id"], r["distance"]))
    assert set(by) == {0, 100, 200}
    assert by[0] == [(100, 0), (101, 0), (200, 0)]
    assert by[200] == [(0, 0), (100, 0), (101, 0)]
    assert hamming_top_k(df.limit(0), k=3).count() == 0


def test_neighbours_odd_rows(spark):
    df, v = odd(spark)
    out = inner_product_neighbours(df, k=40).collect()
    queries = {r["query_id"] for r in out}
    assert queries == {0, 20, 100, 200}  # 104 and other invalid ones take no part
    mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in out if r["query_id"] == 0)
    x = {i: np.array(e, np.float32).astype(float) for i, e in enumerate(v)} | {i: np.array(v[0], np.float32).astype(float) for i in (100, 101, 200)}
    want = sorted(((-float((x[0] * e).sum()), i) for i, e in x.items() if i != 0))
    assert [m[1] for m in mine] == [i for _, i in want]
    assert np.allclose([m[2] for m in mine], [-s for s, _ in want], rtol=1e-12)
    assert inner_product_neighbours(df.limit(0)).count() == 0
    assert out[0].asDict().keys() == {"query_id", "rank", "vec_id", "score"}


def test_neighbours_recall(spark):
    sf = "/root/testdata/sf0.1"
    out = QUERIES["op3_collision_neighbours"](spark, sf).toPandas()
    e = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").select("vec_id", F.col("embedding").cast("array<double>")).toPandas()
    x, ids = np.stack(e["embedding"].to_numpy()), e["vec_id"].to_numpy()
    hit = total = 0
    for q, g in out.groupby("query_id"):
        s = (x * x[ids == q][0]).sum(axis=1)
        s[ids == q] = -np.inf
        best = set(ids[np.lexsort((ids, -s))[:20]])
        hit += len(best & set(g["vec_id"]))
        total += 20
        assert list(g.sort_values("rank")["score"]) == sorted(g["score"], reverse=True)
    assert total == 20 * (ids % 20 == 0).sum()
    assert hit / total >= 0.9


@pytest.mark.parametrize("n", [1000, 5000, 30000])
def test_collision_search_work_and_recall(n):
    """Windows grow by what they add: every entry is read once, and the work stays below comparing every row."""
    rng = np.random.default_rng(n)
    centres = rng.standard_normal((50, 64))
    x = centres[rng.integers(0, 50, n)] + rng.standard_normal((n, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids, own = np.arange(n), np.arange(0, n, n // 40)
    index = CollisionIndex(ids, x, 1.0)
    hit, asked = 0, set()
    for q, found, score in index.top(x[own], own, 20):
        s = x @ x[own[q]]
        s[own[q]] = -np.inf
        hit += len(set(np.argsort(-s)[:20]) & set(found.tolist()))
        asked.add(q)
    assert asked == set(range(len(own)))
    assert hit >= 0.9 * 20 * len(own)
    assert index.counted <= len(own) * n * 64  # no entry twice
    if n >= 5000:  # the least number of verified rows weighs on small blocks
        assert index.counted + index.verified * 64 < 0.9 * len(own) * n * 64


def test_collision_counts_equal_windows():
    """The counts of grown windows are those of the last windows taken alone."""
    rng = np.random.default_rng(8)
    x = np.round(rng.standard_normal((1500, 8)), 1)  # ties in every projection
    x[x.any(axis=1) == 0] = 1.0
    norm = np.linalg.norm(x, axis=1).max()
    index = CollisionIndex(np.arange(1500), x, norm)
    p = np.c_[x / norm, np.sqrt(np.maximum(0.0, 1.0 - ((x / norm) ** 2).sum(axis=1)))] @ index.axes
    queries = x[:300]
    at = np.c_[queries / np.linalg.norm(queries, axis=1, keepdims=True), np.zeros(300)] @ index.axes
    got = dict(index.candidates(queries))
    assert set(got) == set(range(300))
    for q, found in got.items():
        for level in range(ann.LEVELS):
            w = index.width * ann.WIDEN ** level
            alone = np.flatnonzero(((p >= at[q] - w) & (p <= at[q] + w)).sum(axis=1) >= int(ann.THRESHOLD * ann.PROJECTIONS))
            if len(alone) >= ann.MIN_VERIFY:
                break
        assert abs(len(set(found) ^ set(alone))) <= 2  # rounding at a window's edge
