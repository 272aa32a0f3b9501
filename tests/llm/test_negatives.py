"""Hard negatives against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from oracle_check import compare, duck_connection
from quarry.llm.negatives import SuffixIndex, hard_negatives
from quarry.llm.queries import ORACLE_SQL, QUERIES

SF01 = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<double>, label int, id string, rank string, score string, block string, v string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, y, "a", "b", "c", "d", "e") for i, v, y in rows], SCHEMA)


def brute(rows, every=100, positives=5, negatives=10):
    rows = [(i, np.floor(256 * np.array(v, np.float64)).astype(np.int64), y) for i, v, y in rows]
    out = []
    for i, v, y in rows:
        if i % every:
            continue
        s = sorted(((-int(v @ w), j, z) for j, w, z in rows if j != i))
        for p, j in [(-p, j) for p, j, z in s if z == y][:positives]:
            window = [(-n, k) for n, k, z in s if z != y and 30 * p <= -100 * n <= 90 * p][:negatives]
            out += [(i, j, r + 1, k, p, n) for r, (n, k) in enumerate(window)]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in df.collect())


def test_matches_sql(spark):
    name = "op12_hard_negatives"
    ok, why = compare(QUERIES[name](spark, SF01), duck_connection(SF01), ORACLE_SQL[name])
    assert ok, why


@pytest.mark.parametrize("dims,labels,block", [(3, 2, 50), (8, 3, 64), (20, 1, 1000), (33, 40, 97)])
def test_brute_force(spark, dims, labels, block):
    rng = np.random.default_rng(dims)
    centre = rng.standard_normal((labels, dims))
    rows = []
    for i in range(400):
        y = int(rng.integers(labels))
        rows.append((i, (centre[y] + rng.standard_normal(dims) * 0.8).round(2).tolist(), y))
    rows += [(1000 + i, rows[i][1], rows[i][2]) for i in range(0, 60, 3)]  # copies tie
    got = rows_of(hard_negatives(frame(spark, rows), is_anchor=lambda i: i % 20 == 0, row_block=block))
    assert got == brute(rows, every=20)


def test_values_beyond_exact_doubles(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.standard_normal(4) * 2e5).tolist(), i % 2) for i in range(60)]
    assert rows_of(hard_negatives(frame(spark, rows), is_anchor=lambda i: i % 20 == 0)) == brute(rows, every=20)


def test_pruning_reads_less_than_brute_force():
    """Clustered vectors, thresholds near the top: lists end early and few rows are verified."""
    rng = np.random.default_rng(7)
    n, d = 20_000, 64
    scale = 0.85 ** np.arange(d)
    x = np.floor(256 * rng.standard_normal((n, d)) * scale)
    index = SuffixIndex(np.arange(n), np.zeros(n, np.int64), x)
    q = x[:16]
    top = np.sort(q @ x.T, axis=1)[:, -10:]
    found = index.search(q, lambda i: np.ones(n, bool), lambda i, level: top[i, 0], lambda i, s, t: True)
    assert all(sorted(s.tolist())[-10:] == t.tolist() for (_, s), t in zip(found, top))
    assert index.operations < 0.6 * len(q) * n * d


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(0, [1.0, 0.0], 1), (1, [0.9, 0.1], 1), (2, [0.5, 0.2], 2), (3, [0.5, 0.2], 2), (4, [-1.0, 0.0], 2), (5, [0.0, 0.0], 2)]
    odd = [(6, None, 1), (7, [1.0, None], 1), (8, [nan, 1.0], 2), (9, [inf, 0.0], 2), (10, [1.0], 1), (11, [], 2), (12, [0.5, 0.2], None),
           (None, [0.5, 0.2], 2), (13, [1e300, 0.0], 2)]
    got = hard_negatives(frame(spark, good + odd + good), is_anchor=lambda i: i % 100 == 0)  # repeated rows count once
    assert rows_of(got) == brute(good)
    assert hard_negatives(frame(spark, []), is_anchor=lambda i: i % 100 == 0).count() == 0
    assert hard_negatives(frame(spark, good), is_anchor=lambda i: F.lit(False)).count() == 0
    alone = hard_negatives(frame(spark, [(0, [1.0, 2.0], 1)]))
    assert alone.count() == 0


def test_zero_and_negative_positives(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [-1.0, 0.0], 1), (3, [0.0, 2.0], 2), (4, [0.3, 0.0], 2), (5, [-0.5, 0.0], 2)]
    assert rows_of(hard_negatives(frame(spark, rows))) == brute(rows) != []
