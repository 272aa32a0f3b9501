"""MaxSim retrieval by posting lists against scoring every document."""

import numpy as np

from quarry.operators.late_interaction import TokenPostings, fit_centroids, maxsim_topk

DIM = 4


def brute(queries, docs, k):
    out = set()
    for qi, q in queries:
        best = {}
        for di, d in docs:
            s = round(float((np.reshape(q, (-1, DIM)) @ np.reshape(d, (-1, DIM)).T).max(axis=1).sum()), 9)
            best[di] = max(s, best.get(di, -np.inf))
        for r, (di, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k], 1):
            out.add((qi, di, r, s))
    return out


def run(spark, queries, docs, k, **kw):
    q = spark.createDataFrame(queries, "query_id long, embedding array<double>")
    d = spark.createDataFrame(docs, "doc_id long, embedding array<double>").repartition(5)
    return {(r["query_id"], r["doc_id"], r["rank"], round(r["maxsim"], 9)) for r in maxsim_topk(q, d, k, DIM, **kw).collect()}


def texts(rng, n, first=0):
    """Documents of one to six tokens on a coarse grid, so that scores tie."""
    return [(first + i, [float(x) for x in np.round(rng.standard_normal(DIM * rng.integers(1, 7)), 0)]) for i in range(n)]


def test_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    docs, queries = texts(rng, 400), texts(rng, 12, 1000)
    docs += [(2000 + i, docs[7][1]) for i in range(200)]  # a third of the rows alike
    docs += docs[:40] + [(5, docs[9][1])]  # repeated rows, and an id with two vectors
    queries += [(1100, [0.0] * DIM), (1101, docs[7][1])]
    want = brute(queries, docs, 7)
    assert run(spark, queries, docs, 7) == want
    assert run(spark, queries, docs, 7, max_broadcast_bytes=200, max_centroids=3) == want  # several blocks, coarse lists
    assert run(spark, queries, docs[:3], 7) == brute(queries, docs[:3], 7)  # fewer documents than asked for


def test_odd_vectors_take_no_part(spark):
    ok = [1.0, 0.0, 0.0, 0.0]
    odd = [None, [], [1.0], ok + [1.0], [float("nan")] + ok[1:], [None] + ok[1:], [float("inf")] + ok[1:]]
    docs = [(1, ok), (None, ok), *[(10 + i, v) for i, v in enumerate(odd)]]
    queries = [(1, ok), (None, ok), *[(10 + i, v) for i, v in enumerate(odd)]]
    assert run(spark, queries, docs, 3) == {(1, 1, 1, 1.0)}
    assert run(spark, queries, docs[2:], 3) == set() and run(spark, [], docs, 3) == set() and run(spark, queries, [], 3) == set()


def test_reading_ends_early():
    """On clustered tokens most documents are neither read to the end nor scored, and none of the best is missed."""
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((60, 16)) * 3
    pick = lambda n: centres[rng.integers(0, 60, (n, 4))] + 0.05 * rng.standard_normal((n, 4, 16))
    docs, asked = pick(5000), pick(20)
    lists = TokenPostings(np.arange(5000), [d.ravel() for d in docs], fit_centroids(docs[:600].reshape(-1, 16), 64))
    for q in asked:
        best = lists.search(q, (np.full((1, 5), -np.inf), np.full((1, 5), 1 << 62)), 5)
        s = np.einsum("qd,ntd->qnt", q, docs).max(axis=2).sum(axis=0)
        assert best[1][0].tolist() == np.lexsort((np.arange(5000), -np.round(s, 12)))[:5].tolist()
    assert lists.scored < 0.2 * 20 * 5000
    assert lists.read < 0.7 * 20 * 4 * len(lists.doc)


def test_lists_and_dense_scores_agree(spark):
    """Both ways equal brute force, on ragged texts, copies, ties, and numbers beyond single precision."""
    rng = np.random.default_rng(4)
    docs, queries = texts(rng, 300), texts(rng, 10, 1000)
    docs += docs[:60] * 2 + [(5, docs[9][1]), (3000, [1e18] * DIM), (3001, [1e-18] * DIM), (3002, [1.0 + 1e-9] * DIM), (3003, [1.0] * DIM)]
    queries += [(1100, [0.0] * DIM), (1101, docs[7][1]), (1102, [1e16, 0.0, 0.0, 1.0]), (1103, [1.0] * DIM)]
    want = sorted(brute(queries, docs, 6))
    for work in (0, 1 << 60):
        got = sorted(run(spark, queries, docs, 6, list_work=work))
        assert [x[:3] for x in got] == [x[:3] for x in want] and np.allclose([x[3] for x in got], [x[3] for x in want], rtol=1e-14, atol=0)


def test_dense_scores_confirm_few():
    """Queries are scored together: of the pairs only those near the k-th best are scored a second time, and none of the best is missed."""
    from quarry.operators.late_interaction import DenseScores
    rng = np.random.default_rng(5)
    docs, asked = rng.standard_normal((6000, 32)), [x.reshape(-1, 8) for x in rng.standard_normal((150, 32))]
    scores, confirmed = DenseScores(np.arange(6000), list(docs), 8), []
    scores._exact = lambda *a: (confirmed.append(len(a[-1])), DenseScores._exact(scores, *a))[1]
    best = np.full((150, 5), -np.inf), np.full((150, 5), 1 << 62)
    scores.search(asked, best, 5)
    for q, ids in zip(asked, best[1]):
        s = np.einsum("qd,ntd->qnt", q, docs.reshape(-1, 4, 8)).max(axis=2).sum(axis=0)
        assert ids.tolist() == np.lexsort((np.arange(6000), -np.round(s, 12)))[:5].tolist()
    assert sum(confirmed) < 0.01 * 150 * 6000 and len(confirmed) < 20 * 150
