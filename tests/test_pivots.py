"""The pivot-cell join against brute force: clustered, skewed and odd vectors, visited cells."""

import numpy as np
import pytest

from quarry.operators import retrieve as RT
from quarry.operators.pivots import PivotIndex

SCHEMA = "{} long, embedding array<double>, note string"


def frame(spark, id_name, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "x") for i, v in rows], SCHEMA.format(id_name))


def brute(queries, rows, k):
    out = {}
    for q, v in queries:
        best = {}
        for i, w in rows:
            s = round(float(np.dot(v, w)), 12)
            best[i] = max(s, best.get(i, -np.inf))
        out[q] = [i for i, _ in sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]]
    return out


def lists(res):
    got = {}
    for r in res.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.doc_id)
    return got


def clustered(rng, n, dims, clusters, spread):
    centre = rng.standard_normal((clusters, dims))
    x = centre[rng.integers(clusters, size=n)] + spread * rng.standard_normal((n, dims))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("dims,spread,scaled,piece", [(3, 0.05, False, 40), (16, 0.2, True, 1000), (64, 3.0, False, 64)])
def test_equals_brute_force(spark, dims, spread, scaled, piece):
    rng = np.random.default_rng(dims)
    x = clustered(rng, 700, dims, 12, spread)
    if scaled:  # norms matter for inner products
        x = x * rng.exponential(2.0, (700, 1))
    rows = list(enumerate(x))
    queries = [(10_000 + i, v) for i, v in enumerate(clustered(rng, 60, dims, 12, spread) * 2.5)]
    got = RT.knn_topk(frame(spark, "query_id", queries), frame(spark, "doc_id", rows), 6, max_broadcast_bytes=0, block_rows=piece)
    assert lists(got) == brute(queries, rows, 6)


def test_hot_copies_and_zero_vectors(spark):
    """A third of all rows is one vector, some of it under one id; zero vectors and a query of zeros tie by id."""
    rng = np.random.default_rng(5)
    x = clustered(rng, 400, 8, 10, 0.1)
    rows = list(enumerate(x)) + [(1000 + i, x[0]) for i in range(200)] + [(5000, x[0])] * 50 + [(6000 + i, np.zeros(8)) for i in range(5)]
    queries = [(i, x[i]) for i in range(20)] + [(77, np.zeros(8)), (78, -x[0])]
    for piece in (32, 100_000):
        got = RT.knn_topk(frame(spark, "query_id", queries), frame(spark, "doc_id", rows), 9, max_broadcast_bytes=0, block_rows=piece)
        assert lists(got) == brute(queries, rows, 9)


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_odd_vectors_take_no_part(spark, limit):
    good = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.6, 0.8])]
    odd = [(4, None), (5, [1.0]), (6, [1.0, 2.0, 3.0]), (7, []), (8, [None, 9.0]), (9, [float("nan"), 1.0]), (10, [float("inf"), 1.0])]
    got = RT.knn_topk(frame(spark, "query_id", good + odd), frame(spark, "doc_id", good + odd), 2, max_broadcast_bytes=limit)
    assert lists(got) == brute(good, good, 2)
    for q, d in (([], good), (good, []), (odd[:1], good), (good, odd)):
        assert lists(RT.knn_topk(frame(spark, "query_id", q), frame(spark, "doc_id", d), 2, max_broadcast_bytes=limit)) == {}


def test_queries_visit_few_cells(spark):
    """On clustered vectors both rounds together visit a fraction of all (query, piece) pairs, and rows move once per round."""
    rng = np.random.default_rng(9)
    x = clustered(rng, 4000, 16, 40, 0.05)
    rows = frame(spark, "doc_id", list(enumerate(x))).selectExpr("doc_id", "embedding as v")
    queries = frame(spark, "query_id", [(i, x[i]) for i in range(0, 4000, 10)]).selectExpr("query_id", "embedding as v")
    index = PivotIndex(rows, 16, piece_rows=200)
    first = index.visits(queries, 5, False)
    top = RT._merge_topk(index.search(first, 5, RT._local_topk), 5).groupBy("query_id").agg({"sim": "min"}).toDF("query_id", "least")
    second = index.visits(queries.join(top, "query_id"), 5, True)
    assert first.count() + second.count() < 0.25 * 400 * index.pieces
    plan = index.search(first, 5, RT._local_topk)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_blocks_meet_where_visits_outnumber_rows(spark, monkeypatch):
    """Without clusters nearly every query would visit every cell: packed blocks meet instead, and no vector is written per visit."""
    from quarry.operators import pivots
    written = []
    monkeypatch.setattr(pivots, "_written", lambda df, name, f=pivots._written: (written.append(name), f(df, name))[1])
    rng = np.random.default_rng(3)
    x = rng.standard_normal((900, 24))
    x[::7] *= 1e20  # no single precision there; the others keep theirs
    rows = list(enumerate(x)) + [(2000 + i, x[4].astype(np.float32)) for i in range(60)] + [(3, x[5])]
    got = RT.knn_topk(frame(spark, "query_id", rows[:900]), frame(spark, "doc_id", rows), 4, max_broadcast_bytes=0, block_rows=100)
    assert lists(got) == brute(rows[:900], rows, 4)
    assert written == ["pivot-cells"]


@pytest.mark.parametrize("most", [0.0, 1e9])
def test_both_ways_return_the_same(spark, most):
    rng = np.random.default_rng(4)
    x = clustered(rng, 500, 8, 10, 0.1)
    q, d = (frame(spark, name, list(enumerate(x))).selectExpr(name, "embedding as v") for name in ("query_id", "doc_id"))
    merge = lambda c: RT._merge_topk(c, 5)
    got = merge(pivots_of(q, d, merge, most))
    assert lists(got) == brute(list(enumerate(x)), list(enumerate(x)), 5)


def pivots_of(q, d, merge, most):
    from quarry.operators.pivots import pivot_candidates
    return pivot_candidates(q, d, 5, 8, merge, RT._local_topk, 64, max_visits=most)


def test_placing_a_large_batch_takes_little_memory():
    """Angles to all pivots are held for a slice of an Arrow batch, and a batch's rows are placed as single rows are."""
    import tracemalloc

    import pyarrow as pa
    rng = np.random.default_rng(6)
    index = object.__new__(PivotIndex)
    index.dims, index.pivots = 8, clustered(rng, 1024, 8, 30, 0.3)
    x = rng.standard_normal((10_000, 8))
    b = pa.RecordBatch.from_arrays([pa.array(range(len(x))), pa.array(list(x))], names=["doc_id", "v"])
    tracemalloc.start()
    for _ in index._placer()(iter([b])):
        pass
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert peak < 60, peak
    cells = lambda parts: [c for o in index._placer()(iter(parts)) for c in o.column("cell").to_pylist()]
    assert cells([b]) == np.arccos(np.clip(x / np.linalg.norm(x, axis=1)[:, None] @ index.pivots.T, -1, 1)).argmin(axis=1).tolist()


def test_comparing_two_blocks_takes_little_memory():
    """Scores and their candidates are held for a chunk of both blocks, and chunks give what a whole comparison gives."""
    import tracemalloc

    rng = np.random.default_rng(7)
    q, d = rng.standard_normal((600, 16)), rng.standard_normal((4096, 16))
    d[3000:3200] = d[0]  # ties, in several chunks
    q[0] = d[0]
    ids = rng.permutation(10_000)[:4096]
    ids[4000:] = ids[3000:3096]  # copies of an id
    tracemalloc.start()
    s, i = RT._local_topk(q, ids, d, 5)
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert peak < 60, peak
    best = [{} for _ in q]
    for row, scores in zip(best, np.round(q @ d.T, 12)):
        for at, score in zip(ids.tolist(), scores.tolist()):
            row[at] = max(score, row.get(at, score))
    want = [sorted(row.items(), key=lambda x: (-x[1], x[0]))[:5] for row in best]
    assert i.tolist() == [[at for at, _ in row] for row in want]
    np.testing.assert_allclose(s, [[score for _, score in row] for row in want], atol=1e-11)


def test_ids_of_a_block_do_not_keep_its_batch():
    """A query block's ids outlive the Arrow batch (up to 64 MB) that they came in."""
    import pyarrow as pa
    from quarry.operators.blocks import _pack, _unpack
    b = pa.RecordBatch.from_arrays([pa.array([4, 9]), pa.array([[1.0, 2.0], [3.0, 0.5]])], names=["id", "v"])
    (packed,) = _pack(8, 2)(iter([b]))
    batch = packed.rename_columns(["q_at", "q_ids", "q_vs"])
    ids, x = _unpack(batch, 0, "q", 2)
    assert (ids.tolist(), x.tolist()) == ([4, 9], [[1.0, 2.0], [3.0, 0.5]])
    assert ids.flags.owndata and x.flags.owndata
