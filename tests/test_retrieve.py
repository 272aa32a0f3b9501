"""Vector top-k, re-ranking and RAG assembly against brute force on the embeddings table."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from paths import SF01
from plan_util import plan_text
from quarry.operators import retrieve as RT
from quarry.plans import fixtures as fx


@pytest.fixture(scope="module")
def q_kb(spark):
    return fx.retrieval_queries(spark, SF01), fx.knowledge_base(spark, SF01)


def _brute(q, kb, k):
    Q = {r.query_id: np.asarray(r.embedding, dtype="float64") for r in q.collect()}
    D = [(r.doc_id, np.asarray(r.embedding, dtype="float64")) for r in kb.collect()]
    out = {}
    for qid, qv in Q.items():
        sims = sorted(((-float(qv @ dv), did) for did, dv in D))[:k]
        out[qid] = [did for _, did in sims]
    return out


def _as_lists(res):
    got = {}
    for r in res.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.doc_id)
    return got


def test_knn_broadcast_equals_brute_force(q_kb):
    q, kb = q_kb
    assert _as_lists(RT.knn_topk(q, kb, 5)) == _brute(q, kb, 5)


def test_knn_blocked_path_equals_broadcast(q_kb):
    q, kb = q_kb
    a = _as_lists(RT.knn_topk(q, kb, 7))
    # several query blocks and several KB blocks
    for rows in (64, 4):
        b = _as_lists(RT.knn_topk(q, kb, 7, max_broadcast_bytes=0, block_rows=rows))
        assert a == b


def test_knn_kb_copies_do_not_repeat_a_document(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<float>")
    rows = [(7, [1.0, 0.0])] * 5 + [(8, [0.9, 0.1]), (9, [0.0, 1.0])]
    for parts in (1, 2, 3):
        kb = spark.createDataFrame(rows, "doc_id long, embedding array<float>").repartition(parts)
        assert _as_lists(RT.knn_topk(q, kb, 2)) == {1: [7, 8]}


def test_topk_rows_exact_with_copies():
    rng = np.random.default_rng(1)
    for trial in range(50):
        width, k = int(rng.integers(1, 150)), int(rng.integers(1, 25))
        ids = rng.integers(0, 40, size=width)           # many copies of each id
        score = {d: float(rng.integers(0, 6)) for d in range(40)}  # a copy has its document's score
        cat_s = np.array([[score[d] for d in ids]] * 3)
        cat_i = np.array([ids] * 3).astype("int64")
        got_s, got_i = RT._topk_rows(cat_s, cat_i, k)
        exp = sorted({(-score[d], d) for d in ids})[:k]
        for r in range(3):
            got = [(-a, b) for a, b in zip(got_s[r], got_i[r]) if np.isfinite(a)]
            assert got == exp


def test_knn_ties_broken_by_doc_id(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<float>")
    kb = spark.createDataFrame([(5, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [0.0, 1.0])], "doc_id long, embedding array<float>")
    assert _as_lists(RT.knn_topk(q, kb, 2)) == {1: [3, 5]}


def test_knn_plan_does_not_shuffle_kb_rows(q_kb):
    q, kb = q_kb
    plan = plan_text(RT.knn_topk(q, kb, 5, materialize=False))
    assert "MapInPandas" in plan and "CartesianProduct" not in plan
    lines = plan.splitlines()
    scan = max(i for i, ln in enumerate(lines) if "FileScan parquet" in ln)
    mip = max(i for i, ln in enumerate(lines) if "MapInPandas" in ln)
    # KB rows go straight from the scan into the scoring (no exchange in between); the exchanges
    # above only moves candidate rows (<= partitions x queries x k) by query, once for the (query, doc) dedupe and the merge
    assert plan.count("Exchange hashpartitioning") == 1


def _ancestors(lines, i):
    """Plan lines above line i with strictly smaller indentation (its ancestor chain, nearest first)."""
    depth = lambda ln: len(ln) - len(ln.lstrip(" :+-"))
    out, d = [], depth(lines[i])
    for ln in reversed(lines[:i]):
        if ln.strip() and depth(ln) < d:
            out.append(ln)
            d = depth(ln)
    return out


def test_rerank_lookups_stream_the_kb(q_kb):
    q, kb = q_kb
    rr = RT.rerank(RT.knn_topk(q, kb, 4), q, kb, 2, token_dim=8)
    lines = plan_text(rr).split("== Physical Plan ==")[-1].splitlines()
    scans = [i for i, ln in enumerate(lines) if "FileScan parquet" in ln and "embedding" in ln]
    assert len(scans) == 2
    for i in scans:
        chain = _ancestors(lines, i)
        join_at = next(k for k, ln in enumerate(chain) if "Join" in ln)
        # the KB / query scan feeds a broadcast hash join directly: no exchange on the way
        assert "BroadcastHashJoin" in chain[join_at]
        assert not any("Exchange" in ln for ln in chain[:join_at])


def test_maxsim_matches_numpy(spark, q_kb):
    q, kb = q_kb
    cand = RT.knn_topk(q, kb, 4)
    rr = RT.rerank(cand, q, kb, 2, token_dim=8)
    Q = {r.query_id: np.asarray(r.embedding, dtype="float64").reshape(8, 8) for r in q.collect()}
    D = {r.doc_id: np.asarray(r.embedding, dtype="float64").reshape(8, 8) for r in kb.collect()}
    for r in rr.collect():
        expect = (Q[r.query_id] @ D[r.doc_id].T).max(axis=1).sum()
        assert r.maxsim == pytest.approx(expect, abs=1e-9)
    assert {r.c for r in rr.groupBy("query_id").agg(F.count("*").alias("c")).collect()} == {2}


def test_rag_messages_order(spark):
    qm = spark.createDataFrame([(1, [("user", "q")])], "query_id long, messages array<struct<role:string,content:string>>")
    retrieved = spark.createDataFrame([(1, 10, 2), (1, 11, 1)], "query_id long, doc_id long, rank int")
    payload = spark.createDataFrame([(10, "second", "c2"), (11, "first", "c1")],
                                    "doc_id long, page_content string, code string")
    out = RT.rag_messages(qm, retrieved, payload, "rank", F.lit("P")).first().messages
    assert [m.role for m in out] == ["user", "assistant", "user", "assistant", "user"]
    assert "first" in out[0].content and "second" in out[2].content and out[4].content == "q"


def test_maxsim_empty_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [])], "q array<float>, d array<float>")
    assert df.select(RT.maxsim(F.col("q"), F.col("d"), 2).alias("s")).first().s == 0.0


def test_topk_rows_exact_with_ties():
    rng = np.random.default_rng(0)
    for trial in range(50):
        width, k = int(rng.integers(1, 120)), int(rng.integers(1, 30))
        # few distinct values -> many ties across the preselection boundary
        cat_s = rng.integers(0, 4, size=(7, width)).astype(float)
        cat_i = np.stack([rng.permutation(width) for _ in range(7)]).astype("int64")
        k = min(k, width)
        got_s, got_i = RT._topk_rows(cat_s, cat_i, k)
        for r in range(7):
            exp = sorted(zip(-cat_s[r], cat_i[r]))[:k]
            assert list(zip(-got_s[r], got_i[r])) == exp


def test_topk_rows_copies_a_rounding_step_apart():
    # the same document scored in two batches may differ by one ulp
    s0 = 0.7
    cat_s = np.array([[s0, np.nextafter(s0, 1.0), 0.69, 0.1]])
    cat_i = np.array([[7, 7, 8, 9]], dtype="int64")
    got_s, got_i = RT._topk_rows(cat_s, cat_i, 2)
    assert list(got_i[0]) == [7, 8]


def test_n_final_above_n_retrieve_gives_fewer_docs(q_kb):
    # Asking for more final documents than were retrieved keeps what there is, no error
    q, kb = q_kb
    rr = RT.rerank(RT.knn_topk(q, kb, 2), q, kb, 5, token_dim=8)
    assert {r.c for r in rr.groupBy("query_id").agg(F.count("*").alias("c")).collect()} == {2}


def test_knn_with_no_queries_is_empty(q_kb):
    q, kb = q_kb
    assert RT.knn_topk(q.where("query_id < 0"), kb, 3).count() == 0
