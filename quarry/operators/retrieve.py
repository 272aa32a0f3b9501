"""Vector retrieval and retrieval-augmented prompts.

J2 — exact top-k by inner product on unit vectors (= cosine), ties (scores equal to 12 decimals) broken by ``doc_id``.  Two
physical strategies, chosen by a size check on the query side:

* **broadcast** (query matrix, rows x dims x 8 bytes, <= ``max_broadcast_bytes``): the matrix —
  bounded by that check — is shipped once to every executor; each knowledge-base partition is
  scanned with ``mapInPandas`` (Arrow batches, numpy matmul) keeping a running top-k per query
  (copies of a document count once), so a partition emits at most ``queries x k`` rows and the KB
  itself is never shuffled.
* **pivots** (larger query sides): rows lie in cells around sampled pivots, and a query visits only the cells that can still hold
  one of its k best rows (``pivots.py``).  Cells are split by row, so no group is large, and no pairs are ever rows.  Where visits
  would outnumber the rows, packed blocks of both sides meet instead (``blocks.py``).

Vectors that are NULL, hold a NULL or non-finite component or have another length than most queries take no part, on either side.

Both end in the same merge: one exchange by query, then one row per (query, doc) and a per-query ``row_number`` without another.
The merged top-k (at most queries x k rows) is
checkpointed into the shared checkpoint folder: the expensive KB scan runs once, later uses
(re-ranking, payload lookups, counts) read the small materialised result, and a lost executor never
forces the scan to be replayed.

Lookups of vectors and payloads for retrieved rows never shuffle the knowledge base: the retrieved
ids (bounded by queries x k, counted on the checkpointed candidates) are broadcast and the KB is
streamed through a broadcast hash join; above the bound they fall back to a shuffle join.  A lookup
returns one row per id, so copies of an id never multiply rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import concat_messages
from .fewshot import ordered_turns
from .pivots import pivot_candidates
from .prompt import resolve_prefix, templated_turns
from ._check import require_columns

_CAND_SCHEMA = "query_id long, doc_id long, sim double"
#: of a first chunk every score is a candidate, at some 90 bytes each
_QUERY_CHUNK, _KB_CHUNK = 256, 1024


def _first_k_unique(s: np.ndarray, i: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows sorted by (sim desc, id asc): keep each id's first (best) occurrence — copies of a
    document may score a rounding step apart when they were scored in different batches — then the
    first k; returns (sims, ids, unique count) padded with -inf / max int."""
    by_id = np.argsort(i, axis=1, kind="stable")  # stable: per id, its best position first
    ids = np.take_along_axis(i, by_id, axis=1)
    dup_by_id = np.zeros(i.shape, dtype=bool)
    dup_by_id[:, 1:] = ids[:, 1:] == ids[:, :-1]
    dup = np.empty_like(dup_by_id)
    np.put_along_axis(dup, by_id, dup_by_id, axis=1)
    order = np.argsort(dup, axis=1, kind="stable")[:, :k]
    out_s, out_i = np.take_along_axis(s, order, axis=1), np.take_along_axis(i, order, axis=1)
    n_unique = (~dup).sum(axis=1)
    pad = np.arange(out_s.shape[1])[None, :] >= n_unique[:, None]
    out_s[pad], out_i[pad] = -np.inf, np.iinfo("int64").max
    return out_s, out_i, n_unique


def _topk_rows(cat_s: np.ndarray, cat_i: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row, the k best distinct (sim desc, id asc) entries of (cat_s, cat_i).

    ``argpartition`` preselects the k + slack largest values in O(width); the preselection is exact
    unless an entry outside it could still enter the top k — a value tied with the k-th one (an id
    tie-break could prefer it) or copies of one id crowding the preselection — and only such rows
    are fully sorted.  Copies of an id (the same document stored twice) count once, at their best
    score.
    """
    width = cat_s.shape[1]
    m = min(width, k + 16)
    if m < width:
        pre = np.argpartition(-cat_s, m - 1, axis=1)[:, :m]
        sub_s, sub_i = np.take_along_axis(cat_s, pre, axis=1), np.take_along_axis(cat_i, pre, axis=1)
    else:
        sub_s, sub_i = cat_s, cat_i
    order = np.lexsort((sub_i, -sub_s), axis=1)
    top_s, top_i, n_unique = _first_k_unique(np.take_along_axis(sub_s, order, axis=1),
                                             np.take_along_axis(sub_i, order, axis=1), k)
    if m < width:
        kth = top_s[:, -1:]
        unsafe = (n_unique < k) | ((cat_s >= kth).sum(axis=1) > (sub_s >= kth).sum(axis=1))
        if unsafe.any():
            rows = np.nonzero(unsafe)[0]
            full = np.lexsort((cat_i[rows], -cat_s[rows]), axis=1)
            fs, fi, _ = _first_k_unique(np.take_along_axis(cat_s[rows], full, axis=1),
                                        np.take_along_axis(cat_i[rows], full, axis=1), k)
            top_s[rows], top_i[rows] = fs, fi
    return top_s, top_i


def _local_topk(q_mat: np.ndarray, d_ids: np.ndarray, d_mat: np.ndarray, k: int,
                best: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Merge the top-k (sim desc, doc_id asc) of q x d into the running ``best`` (sims, ids),
    both shaped (queries, k); empty slots hold -inf / max int.  Both sides are processed in chunks, so the
    similarity block stays ``_QUERY_CHUNK x _KB_CHUNK`` doubles (2 MB; some 22 MB with its candidates), whatever the batch or block."""
    n = q_mat.shape[0]
    if best is None:
        best = (np.full((n, k), -np.inf), np.full((n, k), np.iinfo("int64").max, dtype="int64"))
    b_s, b_i = best
    for t in range(0, len(d_ids), _KB_CHUNK):
        ids, mat = d_ids[t:t + _KB_CHUNK], d_mat[t:t + _KB_CHUNK]
        for s in range(0, n, _QUERY_CHUNK):
            sims = q_mat[s:s + _QUERY_CHUNK] @ mat.T
            floor = b_s[s:s + len(sims), -1]
            # most rows of a later chunk are below a query's k-th best: only the others are sorted
            least = floor - np.where(np.isfinite(floor), 1e-12 + 1e-14 * np.abs(floor), 0.0)
            hit = sims >= least[:, None]
            n_hit = np.count_nonzero(hit, axis=1)
            rows = np.flatnonzero(n_hit)
            if not len(rows):
                continue
            n_hit = n_hit[rows]
            r, col = np.nonzero(hit[rows])
            place = np.arange(len(r)) - np.repeat(np.cumsum(n_hit) - n_hit, n_hit)
            new_s = np.full((len(rows), n_hit.max()), -np.inf)
            new_i = np.full(new_s.shape, np.iinfo("int64").max, dtype="int64")
            # a matrix product may score equal vectors a rounding step apart; 12 decimals make them ties again
            new_s[r, place], new_i[r, place] = np.round(sims[rows[r], col], 12), ids[col]
            rows += s
            b_s[rows], b_i[rows] = _topk_rows(np.concatenate([b_s[rows], new_s], axis=1), np.concatenate([b_i[rows], new_i], axis=1), k)
    return b_s, b_i


def _emit(q_ids: np.ndarray, best) -> pd.DataFrame:
    if best is None:
        return pd.DataFrame({"query_id": pd.Series([], dtype="int64"), "doc_id": pd.Series([], dtype="int64"),
                             "sim": pd.Series([], dtype="float64")})
    b_s, b_i = best
    keep = np.isfinite(b_s)
    rows = np.nonzero(keep)
    return pd.DataFrame({"query_id": q_ids[rows[0]].astype("int64"), "doc_id": b_i[keep].astype("int64"),
                         "sim": b_s[keep].astype("float64")})


def _matrix(series: pd.Series) -> np.ndarray:
    if len(series) == 0:
        return np.zeros((0, 0))
    return np.stack([np.asarray(v, dtype="float64") for v in series])


def _merge_topk(cand: DataFrame, k: int, rank_col: str = "rank") -> DataFrame:
    """Global top-k per query; ties by doc_id; at most one row per (query, doc).  Candidates are dealt by query once, which
    serves the de-duplication and the window."""
    one = cand.repartition("query_id").groupBy("query_id", "doc_id").agg(F.max("sim").alias("sim"))
    w = Window.partitionBy("query_id").orderBy(F.desc("sim"), F.asc("doc_id"))
    return one.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k)


def _usable(df: DataFrame, dims: int) -> DataFrame:
    """Rows whose vector ``v`` holds ``dims`` finite numbers, as doubles."""
    v = F.col("v")
    ok = (F.size(v) == dims) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.where(F.coalesce(ok, F.lit(False))).withColumn("v", F.transform(v, lambda x: x.cast("double")))


MAX_BROADCAST_BYTES = 256 * 1024 * 1024
MAX_BROADCAST_ROWS = 2_000_000


def knn_topk(queries: DataFrame, kb: DataFrame, k: int, query_id: str = "query_id", doc_id: str = "doc_id",
             vector: str = "embedding", max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
             block_rows: int = 50_000, materialize: bool = True) -> DataFrame:
    """J2 + W1 + L4: ``(query_id, doc_id, sim, rank)`` for the k most similar KB rows per query.

    The query side is broadcast only when its float64 matrix (rows x dims x 8 bytes, measured by
    one aggregate) fits ``max_broadcast_bytes``; otherwise the pivot path runs, in pieces of at most about ``block_rows`` rows.
    Ids are not NULL; unusable vectors (see the module) take no part: such a query gets no rows.
    """
    require_columns(queries, query_id, vector)
    require_columns(kb, doc_id, vector)
    if k < 1:
        raise ValueError("k must be >= 1")
    q = queries.select(F.col(query_id).cast("long").alias("query_id"), F.col(vector).alias("v"))
    d = kb.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(vector).alias("v"))
    sizes = q.where(F.col("v").isNotNull()).groupBy(F.size("v").alias("dims")).agg(F.count(F.lit(1)).alias("n"))
    most = sizes.orderBy(F.desc("n"), "dims").first()
    n_q, dims = (int(most["n"]), int(most["dims"])) if most else (0, 0)
    q, d = _usable(q, dims), _usable(d, dims)
    if not dims:
        cand = d.limit(0).select(F.col("doc_id").alias("query_id"), "doc_id", F.lit(0.0).alias("sim"))
    elif n_q * dims * 8 <= max_broadcast_bytes:
        cand = _broadcast_candidates(q, d, k)
    else:
        cand = pivot_candidates(q, d, k, dims, lambda c: _merge_topk(c, k), _local_topk, block_rows)
    top = _merge_topk(cand, k)
    return top.checkpoint(eager=True) if materialize else top


def _fetch(big: DataFrame, keys: DataFrame, key: str, key_rows: int,
           max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """One row of ``big`` per key present in ``keys`` (a single column of ids).

    ``keys`` — narrow ids with a known row bound — is broadcast when the bound allows, so ``big`` is
    streamed through a broadcast hash join, never shuffled.  Copies of a key in ``big`` collapse in
    a map-side-combined ``groupBy(key)``, so later joins on the key are one-to-one and never emit
    pairs inside a key group.
    """
    ids = F.broadcast(keys) if key_rows <= max_rows else keys
    matched = big.join(ids, key)
    return matched.groupBy(key).agg(*[F.first(c).alias(c) for c in big.columns if c != key])


def _broadcast_candidates(q: DataFrame, d: DataFrame, k: int) -> DataFrame:
    spark = q.sparkSession
    local = q.toPandas()  # its matrix is within max_broadcast_bytes (checked by the caller)
    shipped = spark.sparkContext.broadcast((local["query_id"].to_numpy("int64"), _matrix(local["v"])))

    def scan(batches):
        q_ids, q_mat = shipped.value
        best = None
        for pdf in batches:
            if len(pdf) and len(q_ids):
                best = _local_topk(q_mat, pdf["doc_id"].to_numpy("int64"), _matrix(pdf["v"]), k, best)
        yield _emit(q_ids, best)

    return d.mapInPandas(scan, _CAND_SCHEMA)


# J4 / W2 --------------------------------------------------------------------------------------
def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0),
                       lambda acc, x: acc + x)


def maxsim(q_vec: Column, d_vec: Column, token_dim: int) -> Column:
    """Late-interaction score: sum over query tokens of the max over doc tokens of their dot product.

    Vectors are flat arrays of ``token_dim``-sized tokens.
    """
    nq = (F.size(q_vec) / token_dim).cast("int")
    nd = (F.size(d_vec) / token_dim).cast("int")

    def tokens(n):  # 0..n-1; empty for n < 1 (sequence(0, -1) would count down)
        return F.when(n >= 1, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    def tok(v, i):
        return F.slice(v, i * token_dim + 1, F.lit(token_dim))

    return F.aggregate(
        tokens(nq), F.lit(0.0),
        lambda acc, i: acc + F.coalesce(F.array_max(F.transform(tokens(nd),
                                                                lambda j: _dot(tok(q_vec, i), tok(d_vec, j)))),
                                        F.lit(0.0)))


def rerank(candidates: DataFrame, queries: DataFrame, kb: DataFrame, n_final: int, token_dim: int,
           vector: str = "embedding", retrieval_rank: str = "rank") -> DataFrame:
    """J4 + W2: re-score retrieved candidates by MaxSim and keep the best ``n_final``.

    Ties keep retrieval order.  Only the candidates' ids (8 bytes each; at most queries x
    n_retrieve of them, counted on the checkpointed candidates) are broadcast into the KB and query
    scans, which stream through broadcast hash joins; the fetched vectors (as many rows as
    candidates) are then attached to the candidates by ordinary equi-joins.
    """
    n_c = candidates.count()
    doc_ids = candidates.select("doc_id").distinct()
    query_ids = candidates.select("query_id").distinct()
    dv = _fetch(kb.select(F.col("doc_id"), F.col(vector).alias("_dv")), doc_ids, "doc_id", n_c)
    qv = _fetch(queries.select(F.col("query_id"), F.col(vector).alias("_qv")), query_ids, "query_id", n_c)
    c = candidates.join(dv, "doc_id").join(qv, "query_id")
    scored = c.withColumn("maxsim", maxsim(F.col("_qv"), F.col("_dv"), token_dim)).drop("_qv", "_dv")
    w = Window.partitionBy("query_id").orderBy(F.desc("maxsim"), F.asc(retrieval_rank))
    return (scored.withColumn("final_rank", F.row_number().over(w))
            .where(F.col("final_rank") <= n_final))


# J5 / T6 --------------------------------------------------------------------------------------
def rag_messages(query_messages: DataFrame, retrieved: DataFrame, payload: DataFrame, rank_col: str,
                 prefix, page_content: str = "page_content", code: str = "code",
                 messages_col: str = "messages", retrieved_rows: int | None = None) -> DataFrame:
    """Retrieved (query_id, doc_id, rank) -> templated (page_content, code) turns in rank order,
    followed by the query's own messages.

    J5 fetches one payload row per retrieved ``doc_id``: with a known bound on the retrieved rows
    (``retrieved_rows``) the ids are broadcast and the payload streamed; without one, a shuffle
    join.  The per-query aggregate holds at most n_final entries (bounded group).
    """
    require_columns(payload, "doc_id", page_content, code)
    r = retrieved.select("query_id", "doc_id", F.col(rank_col).alias("_rk"))
    pl = payload.select("doc_id", page_content, code)
    bound = retrieved_rows if retrieved_rows is not None else MAX_BROADCAST_ROWS + 1
    ctx = r.join(_fetch(pl, r.select("doc_id").distinct(), "doc_id", bound), "doc_id")
    ctx = ctx.select("query_id", "_rk", templated_turns(F.col(page_content), F.col(code),
                                                        resolve_prefix(prefix)).alias("_t"))
    per_q = ctx.groupBy("query_id").agg(ordered_turns(ctx, "_rk", "_t").alias("_ctx"))
    out = query_messages.join(per_q, "query_id", "left")
    return out.withColumn(messages_col, concat_messages("_ctx", messages_col)).drop("_ctx")
