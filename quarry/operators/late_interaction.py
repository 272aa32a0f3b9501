"""Exact retrieval by late interaction (J4 as a search, W1): MaxSim top-k without scoring every document.

A document is a flat array of tokens, and its score is the sum, over the query's tokens, of the largest inner product with one of its
own.  Centroids are fitted on a bounded sample of tokens.  Every batch of documents gets posting lists by centroid: a document
stands once in the list of each centroid that is nearest to one of its tokens, with the distance of the farthest of these.  A query
token q meets no token there with more than ``q.c + |q| * distance``, which bounds a document's score from above.

A query reads, for each of its tokens, the lists in the order of their bounds.  Documents it has not met cannot score more than the sum
of the next lists' bounds; once that is below the k-th best score found, the reading ends, and of the documents met only those
whose own bound reaches that score are scored.  The result is exact whatever the centroids are; they only decide how much is read.

Lists are read query by query, which pays where scoring a batch for one query is much work (many or long tokens).  Where it is
little (``LIST_WORK``), queries are scored together: products of tokens in single precision, token by token of the
documents, give every score but for a known error, and only documents within that error of a query's k-th best are scored exactly.

The knowledge base is scanned once, never shuffled, and a task keeps k rows per query.  Queries go to the executors in blocks of a
checked size, with a scan for each block.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._check import require_columns
from .retrieve import MAX_BROADCAST_BYTES, _CAND_SCHEMA, _emit, _merge_topk, _topk_rows

MAX_CENTROIDS = 256
#: documents per centroid, and tokens of each, that the centroids are fitted on
SAMPLE_DOCS, SAMPLE_TOKENS = 8, 64
ROUNDS = 5
_CHUNK = 1 << 14
#: multiplications that score a batch for one query, from which lists are read
LIST_WORK = 1 << 27
#: queries' tokens and documents whose products are held at once
ASKED_TOKENS, DOCS = 512, 1024
_SLACK = 1e-9


def _nearest(tokens: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of every token, and its distance."""
    near = np.empty(len(tokens), np.int64)
    half = (centroids * centroids).sum(axis=1) / 2
    for t in range(0, len(tokens), _CHUNK):
        near[t:t + _CHUNK] = np.argmax(tokens[t:t + _CHUNK] @ centroids.T - half, axis=1)
    away = tokens - centroids[near]
    return near, np.sqrt((away * away).sum(axis=1))


def fit_centroids(tokens: np.ndarray, n: int) -> np.ndarray:
    """At most ``n`` centroids of sampled tokens."""
    tokens = np.unique(tokens, axis=0)
    centroids = tokens[np.linspace(0, len(tokens) - 1, min(n, len(tokens))).astype(int)]
    for _ in range(ROUNDS):
        near, _ = _nearest(tokens, centroids)
        size = np.bincount(near, minlength=len(centroids))
        total = np.zeros_like(centroids)
        np.add.at(total, near, tokens)
        centroids = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], centroids)
    return centroids


class TokenPostings:
    """Posting lists of a batch of documents; ``read`` and ``scored`` add up postings read and documents scored."""

    def __init__(self, ids: np.ndarray, vectors: list[np.ndarray], centroids: np.ndarray):
        dim = centroids.shape[1]
        self.ids, self.centroids, self.read, self.scored = ids, centroids, 0, 0
        sizes = np.array([len(v) // dim for v in vectors])
        self.first = np.concatenate([[0], np.cumsum(sizes)])
        self.tokens = np.concatenate(vectors).reshape(-1, dim)
        near, distance = _nearest(self.tokens, centroids)
        of = near * len(ids) + np.repeat(np.arange(len(ids)), sizes)
        order = np.argsort(of, kind="stable")
        posting, at = np.unique(of[order], return_index=True)
        self.radius = np.maximum.reduceat(distance[order], at)
        self.doc = posting % len(ids)
        self.start = np.searchsorted(posting // len(ids), np.arange(len(centroids) + 1))
        #: of every list, the largest distance; an empty list bounds nothing
        self.reach = np.array([self.radius[a:b].max() if b > a else -np.inf for a, b in zip(self.start, self.start[1:])])

    def scores(self, query: np.ndarray, docs: np.ndarray) -> np.ndarray:
        sizes = self.first[docs + 1] - self.first[docs]
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        rows = np.arange(sizes.sum()) + np.repeat(self.first[docs] - starts, sizes)
        self.scored += len(docs)
        # twelve decimals make equal tokens equal again, wherever they stand in a product
        return np.round(np.maximum.reduceat(np.round(query @ self.tokens[rows].T, 12), starts, axis=1).sum(axis=0), 12)

    def search(self, query: np.ndarray, best: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
        """``best`` (scores and ids, 1 x k) with the documents of this batch that belong there."""
        length = np.sqrt((query * query).sum(axis=1))
        dots = query @ self.centroids.T
        bounds = np.where(np.isfinite(self.reach), dots + length[:, None] * np.where(np.isfinite(self.reach), self.reach, 0.0), -np.inf)
        order = np.argsort(-bounds, axis=1, kind="stable")
        bounds = np.c_[np.take_along_axis(bounds, order, axis=1), np.full(len(query), -np.inf)]
        upper = np.full((len(query), len(self.ids)), -np.inf)
        open_ = np.ones(len(self.ids), bool)
        depth, step, lists = 0, 1, len(self.centroids)
        while True:
            end = min(depth + step, lists)
            for i in range(len(query)):
                for c in order[i, depth:end]:
                    a, b = self.start[c], self.start[c + 1]
                    docs = self.doc[a:b]
                    upper[i, docs] = np.maximum(upper[i, docs], dots[i, c] + length[i] * self.radius[a:b])
                    self.read += b - a
            depth, step = end, step * 2
            rest = bounds[:, depth]
            mine = np.maximum(upper, rest[:, None]).sum(axis=0)
            last = depth == lists or rest.sum() < self._floor(best)
            while True:
                todo = np.flatnonzero(open_ & (mine >= self._floor(best)) & (upper > -np.inf).any(axis=0))
                if not len(todo):
                    break
                todo = todo[np.argsort(-mine[todo], kind="stable")[:max(k, 64)]]
                open_[todo] = False
                best = _topk_rows(np.c_[best[0], self.scores(query, todo)[None, :]], np.c_[best[1], self.ids[todo][None, :]], k)
                if not last:
                    break  # a few scores raise the floor before more lists are read
            if last:
                return best
            if rest.sum() < self._floor(best):
                step = 0  # nothing unmet can enter: score what is left of those met

    @staticmethod
    def _floor(best) -> float:
        """The score that a document must reach; a tie may still win by its id."""
        return best[0][0, -1] - _SLACK * (1.0 + abs(best[0][0, -1])) if np.isfinite(best[0][0, -1]) else -np.inf


class DenseScores:
    """Documents of a batch scored for many queries at once; ``search`` is exact as ``TokenPostings.search`` is."""

    def __init__(self, ids: np.ndarray, vectors: list[np.ndarray], dim: int):
        self.ids, self.dim = ids, dim
        self.sizes = np.array([len(v) // dim for v in vectors])
        self.first = np.concatenate([[0], np.cumsum(self.sizes)])
        self.tokens = np.concatenate(vectors).reshape(-1, dim)
        #: copies of an id among the rows: of so many more rows the best must be looked at for k different ids
        self.copies = len(ids) - len(np.unique(ids))
        self.kind = np.float32 if not len(self.tokens) or np.abs(self.tokens).max() < 1e15 else np.float64
        self.longest = np.sqrt((self.tokens * self.tokens).sum(axis=1).max(initial=0.0))
        self.chunks = list(self._chunks())

    def _chunks(self):
        """Places of documents and their tokens, ``(token, document, dim)``; a document's last token is repeated up to the chunk's
        longest, which changes no maximum."""
        order = np.argsort(self.sizes, kind="stable")
        step = DOCS
        lo = 0
        while lo < len(order):
            docs = order[lo:lo + step]
            # a chunk's longest document has less than twice its shortest's tokens
            docs = docs[:np.searchsorted(self.sizes[docs], 2 * self.sizes[docs[0]], "left")] if self.sizes[docs[-1]] >= 2 * self.sizes[docs[0]] else docs
            lo += len(docs)
            at = np.minimum(np.arange(self.sizes[docs].max())[:, None], self.sizes[docs] - 1) + self.first[docs]
            yield docs, at

    def search(self, asked: list[np.ndarray], best: tuple[np.ndarray, np.ndarray], k: int) -> None:
        """Puts into ``best`` (scores and ids, queries x k) the documents of this batch that belong there."""
        sizes = np.array([len(a) for a in asked])
        lo = 0
        while lo < len(asked):
            hi = max(lo + 1, int(np.searchsorted(np.cumsum(sizes[lo:]), ASKED_TOKENS, "right")) + lo)
            self._search(np.concatenate(asked[lo:hi]), sizes[lo:hi], (best[0][lo:hi], best[1][lo:hi]), k)
            lo = hi

    def _search(self, query: np.ndarray, sizes: np.ndarray, best: tuple[np.ndarray, np.ndarray], k: int) -> None:
        starts = np.cumsum(sizes) - sizes
        length = np.sqrt((query * query).sum(axis=1))
        kind = self.kind if np.abs(query).max(initial=0.0) < 1e15 else np.float64
        eps = np.finfo(kind).eps
        # rounding of the numbers, of a product's sum and of the sum over the tokens; what is below the smallest number
        error = (2 * self.dim + sizes + 8) * eps * np.add.reduceat(length, starts) * self.longest
        error += 1e-36 * self.dim * sizes * (1.0 + length.max(initial=0.0) + self.longest) + 1e-11 * sizes
        q = query.astype(kind)
        for docs, at in self.chunks:
            top = None
            for row in at:
                dots = q @ self.tokens[row].astype(kind).T
                top = dots if top is None else np.maximum(top, dots, out=top)
            found = np.add.reduceat(top, starts, axis=0)
            floor = best[0][:, -1]
            m = k + self.copies
            if m < len(docs):
                new = np.flatnonzero(np.count_nonzero(found >= (floor - error)[:, None], axis=1) > 2 * m)
                if len(new):
                    floor = floor.copy()
                    floor[new] = np.maximum(floor[new], np.partition(found[new], -m, axis=1)[:, -m] - error[new])
            hit = found >= (floor - error - _SLACK * (1 + np.abs(np.where(np.isfinite(floor), floor, 0.0))))[:, None]
            n = np.count_nonzero(hit, axis=1)
            rows = np.flatnonzero(n)
            if not len(rows):
                continue
            n = n[rows]
            r, col = np.nonzero(hit[rows])
            place = np.arange(len(r)) - np.repeat(np.cumsum(n) - n, n)
            new_s = np.full((len(rows), n.max()), -np.inf)
            new_i = np.full(new_s.shape, np.iinfo("int64").max, dtype="int64")
            new_s[r, place], new_i[r, place] = self._exact(query, starts[rows[r]], sizes[rows[r]], docs[col]), self.ids[docs[col]]
            best[0][rows], best[1][rows] = _topk_rows(np.c_[best[0][rows], new_s], np.c_[best[1][rows], new_i], k)

    def _exact(self, query: np.ndarray, start: np.ndarray, size: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Scores of (query, document) pairs, in groups of as many tokens."""
        out = np.empty(len(docs))
        shape = np.stack([size, self.sizes[docs]])
        kinds, of = np.unique(shape, axis=1, return_inverse=True)
        for g, (a, b) in enumerate(kinds.T.tolist()):
            mine = np.flatnonzero(of.ravel() == g)
            step = max(1, (1 << 20) // max(a * b, (a + b) * self.dim))
            for lo in range(0, len(mine), step):
                pair = mine[lo:lo + step]
                x = query[start[pair][:, None] + np.arange(a)]
                y = self.tokens[self.first[docs[pair]][:, None] + np.arange(b)]
                # twelve decimals make equal tokens equal again, wherever they stand in a product
                out[pair] = np.round(np.round(x @ y.transpose(0, 2, 1), 12).max(axis=2).sum(axis=1), 12)
        return out


def _tokens(df: DataFrame, id_col: str, name: str, vector: str, dim: int) -> DataFrame:
    v = F.col("v")
    ok = (F.size(v) > 0) & (F.size(v) % dim == 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (df.select(F.col(id_col).cast("long").alias(name), F.col(vector).alias("v"))
            .where(F.col(name).isNotNull() & F.coalesce(ok, F.lit(False))).withColumn("v", F.transform(v, lambda x: x.cast("double"))))


def maxsim_topk(queries: DataFrame, kb: DataFrame, k: int, token_dim: int, query_id: str = "query_id", doc_id: str = "doc_id",
                vector: str = "embedding", max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
                max_centroids: int = MAX_CENTROIDS, list_work: int = LIST_WORK) -> DataFrame:
    """``(query_id, doc_id, maxsim, rank)``: the k documents of highest MaxSim per query, ties (equal to 12 decimals) to the smaller id.

    Vectors are flat arrays of ``token_dim``-sized tokens, as many as a text has.  Rows with a NULL id, or a vector that is NULL,
    empty, no whole number of tokens or not finite throughout, take no part, on either side.  Copies of a document id count once, at
    their best score.  Query ids are unique.
    """
    require_columns(queries, query_id, vector)
    require_columns(kb, doc_id, vector)
    if k < 1:
        raise ValueError("k must be >= 1")
    spark = kb.sparkSession
    q, d = _tokens(queries, query_id, "query_id", vector, token_dim), _tokens(kb, doc_id, "doc_id", vector, token_dim)
    n, size = d.count(), q.agg(F.sum(F.size("v") * 8)).first()[0] or 0
    n_centroids = max(1, min(max_centroids, math.isqrt(n)))
    some = d.select(F.slice("v", 1, SAMPLE_TOKENS * token_dim).alias("v")).orderBy(F.xxhash64("v")).limit(SAMPLE_DOCS * n_centroids).collect()
    found = spark.createDataFrame([], _CAND_SCHEMA)
    if some and size:
        centroids = fit_centroids(np.concatenate([np.asarray(r["v"]) for r in some]).reshape(-1, token_dim), n_centroids)
        blocks = -(-size // max_broadcast_bytes)
        for b in range(blocks):
            found = found.unionAll(_scan(q.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b), d, k, centroids, list_work))
    return _merge_topk(found, k).withColumnRenamed("sim", "maxsim").checkpoint(eager=True)


def _scan(q: DataFrame, d: DataFrame, k: int, centroids: np.ndarray, list_work: int) -> DataFrame:
    local = q.toPandas()  # a block of checked size
    dim = centroids.shape[1]
    shipped = q.sparkSession.sparkContext.broadcast(
        (local["query_id"].to_numpy("int64"), [np.asarray(v, dtype="float64").reshape(-1, dim) for v in local["v"]], centroids))

    def scan(batches):
        ids, asked, middle = shipped.value
        best = np.full((len(ids), k), -np.inf), np.full((len(ids), k), np.iinfo("int64").max, dtype="int64")
        mean = sum(map(len, asked)) / max(1, len(asked))
        for pdf in batches:
            if not len(pdf) or not len(ids):
                continue
            docs, vectors = pdf["doc_id"].to_numpy("int64"), [np.asarray(v, dtype="float64") for v in pdf["v"]]
            if mean * sum(map(len, vectors)) < list_work:
                DenseScores(docs, vectors, dim).search(asked, best, k)
                continue
            lists = TokenPostings(docs, vectors, middle)
            for i, a in enumerate(asked):
                best[0][i:i + 1], best[1][i:i + 1] = lists.search(a, (best[0][i:i + 1], best[1][i:i + 1]), k)
        yield _emit(ids, best if len(ids) else None)

    return d.mapInPandas(scan, _CAND_SCHEMA)
