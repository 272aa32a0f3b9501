"""Approximate largest-inner-product neighbours by collision-counting hashing.

Vectors are mapped to unit vectors in one more dimension (divided by the largest norm, the last component filling up to
length 1; queries get 0 there), so that the nearest are those of largest inner product.  Each of ``PROJECTIONS`` random
projections keeps the rows of a block as a sorted array.  A query opens a window around its own projection in every
array; virtual rehashing widens the windows level by level without new hashing, and only the entries that a wider window adds are
counted.  A row that has fallen into ``THRESHOLD`` of the windows is verified on its original vector; the search ends when ``VERIFY``
of the block and at least ``MIN_VERIFY`` rows have got there.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cells import first_ids, search, valid_vectors
from .common import materialise

PROJECTIONS = 64
THRESHOLD = 0.75
VERIFY, MIN_VERIFY = 0.1, 400
#: first half-width in standard deviations of the projections, and its growth from level to level
FIRST_WIDTH, WIDEN = 0.9, 1.08
LEVELS = 64
#: queries whose collision counts (a byte per row of the block) are held at a time
COUNT_QUERIES = 128


class CollisionIndex:
    """Sorted projections of the rows of one block.

    ``counted`` and ``verified`` add up the window entries read and the rows whose vectors were compared: the work of a search.
    A block of at most ``MIN_VERIFY`` rows is verified whole, and below some thousand rows that minimum makes the search cost more than
    comparing every row; from 5,000 rows on it reads and compares less (tested).
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, norm: float, seed: int = 3):
        self.ids, self.vectors = ids, vectors
        self.counted = self.verified = 0
        x = vectors / norm
        x = np.c_[x, np.sqrt(np.maximum(0.0, 1.0 - (x * x).sum(axis=1)))]
        # orthogonal directions, as many sets of them as needed
        rng, dims, need = np.random.default_rng(seed), x.shape[1], PROJECTIONS
        sets = [np.linalg.qr(rng.standard_normal((dims, dims)))[0] for _ in range(-(-need // dims))]
        self.axes = np.concatenate(sets, axis=1)[:, :need]
        p = (x @ self.axes).T
        self.rows = np.argsort(p, axis=1, kind="stable")  # of every sorted array, the rows in its order
        self.sorted = np.take_along_axis(p, self.rows, axis=1)
        self.width = float(np.std(p)) * FIRST_WIDTH or 1e-9

    def _windows(self, at: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray]:
        """Start and end, in every sorted array, of the windows around the projections ``at`` (queries x arrays)."""
        lo = np.stack([s.searchsorted(a - width) for s, a in zip(self.sorted, at.T)], axis=1)
        hi = np.stack([s.searchsorted(a + width, "right") for s, a in zip(self.sorted, at.T)], axis=1)
        return lo, hi

    def _entered(self, lo, hi, old_lo, old_hi) -> np.ndarray:
        """Collisions per row that a query's wider windows add to those of the narrower ones inside them."""
        new = [r[a:b] for r, a, b in zip(self.rows, lo, old_lo)] + [r[a:b] for r, a, b in zip(self.rows, old_hi, hi)]
        new = np.concatenate(new)
        self.counted += len(new)
        return np.bincount(new, minlength=len(self.ids)).astype(np.uint8)

    def candidates(self, queries: np.ndarray):
        """For every query (by its number) the rows that collide with it in enough windows.  Windows grow out of the query's own place
        in every array; a level reads only the entries that its wider windows add.  Queries are yielded as they end."""
        n = len(self.ids)
        want, need = min(n, max(MIN_VERIFY, int(VERIFY * n))), int(THRESHOLD * PROJECTIONS)
        if want == n:
            yield from ((q, np.arange(n)) for q in range(len(queries)))
            return
        unit = queries / np.sqrt((queries * queries).sum(axis=1, keepdims=True))
        at = np.c_[unit, np.zeros(len(unit))] @ self.axes
        for first in range(0, len(queries), COUNT_QUERIES):
            open_, width = np.arange(first, min(first + COUNT_QUERIES, len(queries))), self.width
            counts = np.zeros((len(open_), n), np.uint8)  # at most PROJECTIONS collisions each
            old_lo, _ = self._windows(at[open_], 0.0)
            old_hi = old_lo  # empty at first
            for level in range(LEVELS):
                lo, hi = self._windows(at[open_], width)
                wait = np.ones(len(open_), bool)
                for i, q in enumerate(open_.tolist()):
                    mine = counts[q - first]
                    mine += self._entered(lo[i], hi[i], old_lo[i], old_hi[i])
                    found = np.flatnonzero(mine >= need)
                    if len(found) >= want or level == LEVELS - 1:
                        wait[i] = False
                        yield q, found
                open_, old_lo, old_hi, width = open_[wait], lo[wait], hi[wait], width * WIDEN
                if not len(open_):
                    break

    def top(self, queries: np.ndarray, own: np.ndarray, k: int):
        """For every query its number and the ids and scores of the ``k`` best verified rows but ``own``."""
        for q, c in self.candidates(queries):
            c = c[self.ids[c] != own[q]]
            self.verified += len(c)
            score = (self.vectors[c] * queries[q]).sum(axis=1)
            best = np.lexsort((self.ids[c], -score))[:k]
            yield q, self.ids[c][best], score[best]


def _cell(k: int, norm: float):
    def cell(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        q, i, d = [], [], []
        if len(rows) and len(queries):
            index = CollisionIndex(rows["id"].to_numpy(), np.stack(rows["v"].to_numpy()), norm)
            own = queries["id"].to_numpy()
            for x, ids, score in index.top(np.stack(queries["v"].to_numpy()), own, k):
                q.append(np.full(len(ids), own[x]))
                i.append(ids)
                d.append(score)
        cat = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
        return pd.DataFrame({"query_id": cat(q, np.int64), "id": cat(i, np.int64), "score": cat(d, np.float64)})
    return cell


def inner_product_neighbours(vectors: DataFrame, *, id_col: str = "vec_id", vector: str = "embedding", dims: int | None = None,
                             k: int = 20, is_query=lambda i: F.pmod(i, F.lit(20)) == 0) -> DataFrame:
    """``(query_id, rank, id, score)``: for every query (rows whose id satisfies ``is_query``) the ``k`` rows of largest
    inner product found, its own left out, ties to the smaller id; all rows where there are at most ``k``.

    Scores are inner products of the original vectors in double precision.  ``dims`` defaults to the commonest vector
    length; vectors of another length take no part, nor do NULL ids and vectors that are NULL, all zero or hold a NULL
    or non-finite component; repeated rows count once per id (see ``valid_vectors``).  An empty table gives an empty
    result.  Other columns are not read, whatever their names.
    """
    valid = materialise(valid_vectors(vectors, id_col, vector), "vectors")
    if dims is None:
        top = valid.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
        dims = top["d"] if top else 1
    valid = valid.where(F.size("v") == dims)
    norm = valid.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()[0]
    rows = materialise(first_ids(valid, F.col("v"), k + 1), "distinct-vectors")
    queries = valid.where(is_query(F.col("id")))
    out = search(rows, queries, _cell(k, float(norm or 1.0) ** 0.5), "query_id long, id long, score double", [F.desc("score"), F.col("id")], k)
    return out.select("query_id", "rank", F.col("id").alias(id_col), "score")
