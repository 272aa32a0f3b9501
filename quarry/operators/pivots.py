"""Exact nearest rows for query sides of any size (J2, W1): pivot cells with triangle-inequality bounds.

Pivots are a bounded sample of the knowledge base.  Every row belongs to the cell of the pivot nearest in angle and, in it, to a
ring by that angle.  A summary per (cell, ring), at most ``MAX_PIVOTS * RINGS`` rows, holds the angles and norms found there.
Angles obey the triangle inequality, so for a query at angle t from a pivot no row of a ring between angles lo and hi is nearer
than max(0, t - hi, lo - t), which bounds its inner product with the query.

A query visits the rings of highest bound until they hold k rows; its k-th best row there is a threshold, and only rings whose
bound reaches it are visited next.  A visit sends the query's vector, so cells serve where visits are few: a bounded sample of queries
tells how many to expect, and beyond ``MAX_VISITS`` per row of the table (vectors without clusters, or nearly as many queries as rows) the
rows are not asked through cells but met block by block (``blocks.py``), where nothing is sent per visit.  Rings of more than ``piece_rows`` rows are dealt to pieces by row, so copies or
a dense cell make no large task.  A piece's rows are shuffled once per visit round, never once per block of queries; the queries
that visit it stream past them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .blocks import block_candidates

MAX_PIVOTS, RINGS = 1024, 64
PIECE_ROWS, CELL_ROWS = 50_000, 512
#: visits per row of the table, all queries together, and the queries sampled to tell
MAX_VISITS, ASKED = 1.0, 64
#: numbers of an intermediate array of a task
_CHUNK = 1 << 20
_SLACK = 1e-9


def _written(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _matrix(col: pa.Array, dims: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def _unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Directions (zero vectors stay) and norms."""
    norm = np.sqrt((x * x).sum(axis=1))
    return x / np.where(norm > 0, norm, 1.0)[:, None], norm


def _angles(unit: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit @ pivots.T, -1.0, 1.0))


def _slices(batches, width: int):
    """Batches in slices of rows for which arrays of ``width`` columns stay small."""
    rows = max(1, _CHUNK // max(1, width))
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)


class PivotIndex:
    """Rows ``(doc_id, v)`` in pieces; ``v`` holds ``dims`` finite doubles."""

    def __init__(self, rows: DataFrame, dims: int, piece_rows: int = PIECE_ROWS, max_pivots: int = MAX_PIVOTS):
        self.dims, self.spark = dims, rows.sparkSession
        n = self.total = rows.count()
        # cells of a few rows cost more visits than they save
        want = min(max_pivots, max(1, math.isqrt(n)), 1 + n // max(1, min(CELL_ROWS, piece_rows // 4)))
        # a bounded sample by hash; copies of a vector make one pivot
        some = rows.select("v").orderBy(F.xxhash64("v")).limit(4 * want).collect()
        some = np.unique(np.array([r["v"] for r in some], np.float64).reshape(-1, dims), axis=0)
        self.some = some
        some, norm = _unit(some)
        some = some[norm > 0]
        order = np.random.default_rng(1).permutation(len(some))[:want]
        self.pivots = some[order] if len(order) else np.eye(1, dims)
        schema = "doc_id long, v array<double>, cell int, ring int, angle double, norm double"
        placed = _written(rows.mapInArrow(self._placer(), schema).withColumn("row", F.monotonically_increasing_id()), "pivot-cells")
        per = placed.groupBy("cell", "ring").agg(
            F.count(F.lit(1)).alias("n"), F.min("angle").alias("lo"), F.max("angle").alias("hi"),
            F.min("norm").alias("small"), F.max("norm").alias("large")).orderBy("cell", "ring").collect()  # pivots x rings at most
        col = lambda name, kind: np.array([r[name] for r in per], kind)
        self.cell, self.n = col("cell", np.int64), col("n", np.int64)
        self.lo, self.hi, self.small, self.large = (col(x, np.float64) for x in ("lo", "hi", "small", "large"))
        self.split = -(-self.n // piece_rows)
        self.first = np.cumsum(self.split) - self.split
        self.pieces = int(self.split.sum())
        # most pieces are small: a task takes several, about piece_rows rows together
        self.tasks = max(1, min(self.pieces, max(self.spark.sparkContext.defaultParallelism, -(-n // piece_rows))))
        known = [(int(r["cell"]), int(r["ring"]), int(f), int(s)) for r, f, s in zip(per, self.first, self.split)]
        known = self.spark.createDataFrame(known, "cell int, ring int, first long, split long")
        piece = F.col("first") + F.pmod(F.xxhash64("row"), F.col("split"))
        self.rows = placed.join(F.broadcast(known), ["cell", "ring"]).select(piece.alias("piece"), F.col("doc_id").alias("id"), "v")

    def _placer(self):
        pivots, dims = self.pivots, self.dims

        def place(batches):
            for b in _slices(batches, len(pivots)):
                unit, norm = _unit(_matrix(b.column("v"), dims))
                angle = _angles(unit, pivots) if len(unit) else np.zeros((0, len(pivots)))
                cell = angle.argmin(axis=1) if len(unit) else np.zeros(0, np.int64)
                near = np.where(norm > 0, angle[np.arange(len(cell)), cell], 0.0)  # a zero vector has any direction
                ring = np.minimum((near * (RINGS / math.pi)).astype(np.int32), RINGS - 1)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("v"), pa.array(cell.astype(np.int32)), pa.array(ring), pa.array(near), pa.array(norm)],
                                                 names=["doc_id", "v", "cell", "ring", "angle", "norm"])
        return place

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Per query and ring the largest inner product that a row there can have."""
        unit, norm = _unit(queries)
        t = _angles(unit, self.pivots)[:, self.cell]
        cos = np.minimum(1.0, np.cos(np.maximum(0.0, np.maximum(t - self.hi, self.lo - t) - _SLACK)) + _SLACK)
        return norm[:, None] * np.where(cos >= 0, self.large, self.small) * cos + _SLACK * (1 + norm[:, None] * self.large)

    def nearest(self, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Bounds, and per query the rings of highest bound that together hold k rows."""
        up = self.bounds(queries)
        order = np.argsort(-up, axis=1, kind="stable")
        before = np.cumsum(self.n[order], axis=1) - self.n[order]
        first = np.zeros(up.shape, bool)
        np.put_along_axis(first, order, before < k, axis=1)
        return up, first

    def expected_visits(self, queries: np.ndarray, k: int) -> float:
        """Visits per query, by a sample of queries; thresholds come from the sampled rows, so there are fewer."""
        if not len(queries) or not self.pieces:
            return 0.0
        up, first = self.nearest(queries, k)
        dots = queries @ self.some.T
        least = np.partition(dots, -k, axis=1)[:, -k] if dots.shape[1] >= k else np.full(len(queries), -np.inf)
        return float(((first | (up >= least[:, None])) * self.split).sum(axis=1).mean())

    def visits(self, queries: DataFrame, k: int, second: bool) -> DataFrame:
        """``(id, v, piece)`` of ``queries`` (query_id, v, and ``least``, the threshold, in the second round)."""
        index = self._plain()

        def ask(batches):
            for b in _slices(batches, len(index.n)):
                up, first = index.nearest(_matrix(b.column("v"), index.dims), k)
                if second:
                    least = b.column("least").to_numpy(zero_copy_only=False).astype(np.float64)
                    first = ~first & (up >= least[:, None])
                q, ring = np.nonzero(first)
                size = index.split[ring]
                piece = np.repeat(index.first[ring], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                at = np.repeat(q, size)
                for lo in range(0, len(at), _CHUNK // index.dims + 1):
                    some = slice(lo, lo + _CHUNK // index.dims + 1)
                    ids = pa.array(at[some])
                    yield pa.RecordBatch.from_arrays([b.column("query_id").take(ids), b.column("v").take(ids), pa.array(piece[some])], names=["id", "v", "piece"])
        columns = ["query_id", "v", "least"] if second else ["query_id", "v"]
        return queries.select(*columns).mapInArrow(ask, "id long, v array<double>, piece long")

    def _plain(self) -> PivotIndex:
        """What tasks need: pivots and summaries, no DataFrame."""
        out = object.__new__(PivotIndex)
        for x in ("dims", "pivots", "cell", "n", "lo", "hi", "small", "large", "split", "first"):
            setattr(out, x, getattr(self, x))
        return out

    def search(self, asked: DataFrame, k: int, local_topk) -> DataFrame:
        """The k best rows ``(query_id, doc_id, sim)`` of every visited piece for every query that visits it."""
        dims, tasks = self.dims, self.tasks
        rows = self.rows.join(asked.select("piece").distinct(), "piece", "left_semi")
        cells = rows.select("piece", F.lit(0).alias("kind"), "id", "v").unionByName(asked.select("piece", F.lit(1).alias("kind"), "id", "v"))
        cells = cells.repartition(tasks, "piece").sortWithinPartitions("piece", "kind")

        def run(batches):
            piece, ids, mats, ready = None, [], [], None
            for whole in batches:
                key = whole.column("piece").to_numpy() * 2 + whole.column("kind").to_numpy()
                cut = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
                for i, j in zip(cut[:-1], cut[1:]):
                    if i == j:
                        continue
                    b = whole.slice(i, j - i)
                    if piece != key[i] // 2:
                        piece, ids, mats, ready = key[i] // 2, [], [], None
                    if key[i] % 2 == 0:
                        ids.append(b.column("id").to_numpy())
                        mats.append(_matrix(b.column("v"), dims))
                        continue
                    if ready is None:
                        ready = np.concatenate(ids), np.concatenate(mats)
                    s, d = local_topk(_matrix(b.column("v"), dims), *ready, k)
                    keep = np.isfinite(s)
                    yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(np.nonzero(keep)[0])), pa.array(d[keep]), pa.array(s[keep])],
                                                     names=["query_id", "doc_id", "sim"])
        return cells.mapInArrow(run, "query_id long, doc_id long, sim double")


def pivot_candidates(queries: DataFrame, rows: DataFrame, k: int, dims: int, merge, local_topk, piece_rows: int = PIECE_ROWS,
                     max_pivots: int = MAX_PIVOTS, max_visits: float = MAX_VISITS) -> DataFrame:
    """``(query_id, doc_id, sim)`` holding every query's k best rows: ``merge`` takes candidates to the k best per query,
    ``local_topk`` scores queries against a piece.  Where more than ``max_visits`` visits per row are expected, queries meet all rows
    in blocks of at most ``piece_rows``."""
    index = PivotIndex(rows, dims, piece_rows, max_pivots)
    if not index.pieces:
        return queries.select(F.col("query_id"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("double").alias("sim")).limit(0)
    asked = queries.select("v").orderBy(F.xxhash64("v")).limit(ASKED).collect()
    per_query = index.expected_visits(np.array([r["v"] for r in asked], np.float64).reshape(-1, dims), k)
    n_queries = queries.count()
    if n_queries * per_query > max_visits * index.total:
        return block_candidates(queries, rows, k, dims, n_queries, index.total, local_topk, piece_rows)
    first = _written(merge(index.search(_written(index.visits(queries, k, False), "pivot-visits"), k, local_topk)).select("query_id", "doc_id", "sim"), "pivot-first")
    least = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("found"), F.min("sim").alias("least"))
    least = least.select("query_id", F.when(F.col("found") >= k, F.col("least")).otherwise(F.lit(float("-inf"))).alias("least"))
    more = queries.join(least, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
    second = index.search(_written(index.visits(more, k, True), "pivot-visits"), k, local_topk)
    return first.unionByName(second)
