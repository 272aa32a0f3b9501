"""Hard negatives by threshold joins over suffix-bounded inverted indexes.

Components become integers, so scores are exact.  Rows are dealt by hash to blocks, each of which is indexed once; the anchors
stream through it.  A block's index lists its rows by group of ``STEP`` dimensions, dimensions of most energy first.  For a
threshold t, a row stands in the lists of its leading dimensions only: the others are omitted once the norm of
what is left of the row times the largest norm of what is left of the anchors is below t, as they can't reach t by
themselves.  Anchors accumulate partial scores over the lists; a row whose partial score plus the product of the remaining norms
stays below the threshold is pruned, the others are verified on all dimensions.  Thresholds are lowered step by step, which
extends the lists where they end, until each anchor's windows are full or reach their lower ends.

The first join finds each anchor's positives (best rows of its own label), the second the best rows of other labels inside the
window that each positive's score opens.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bucket, materialise

ROW_BLOCK = 1 << 17
#: anchors accumulated together; with a block of rows this bounds a task's partial scores
TOGETHER = 32
STEP = 8
#: first distance of the threshold from the best possible score, as a share of it; doubled from level to level
FIRST_STEP = 0.08
#: rows whose squared length is larger take no part: a hundred times a score has to fit in 63 bits
MOST_SQUARE = float(1 << 55)


class SuffixIndex:
    """Rows of a block (integers, dimensions in the order of the lists) with the norms of their suffixes."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray):
        self.ids, self.labels, self.rows = ids, labels, rows
        self.cuts = [*range(0, rows.shape[1], STEP), rows.shape[1]]
        self.rest = self.suffix_norms(rows)

    def suffix_norms(self, x: np.ndarray) -> np.ndarray:
        """Per row the norm of its dimensions from every cut on, rounded up."""
        sq = x.astype(np.float64) ** 2
        per = np.add.reduceat(sq, self.cuts[:-1], axis=1)
        out = np.zeros((len(x), len(self.cuts)))
        out[:, :-1] = np.sqrt(per[:, ::-1].cumsum(axis=1)[:, ::-1]) * (1 + 1e-9)
        return out

    def search(self, queries: np.ndarray, allowed, thresholds, full) -> list[tuple[np.ndarray, np.ndarray]]:
        """For every query the rows found and their scores: all of ``allowed(query)`` (a mask of the rows) that reach its last
        threshold.  ``thresholds(queries, level)`` gives the thresholds of a level (-inf: all rows), ``full(query, scores, t)``
        tells whether the scores of at least t are enough."""
        n, last = len(self.rows), len(self.cuts) - 1
        left = self.suffix_norms(queries)
        partial = np.zeros((len(queries), n), self.rows.dtype)
        depth = np.zeros(n, np.int64)  # groups of dimensions that list the row
        fresh = np.stack([allowed(i) for i in range(len(queries))])
        at = [[] for _ in queries]
        score = [[] for _ in queries]
        out: list = [None] * len(queries)
        open_, level = np.arange(len(queries)), 0
        self.operations = 0
        while len(open_):
            t = thresholds(open_, level)
            least = t.min()
            if least > 0:
                listed = (self.rest * left[open_].max(axis=0) >= least).sum(axis=1)
            else:
                listed = np.full(n, last)
            listed = np.minimum(np.maximum(depth, listed), last)
            for c in range(last):
                new = np.flatnonzero((depth <= c) & (listed > c))
                if len(new):
                    d = slice(self.cuts[c], self.cuts[c + 1])
                    partial[np.ix_(open_, new)] += queries[open_, d] @ self.rows[new, d].T
                    self.operations += len(open_) * len(new) * (d.stop - d.start)
            depth = listed
            rest = self.rest[np.arange(n), depth]
            keep = np.ones(len(open_), bool)
            for i, (q, low) in enumerate(zip(open_.tolist(), t.tolist())):
                hit = fresh[q] if low == -np.inf else fresh[q] & (partial[q] + left[q][depth] * rest >= low)
                new = np.flatnonzero(hit)
                if len(new):
                    fresh[q][new] = False
                    at[q].append(new)
                    score[q].append(self.rows[new] @ queries[q])
                    self.operations += new.size * self.rows.shape[1]
                a = np.concatenate(at[q]) if at[q] else np.zeros(0, np.int64)
                s = np.concatenate(score[q]) if score[q] else np.zeros(0, self.rows.dtype)
                if low == -np.inf or full(q, s[s >= low], low):
                    keep[i] = False
                    out[q] = a[s >= low], s[s >= low].astype(np.int64)
            open_, level = open_[keep], level + 1
        return out

    def best(self, at: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
        """Places of the first ``k`` of the rows ``at``: higher scores first, then smaller ids."""
        return np.lexsort((self.ids[at], -score))[:k]


def _steps(start: np.ndarray, width: np.ndarray, level: int) -> np.ndarray:
    return start - width * (FIRST_STEP * (2.0 ** (level + 1) - 1))


def _positives(k: int):
    """Best rows of the anchor's label."""
    def find(index: SuffixIndex, q: dict, lo: int, hi: int):
        x, label, own = q["v"][lo:hi], q["label"][lo:hi], q["id"][lo:hi]
        most = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1)) * index.rest[:, 0].max() + 1

        def thresholds(i, level):
            t = _steps(most[i], most[i], level)
            return np.where(t > 0, t, -np.inf)
        found = index.search(x, lambda i: (index.labels == label[i]) & (index.ids != own[i]), thresholds, lambda i, s, t: len(s) >= k)
        for i, (at, score) in enumerate(found):
            best = index.best(at, score, k)
            m = len(best)
            yield np.full(m, own[i]), np.full(m, -1), np.zeros(m, np.int64), index.ids[at[best]], score[best]
    return find


def _negatives(k: int, low: int, high: int):
    """Best rows of other labels inside the windows of the anchor's positives."""
    def find(index: SuffixIndex, q: dict, lo: int, hi: int):
        x, label, own = q["v"][lo:hi], q["label"][lo:hi], q["id"][lo:hi]
        start, end = q["from"][lo:hi + 1], q["p"]
        windows = []
        for a, b in zip(start[:-1].tolist(), start[1:].tolist()):
            p = end["score"][a:b]
            w = np.stack([-(-low * p // 100), high * p // 100], axis=1)
            windows.append(w)
        some = [w[w[:, 0] <= w[:, 1]] for w in windows]
        top = np.array([w[:, 1].min() if len(w) else 0 for w in some], np.float64)
        floor = np.array([w[:, 0].min() if len(w) else 0 for w in some], np.float64)
        span = np.maximum(np.array([w[:, 1].max() if len(w) else 0 for w in some], np.float64), 1.0)

        def thresholds(i, level):
            return np.maximum(_steps(top[i], span[i], level), floor[i])

        def full(i, s, t):
            return all(t <= a or np.count_nonzero((s >= a) & (s <= b)) >= k for a, b in some[i].tolist())
        found = index.search(x, lambda i: (index.labels != label[i]) if len(some[i]) else np.zeros(len(index.ids), bool), thresholds, full)
        for i, (at, score) in enumerate(found):
            for j, (a, b) in enumerate(windows[i].tolist()):
                inside = np.flatnonzero((score >= a) & (score <= b))
                if len(inside):
                    best = inside[index.best(at[inside], score[inside], k)]
                    m, p = len(best), start[i] + j
                    yield np.full(m, own[i]), np.full(m, end["id"][p]), np.full(m, end["score"][p]), index.ids[at[best]], score[best]
    return find


_FOUND = "anchor_id long, positive_id long, positive_score long, id long, score long"


def _blocks(find, order: list[int], exact_float: bool):
    """Cells of a task: a block's rows come first and are indexed once, its anchors follow batch by batch."""
    names = [c.split()[0] for c in _FOUND.split(", ")]
    dtype = np.float64 if exact_float else np.int64

    def vectors(b):
        return b.column("v").flatten().to_numpy().reshape(-1, len(order))[:, order].astype(dtype)

    def run(batches):
        block, rows, index = None, [], None
        for whole in batches:
            key = whole.column("block").to_numpy() * 2 + whole.column("kind").to_numpy()
            cut = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
            for i, j in zip(cut[:-1], cut[1:]):
                if i == j:
                    continue
                b = whole.slice(i, j - i)
                if block != key[i] // 2:
                    block, rows, index = key[i] // 2, [], None
                if key[i] % 2 == 0:
                    rows.append((b.column("id").to_numpy(), b.column("label").to_numpy(), vectors(b)))
                    continue
                if not rows and index is None:
                    continue
                if index is None:
                    index, rows = SuffixIndex(*(np.concatenate(x) for x in zip(*rows))), []
                p = b.column("positives")
                q = {"id": b.column("id").to_numpy(), "label": b.column("label").to_numpy(), "v": vectors(b),
                     "from": np.r_[0, np.cumsum(p.value_lengths().to_numpy(zero_copy_only=False))].astype(np.int64),
                     "p": {n: p.flatten().field(n).to_numpy() for n in ("id", "score")}}
                for lo in range(0, len(b), TOGETHER):
                    out = list(find(index, q, lo, min(len(b), lo + TOGETHER)))
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out)], names=names)
    return run


def _energy(batches):
    """Squared length per dimension of a task's rows."""
    total = None
    for b in batches:
        v = b.column("v")
        if len(v):
            x = (v.flatten().to_numpy().reshape(len(v), -1).astype(np.float64) ** 2).sum(axis=0)
            total = x if total is None else total + x
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["dim", "energy"])


def integer_rows(vectors: DataFrame, id_col: str, vector: str, label: Column, scale: int) -> DataFrame:
    """``(id, label, v)``: one row per id, components ``floor(scale * x)``.  NULL ids, labels and vectors take no part, nor do
    vectors that are empty, hold a NULL or non-finite component or whose squared length passes ``MOST_SQUARE``; of several rows
    under one id the smallest (label, vector) counts."""
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    ok = (F.size("x") > 0) & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    plain = vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), x.alias("x")) \
        .where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(ok, F.lit(False)))
    whole = F.transform("x", lambda c: F.floor(F.lit(float(scale)) * c).cast("double"))
    plain = plain.withColumn("x", whole).where(F.aggregate("x", F.lit(0.0), lambda a, c: a + c * c) <= MOST_SQUARE)
    return plain.groupBy("id").agg(F.min(F.struct("label", F.transform("x", lambda c: c.cast("int")).alias("v"))).alias("r")) \
        .select("id", "r.label", "r.v")


def hard_negatives(vectors: DataFrame, *, id_col: str = "vec_id", vector: str = "embedding", label: Column | None = None,
                   is_anchor=lambda i: F.pmod(i, F.lit(100)) == 0, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
                   scale: int = 256, dims: int | None = None, row_block: int = ROW_BLOCK) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``: for each anchor (rows whose id
    satisfies ``is_anchor``) and each of its ``positives`` best other rows of the same label, the first ``negatives`` rows of
    other labels whose score lies between ``low`` and ``high`` per cent of the positive's; higher scores first, ties by
    smaller id; all of them where there are fewer.

    Scores are integer inner products of the components ``floor(scale * x)``, exact whatever the block size.  Which rows take part, and what repeated ids
    mean: see ``integer_rows``.  ``dims`` defaults to the commonest vector length, vectors of another length take no part.
    A positive of negative score opens no window; one of score 0 asks for 0.  An empty table gives an empty result.  Other
    columns are not read, whatever their names.
    """
    valid = materialise(integer_rows(vectors, id_col, vector, F.col("label") if label is None else label, scale), "integer-vectors")
    if dims is None:
        top = valid.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
        dims = top["d"] if top else 1
    valid = valid.where(F.size("v") == dims)
    energy = valid.select("v").mapInArrow(_energy, "dim long, energy double").groupBy("dim").agg(F.sum("energy").alias("e")).collect()  # a row per dimension
    by_energy = {r["dim"]: r["e"] for r in energy}
    order = sorted(range(dims), key=lambda d: (-by_energy.get(d, 0.0), d))
    square = F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c)
    n, most = valid.agg(F.count(F.lit(1)), F.max(square)).first()
    parallel = vectors.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-n // row_block), min(parallel, -(-n // 4096)))
    none = F.expr("cast(array() as array<struct<id: bigint, score: bigint>>)")
    rows = valid.select(bucket(blocks, "id").alias("block"), F.lit(0).cast("long").alias("kind"), "id", "label", "v", none.alias("positives"))
    anchors = valid.where(is_anchor(F.col("id")))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block")

    def join(asked: DataFrame, find) -> DataFrame:
        asked = asked.select(every, F.lit(1).cast("long").alias("kind"), "id", "label", "v", "positives")
        cells = rows.unionByName(asked).repartition(blocks, "block").sortWithinPartitions("block", "kind")
        return cells.mapInArrow(_blocks(find, order, (most or 0) < 2.0 ** 52), _FOUND)

    w = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "id")
    best = join(anchors.withColumn("positives", none), _positives(positives)).withColumn("r", F.row_number().over(w)).where(F.col("r") <= positives)
    own = best.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("id", "score"))).alias("positives"))
    own = materialise(own, "positives")  # at most `positives` per anchor
    asked = anchors.join(own, F.col("id") == F.col("anchor_id")).select("id", "label", "v", "positives")
    w = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "id")
    found = join(asked, _negatives(negatives, low, high)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= negatives)
    return found.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
