"""Exact Hamming top-k over binary codes by incremental multi-index hashing.

A code is cut into segments of ``SEGMENT_BITS`` bits; each segment has an index from value to rows.  For a query, segment
after segment is searched at radius 0, then at radius 1, and so on; what is found is verified on whole codes.  Once
``r * m + j + 1`` segment searches are done (radius r for the first j + 1 of m segments, r - 1 for the others), every
code within distance ``r * m + j`` has been seen (pigeonhole), so the search ends when the k-th verified distance is at
most that.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cells import first_ids, search, valid_vectors
from .common import materialise

SEGMENT_BITS = 16


def _masks(bits: int) -> list[np.ndarray]:
    """For every radius the xor masks of that many bits."""
    return [np.array([sum(1 << b for b in c) for c in combinations(range(bits), r)], np.int64) for r in range(bits + 1)]


def _segments(codes: np.ndarray, bits: int) -> np.ndarray:
    """Rows of bytes cut into segments of 8 or 16 bits (a last one of 8 bits is padded)."""
    step = bits // 8
    pad = -codes.shape[1] % step
    c = np.pad(codes, ((0, 0), (0, pad))).astype(np.int64)
    return sum(c[:, i::step] << (8 * (step - 1 - i)) for i in range(step))


class MultiIndex:
    """Rows of one block, indexed by every segment."""

    def __init__(self, ids: np.ndarray, codes: np.ndarray, bits: int = SEGMENT_BITS):
        self.ids, self.codes, self.bits = ids, codes, bits
        seg = _segments(codes, bits)
        self.m = seg.shape[1]
        self.order = [np.argsort(seg[:, j], kind="stable") for j in range(self.m)]
        self.start = [np.r_[0, np.cumsum(np.bincount(seg[:, j], minlength=1 << bits))] for j in range(self.m)]
        self.masks = _masks(bits)

    def top(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of the ``k`` nearest rows but ``own``, ties to smaller ids."""
        seg = _segments(query[None, :], self.bits)[0]
        seen = self.ids == own
        ids, dist = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for r, masks in enumerate(self.masks):
            for j in range(self.m):
                value = seg[j] ^ masks
                lo, n = self.start[j][value], self.start[j][value + 1] - self.start[j][value]
                at = np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
                rows = self.order[j][at]
                rows = rows[~seen[rows]]
                if len(rows):
                    seen[rows] = True
                    d = np.bitwise_count(self.codes[rows] ^ query).sum(axis=1).astype(np.int64)
                    ids, dist = np.r_[ids, self.ids[rows]], np.r_[dist, d]
                    keep = np.lexsort((ids, dist))[:k]
                    ids, dist = ids[keep], dist[keep]
                if len(ids) == k and dist[-1] <= r * self.m + j or seen.all():
                    return ids, dist
        return ids, dist


def _cell(k: int, bits: int):
    def cell(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        got = []
        if len(rows) and len(queries):
            byte = lambda f: np.frombuffer(b"".join(f["code"]), np.uint8).reshape(len(f), -1)
            index = MultiIndex(rows["id"].to_numpy(), byte(rows), bits)
            for own, code in zip(queries["id"].to_numpy(), byte(queries)):
                ids, dist = index.top(code, own, k)
                got.append(np.stack([np.full(len(ids), own), ids, dist]))
        q, i, d = np.concatenate(got, axis=1) if got else np.zeros((3, 0), np.int64)
        return pd.DataFrame({"query_id": q, "id": i, "distance": d.astype(np.int32)})
    return cell


def sign_codes(vectors: DataFrame, dims: int) -> DataFrame:
    """``(id, code)``: bit i (from the left) tells whether component i is positive; vectors of another length take no part."""
    byte = lambda i: sum((F.when(F.element_at("v", 8 * i + b + 1) > 0, 1 << (7 - b)).otherwise(0)) for b in range(8))
    code = F.concat(*[F.unhex(F.lpad(F.hex(byte(i).cast("long")), 2, "0")) for i in range(dims // 8)])
    return vectors.where(F.size("v") == dims).select("id", code.alias("code"))


def hamming_top_k(vectors: DataFrame, *, id_col: str = "vec_id", vector: str = "embedding", dims: int = 64, k: int = 10,
                  is_query=lambda i: F.pmod(i, F.lit(100)) == 0, segment_bits: int = SEGMENT_BITS) -> DataFrame:
    """``(query_id, rank, id, distance)``: the ``k`` rows nearest to every query (rows whose id satisfies
    ``is_query``) by Hamming distance of sign codes, the query's own left out, ties to the smaller id; fewer where
    there are fewer rows.

    Codes need ``dims`` divisible by 8.  NULL ids and vectors that are NULL, all zero, of another length or hold a NULL or
    non-finite component take no part; repeated rows count once per id (see ``valid_vectors``).  An empty table gives an
    empty result.  Other columns are not read, whatever their names.
    """
    codes = materialise(sign_codes(valid_vectors(vectors, id_col, vector), dims), "codes")
    rows = materialise(first_ids(codes, F.col("code"), k + 1), "distinct-codes")
    queries = codes.where(is_query(F.col("id")))
    out = search(rows, queries, _cell(k, segment_bits), "query_id long, id long, distance int", [F.col("distance"), F.col("id")], k)
    return out.select("query_id", "rank", F.col("id").alias(id_col), "distance")
