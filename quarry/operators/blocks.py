"""Every query against every row, block by block: exact nearest rows where no index spares the comparison.

Both sides are packed to blocks of rows, one binary value for a block's ids and one for its vectors, in single precision where that
loses nothing.  Partitions of query blocks meet partitions of row blocks by Spark's cartesian join, which reads its inputs again for
each task instead of sending them per pair: what is written grows with the rows, however many blocks meet.  A task keeps the k best rows of
the query block at hand, so it holds two blocks and returns k rows per query; comparing takes time by the product of both sides.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path

#: rows and bytes of a block; blocks of a task's share of the queries and of the rows
BLOCK_ROWS, BLOCK_BYTES = 4096, 2 << 20
QUERY_SHARE, ROW_SHARE = 8, 64
_BLOCKS = "at long, ids binary, vs binary"


def _pack(size: int, dims: int):
    """A task's rows as blocks of ``size`` rows."""
    def block(at: int, ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        with np.errstate(over="ignore"):
            single = x.astype(np.float32)
        x = single if (single == x).all() else x
        return pa.RecordBatch.from_arrays([pa.array([at]), pa.array([ids.tobytes()]), pa.array([x.tobytes()])], names=["at", "ids", "vs"])

    def pack(batches):
        ids, x, at = np.zeros(0, np.int64), np.zeros((0, dims)), 0
        for b in batches:
            ids = np.concatenate([ids, b.column(0).to_numpy()])
            x = np.concatenate([x, b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)])
            while len(ids) >= size:
                yield block(at, ids[:size], x[:size])
                ids, x, at = ids[size:], x[size:], at + 1
        if len(ids):
            yield block(at, ids, x)
    return pack


def _unpack(b: pa.RecordBatch, i: int, side: str, dims: int) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(b.column(f"{side}_ids")[i].as_buffer(), np.int64).copy()  # a view would keep the whole batch
    raw = b.column(f"{side}_vs")[i].as_buffer()
    kind = np.float32 if raw.size == 4 * dims * len(ids) else np.float64
    return ids, np.frombuffer(raw, kind).reshape(-1, dims).astype(np.float64)


def _blocks(df: DataFrame, side: str, size: int, dims: int) -> DataFrame:
    """Blocks of ``df`` (id, v), written: number, ids and vectors."""
    spark = df.sparkSession
    path = scratch_path(spark, f"{side}-blocks")
    packed = df.mapInArrow(_pack(size, dims), _BLOCKS)
    packed = packed.select((F.shiftleft(F.spark_partition_id().cast("long"), 32) + F.col("at")).alias(f"{side}_at"),
                           F.col("ids").alias(f"{side}_ids"), F.col("vs").alias(f"{side}_vs"))
    packed.write.parquet(path)
    return spark.read.schema(packed.schema).parquet(path)


def block_candidates(queries: DataFrame, rows: DataFrame, k: int, dims: int, n_queries: int, n_rows: int, local_topk,
                     block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(query_id, doc_id, sim)`` holding the k best of ``rows`` (doc_id, v) for each of ``queries`` (query_id, v); ``v`` holds ``dims``
    finite doubles.  ``local_topk`` scores a block of queries against a block of rows."""
    size = max(1, min(block_rows, BLOCK_ROWS, BLOCK_BYTES // (8 * dims)))
    q, d = _blocks(queries.select("query_id", "v"), "q", size, dims), _blocks(rows.select("doc_id", "v"), "d", size, dims)
    q_blocks, d_blocks, tasks = -(-n_queries // size), -(-n_rows // size), 2 * rows.sparkSession.sparkContext.defaultParallelism
    d_parts = -(-d_blocks // ROW_SHARE)
    q_parts = max(1, min(q_blocks, max(-(-q_blocks // QUERY_SHARE), -(-tasks // max(1, d_parts)))))
    d_parts = max(1, min(d_blocks, max(d_parts, -(-tasks // q_parts))))

    def meet(batches):
        at, ids, x, best = None, None, None, None
        for b in batches:
            for i, here in enumerate(b.column("q_at").to_pylist()):
                if here != at:
                    if best is not None:
                        yield _found(ids, best)
                    at, best = here, None
                    ids, x = _unpack(b, i, "q", dims)
                best = local_topk(x, *_unpack(b, i, "d", dims), k, best)
        if best is not None:
            yield _found(ids, best)

    # a query block's pairs come one after the other
    pairs = q.repartitionByRange(q_parts, "q_at").hint("shuffle_replicate_nl").crossJoin(d.repartitionByRange(d_parts, "d_at"))
    return pairs.mapInArrow(meet, "query_id long, doc_id long, sim double")


def _found(ids: np.ndarray, best: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
    s, d = best
    keep = np.isfinite(s)
    return pa.RecordBatch.from_arrays([pa.array(ids[np.nonzero(keep)[0]]), pa.array(d[keep]), pa.array(s[keep])],
                                      names=["query_id", "doc_id", "sim"])
