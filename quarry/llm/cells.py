"""Blocked search of a query set against all rows: every query block meets every row block in one cell.

Rows are dealt to blocks by hash, so no bucket or repeated vector is hot; a cell holds at most about
``ROW_BLOCK`` rows and ``QUERY_BLOCK`` queries and returns its ``k`` nearest per query, which are then merged.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bucket

ROW_BLOCK = 1 << 16
QUERY_BLOCK = 1 << 13


def valid_vectors(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """``(id, v)``: one row per id, vectors as doubles.  NULL ids take no part, nor do vectors that are NULL, empty,
    all zero or hold a NULL or non-finite component; of several vectors under one id the smallest (as an array) counts."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    ok = (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) \
        & F.exists("v", lambda x: x != 0)
    return df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.coalesce(ok, F.lit(False))) \
        .groupBy("id").agg(F.min("v").alias("v"))


def first_ids(df: DataFrame, key: Column, n: int) -> DataFrame:
    """Of rows with equal ``key`` the ``n`` smallest ids; later ones are never among the nearest (ties go to
    smaller ids), so this is exact.  The limit is applied before the shuffle."""
    w = Window.partitionBy(key).orderBy("id")
    return df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")


def search(rows: DataFrame, queries: DataFrame, fn: Callable, schema: str, nearest: list[Column], k: int) -> DataFrame:
    """``fn(row frame, query frame)`` in every cell; of its ``(query_id, id, ...)`` rows the first ``k`` per query by
    ``nearest``, with ``rank`` from 1.  ``rows`` and ``queries`` are written tables with a column ``id``."""
    n, q = rows.count(), queries.count()
    spread = rows.sparkSession.sparkContext.defaultParallelism
    q_blocks = max(1, -(-q // QUERY_BLOCK))
    r_blocks = max(1, -(-n // ROW_BLOCK), min(-(-spread // q_blocks), -(-n // 4096)))
    r = rows.withColumn("rb", bucket(r_blocks, "id")).withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(q_blocks - 1).cast("long"))))
    s = queries.withColumn("qb", bucket(q_blocks, "id")).withColumn("rb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(r_blocks - 1).cast("long"))))
    found = r.groupBy("qb", "rb").cogroup(s.groupBy("qb", "rb")).applyInPandas(fn, schema)
    w = Window.partitionBy("query_id").orderBy(*nearest)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
