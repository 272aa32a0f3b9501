"""Sharding by longest-processing-time scheduling.

Equal texts form a group that stays together.  Groups larger than a ``BUNDLES``-th of all bytes are scheduled one by
one (there are at most ``BUNDLES`` of them); the others are first bundled by hash into ``BUNDLES`` bundles.  These at
most ``2 * BUNDLES`` items, whatever the input's size, go largest first to the least-loaded shard, through a heap.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bucket, materialise

SHARDS = 24
BUNDLES = 4096
SLOT_ROWS = 100_000


def schedule(items: list[tuple], shards: int) -> list[tuple]:
    """``(size, *key)`` items, largest first (ties by key), each to the least-loaded shard (ties: the first)."""
    heap = [(0, s) for s in range(shards)]
    out = []
    for size, *key in sorted(items, key=lambda x: (-x[0], *x[1:])):
        load, s = heapq.heappop(heap)
        out.append((*key, s))
        heapq.heappush(heap, (load + size, s))
    return out


def shard(docs: DataFrame, shards: int = SHARDS, *, id_col: str = "doc_id", text: str = "text", extra: int = 8,
          bundles: int = BUNDLES) -> DataFrame:
    """``(id, size, text_crc32, shard, slot)`` of every document: size is the text's UTF-8 bytes plus ``extra``;
    shards have nearly equal sizes (as far as the largest group allows), equal texts share one, and slots count
    from 0 without gaps.

    A NULL text counts as empty and groups with empty texts.  Repeated rows and NULL ids are documents like any
    others; within a shard, rows are ordered by a hash of id and text.  An empty table gives an empty result.
    Other columns are not read, whatever their names.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    rows = materialise(docs.select(F.col(id_col).alias("id"), (F.octet_length(body) + F.lit(extra)).cast("long").alias("size"),
                                   F.crc32(body.cast("binary")).alias("crc"), F.xxhash64(body).alias("grp")), "sizes")
    groups = rows.groupBy("grp").agg(F.sum("size").alias("size"))
    total, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    groups = groups.withColumn("alone", F.col("size") > F.lit(total // bundles))
    item = F.when(F.col("alone"), F.col("grp")).otherwise(bucket(bundles, F.lit(9), "grp"))
    items = groups.groupBy("alone", item.alias("item")).agg(F.sum("size").alias("size"))
    # at most 2 * bundles rows: fewer than `bundles` groups can exceed total / bundles
    placed = schedule([(r["size"], r["alone"], r["item"]) for r in items.collect()], shards)
    plan = spark.createDataFrame(placed, "alone boolean, item long, shard int")
    big = F.broadcast(plan.where("alone").select(F.col("item").alias("grp"), F.col("shard").alias("own")))
    rest = F.broadcast(plan.where("not alone").select(F.col("item").alias("bundle"), F.col("shard").alias("shared")))
    out = rows.join(big, "grp", "left").withColumn("bundle", bucket(bundles, F.lit(9), "grp")).join(rest, "bundle", "left")
    out = out.select("id", "size", "crc", "grp", F.coalesce("own", "shared").alias("shard"))
    # gapless slots without one sort per shard: counts of hash cells carry in
    cells = max(1, -(-n // SLOT_ROWS))
    out = out.withColumn("cell", bucket(cells, "id", "grp"))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    carry = out.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("c")).select(
        "shard", "cell", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("carry"))
    within = Window.partitionBy("shard", "cell").orderBy(F.xxhash64("id", "grp"), "id", "grp")
    out = out.withColumn("at", F.row_number().over(within) - 1).join(carry, ["shard", "cell"])
    return out.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard",
                      (F.col("at") + F.col("carry")).cast("long").alias("slot"))
