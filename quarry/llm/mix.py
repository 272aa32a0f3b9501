"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A source's target is a number of words.  It is met by complete epochs over the source first; the rest by a
weighted sample without replacement: every document draws an exponential key divided by its quality weight,
the source is sorted by key and prefix-summed up to the budget.

No source is sorted in one task: keys fall into buckets of about ``BUCKET_ROWS`` documents, whose sums
give the bucket in which the budget ends; lower buckets are taken whole and only that one is sorted.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MOST = 1.5, 2.0
BUCKET_ROWS = 8_000


def _positions(df: DataFrame, order: Column) -> DataFrame:
    """``df`` with ``__pos``, its place (from 0) in the global order: a range-partitioned sort, counts per partition."""
    s = materialise(df.orderBy(order).withColumn("__part", F.spark_partition_id()).withColumn(
        "__at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "sorted")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    carry = s.groupBy("__part").agg(F.count(F.lit(1)).alias("c")).select(
        "__part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("__carry"))
    return s.join(F.broadcast(carry), "__part").withColumn("__pos", F.col("__at") + F.col("__carry")).drop("__part", "__at", "__carry")


def source_targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``target`` for every row of ``(source, source_size, ...)``: sources by code point, NULL last, weigh
    ``weights`` in turn and share ``share`` times all sizes; a target stops at ``most`` times its source's size and
    the excess is shared again by weight until none is above (each round is one small aggregate)."""
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("__pos") % len(weights) + 1).cast("int"))
    t = materialise(_positions(sources, F.col("source").asc_nulls_last()).withColumn("__w", w), "sources")
    cap = F.col("source_size") * most
    total, level, full = None, None, -1
    while True:
        over = F.lit(False) if level is None else cap <= F.col("__w") * level
        r = t.agg(F.sum("source_size"), F.sum(F.when(over, cap)), F.sum(F.when(~over, F.col("__w"))),
                  F.count(F.when(over, 1))).first()
        total = share * (r[0] or 0)
        if not r[2] or r[3] == full:
            break
        full, level = r[3], max(0.0, total - (r[1] or 0.0)) / r[2]
    part = cap if level is None else F.least(cap, F.col("__w") * level)
    return t.withColumn("target", part.cast("double")).drop("__pos", "__w")


def _fill(pdf: pd.DataFrame) -> pd.DataFrame:
    """Documents of the bucket in which a source's budget ends, in key order: all that fit, then the
    following ones that still fit the gap, then the one of nearest size if that comes nearer."""
    pdf = pdf.sort_values(["key", "rid"])
    size, need = pdf["size"].to_numpy(), float(pdf["need"].iloc[0])
    n = int(np.searchsorted(np.cumsum(size), need, "right"))
    take = np.zeros(len(size), bool)
    take[:n] = True
    gap, at = need - size[:n].sum(), n
    while at < len(size):
        fits = np.flatnonzero(size[at:] <= gap)
        if not len(fits):
            break
        at += int(fits[0])
        take[at] = True
        gap -= size[at]
        at += 1
    off = np.where(take, np.inf, np.abs(size - gap))
    if len(off) and off.min() < gap:
        take[int(off.argmin())] = True
    return pd.DataFrame({"rid": pdf["rid"].to_numpy()[take]})


def mix(docs: DataFrame, *, source: str = "source", size: str = "__size", weight: str = "__weight", draw: list[str],
        weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 2) -> DataFrame:
    """All columns of ``docs`` and ``__source_size``, ``__target``, ``__times`` (how often the mix takes the document:
    complete epochs, one more if it is in the fractional sample) and ``__taken`` (``__times`` sizes).

    ``size`` is a long column (NULL: 0), ``weight`` a positive quality weight (NULL: 1); ``draw`` names the columns that
    seed a document's key, so that reruns agree.  A NULL source is a source of its own, after all others; a source of
    size 0 has target 0 and its documents are taken 0 times.  Repeated rows share a key and are taken one after
    the other.  An empty table gives an empty result.  Whole documents are taken, never parts.  Further columns
    pass through, whatever their names.
    """
    cols = docs.columns
    plain = [f"c{i}" for i in range(len(cols))]
    source, size, weight = (plain[cols.index(x)] for x in (source, size, weight))
    draw = [plain[cols.index(x)] for x in draw]
    n = F.coalesce(F.col(size), F.lit(0)).cast("long")
    base = materialise(docs.toDF(*plain).withColumn("__rid", F.monotonically_increasing_id()), "mixed", "zstd")
    w = F.coalesce(F.col(weight), F.lit(1.0)).cast("double")
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *draw), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    rows = base.select(F.col("__rid").alias("rid"), F.col(source).alias("source"), n.alias("size"), w.alias("w"),
                       (-F.log(u) / w).alias("key"))
    per = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    per = source_targets(per, weights, share, most)
    lightest = rows.agg(F.min("w")).first()[0] or 1.0
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    per = materialise(per.withColumn("epochs", epochs.cast("long")).withColumn(
        "rest", F.col("target") - F.col("epochs") * F.col("source_size")).withColumn(
        "buckets", F.ceil(F.col("n") / BUCKET_ROWS)), "targets")
    p = per.select(F.col("source").alias("s"), "buckets")
    place = F.floor((1.0 - F.exp(-F.col("key") * lightest)) * F.col("buckets")).cast("long")
    rows = rows.join(p, rows["source"].eqNullSafe(p["s"])).select(
        "rid", "source", "size", "key", F.least(place, F.col("buckets") - 1).alias("bucket"))
    rows = materialise(rows, "keyed")
    # the bucket where the budget ends
    run = Window.partitionBy("source").orderBy("bucket")
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("b")).withColumn("upto", F.sum("b").over(run))
    p = per.select(F.col("source").alias("s"), "rest")
    ends = sums.join(p, sums["source"].eqNullSafe(p["s"])).where("rest > 0 and upto > rest and upto - b <= rest") \
        .select("source", F.col("bucket").alias("end"), (F.col("rest") - F.col("upto") + F.col("b")).alias("need"))
    ends = ends.select(F.col("source").alias("s"), "end", "need")
    at = rows.join(ends, rows["source"].eqNullSafe(ends["s"]))
    edge = at.where("bucket = end").select("source", "rid", "size", "key", "need").groupBy("source").applyInPandas(_fill, "rid long")
    picked = at.where("bucket < end").select("rid").unionByName(edge).withColumn("more", F.lit(1).cast("long"))
    p = per.select(F.col("source").alias("s"), "source_size", "target", "epochs")
    out = base.join(picked, base["__rid"] == picked["rid"], "left")
    out = out.join(p, out[source].eqNullSafe(p["s"]))
    times = (F.col("epochs") + F.coalesce("more", F.lit(0))).cast("long")
    times = F.when(F.col("source_size") > 0, times).otherwise(F.lit(0).cast("long"))
    return out.select(*[F.col(p).alias(c) for p, c in zip(plain, cols)], F.col("source_size").alias("__source_size"), F.col("target").alias("__target"),
                      times.alias("__times"), (times * n).alias("__taken"))
