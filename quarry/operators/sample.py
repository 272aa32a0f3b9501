"""Seeded shuffle and split carving.

The shuffle is a total order by ``md5(seed ':' id), id`` — deterministic, seed-sensitive and
independent of partitioning, and identical in Spark and DuckDB.  It does not reproduce a library
PRNG permutation (K2): the rows chosen differ from other tools' shuffles, by design.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._check import require_columns

# Selections of at most this many rows are numbered in one group per seed; larger ones in buckets of the key of about this size.
BUCKET_ROWS = 50_000
# Hex digits of the key that one pass over the ids counts by, and up to how many rows of a bucket the n-th one is looked up at once.
DIGITS, SMALL_BUCKET = 3, 10_000


# L1 -------------------------------------------------------------------------------------------
def shuffle_key(id_col, seed: int) -> Column:
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat(F.lit(f"{seed}:"), c.cast("string")))


def seeded_order(df: DataFrame, id_col: str, seed: int) -> DataFrame:
    """The whole frame in shuffled order (a distributed range sort)."""
    require_columns(df, id_col)
    return df.orderBy(shuffle_key(id_col, seed), F.col(id_col))


# L2 / L3 --------------------------------------------------------------------------------------
def _ranked_ids(df: DataFrame, id_col: str, n: int, seeds: list[int]) -> DataFrame:
    """``(_seed, _cid, rank)`` of the first ``n`` rows of the shuffle of every seed, for any ``n``.

    Only ids and keys move.  Rows fall into buckets by the leading digits of their key; bucket counts (one small aggregate) tell
    how many rows precede a bucket, buckets that begin at ``n`` or later are dropped, and the others are numbered each in its own
    group.  So no group grows with ``n`` or with the table, and the result doesn't depend on how often the plan runs a part.
    """
    ids = df.select(F.col(id_col).alias("_cid"), F.explode(F.array(*[F.lit(int(s)) for s in seeds])).alias("_seed"))
    ids = ids.withColumn("_k", F.md5(F.concat(F.col("_seed").cast("string"), F.lit(":"), F.col("_cid").cast("string"))))
    total = df.select(F.count(F.lit(1))).scalar()
    # buckets by the first 32 bits of the key: as many as keep BUCKET_ROWS rows in each
    buckets = F.greatest(F.lit(1).cast("long"), F.ceil(total / F.lit(BUCKET_ROWS)).cast("long"))
    lead = F.coalesce(F.conv(F.substring("_k", 1, 8), 16, 10).cast("long"), F.lit(0).cast("long"))
    ids = ids.withColumn("_b", F.floor(lead * buckets / F.lit(1 << 32)).cast("long"))
    before = Window.partitionBy("_seed").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = ids.groupBy("_seed", "_b").agg(F.count(F.lit(1)).alias("_c"))
    starts = counts.select("_seed", "_b", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_from")).where(F.col("_from") < n)
    w = Window.partitionBy("_seed", "_b").orderBy("_k", "_cid")
    # of a bucket n rows at most are needed: the limit is applied before the shuffle
    # about n / BUCKET_ROWS + 1 buckets per seed begin below n; while these are few the ids are cut down where they are read
    few = len(seeds) * (n // BUCKET_ROWS + 1) <= 100_000
    at = ids.join(F.broadcast(starts) if few else starts, ["_seed", "_b"])
    at = at.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    at = at.withColumn("rank", (F.col("_from") + F.col("_rn")).cast("int"))
    return at.where(F.col("rank") <= n).select("_seed", "_cid", "rank")


def _cuts(df: DataFrame, id_col: str, n: int, seeds: list[int], small: int | None = None) -> dict[int, Column] | None:
    """Per seed the condition that a row is among the first ``n`` of the shuffle; None where there are fewer than ``n`` rows.

    Found by radix counts: one pass counts the ids by the first digits of their key, the next ones only look into the bucket where the
    n-th lies, until it holds a few rows.  Nothing but a count per bucket and seed (at most ``16 ** DIGITS``) reaches the driver, and
    the rows themselves are chosen by comparing their key with the n-th one: no sort, join or shuffle of theirs.  NULL ids come first."""
    small = SMALL_BUCKET if small is None else small
    ids = df.select(F.col(id_col).alias("i"), F.explode(F.array(*[F.lit(int(s)) for s in seeds])).alias("s"))
    ids = ids.withColumn("k", F.md5(F.concat(F.col("s").cast("string"), F.lit(":"), F.col("i").cast("string"))))
    prefix, before, ready, out = {s: "" for s in seeds}, {s: 0 for s in seeds}, {}, {}
    while prefix:
        at = F.lit(False)
        for s, p in prefix.items():
            at = at | ((F.col("s") == s) & (F.col("k").startswith(p) if p else F.lit(True)))
        length = len(next(iter(prefix.values())))
        counts = ids.where(at).groupBy("s", F.substring("k", 1, length + DIGITS).alias("p")).agg(F.count(F.lit(1)).alias("c")).collect()
        by_seed = {s: sorted(((r["p"] or "", r["p"] is not None, r["c"]) for r in counts if r["s"] == s), key=lambda x: x[:2]) for s in prefix}
        for s in list(prefix):
            row = before[s]
            for p, known, c in by_seed[s]:
                if row + c >= n:
                    break
                row += c
            else:
                return None
            del prefix[s]
            if not known:  # the n-th row is one without an id, and they are all alike
                out[s] = F.col(id_col).isNull()
            elif c <= small or len(p) >= 32:
                ready[s] = (p, n - row)
            else:
                prefix[s], before[s] = p, row
    if ready:  # the n-th row of each bucket, all in one job
        at, rank = F.lit(False), F.lit(0)
        for s, (p, place) in ready.items():
            at = at | ((F.col("s") == s) & F.col("k").startswith(p))
            rank = F.when(F.col("s") == s, F.lit(place)).otherwise(rank)
        w = Window.partitionBy("s").orderBy("k", "i")
        for last in ids.where(at).withColumn("r", F.row_number().over(w)).where(F.col("r") == rank).select("s", "k", "i").collect():
            k = shuffle_key(id_col, last["s"])
            out[last["s"]] = F.coalesce((k < last["k"]) | ((k == last["k"]) & (F.col(id_col) <= F.lit(last["i"]))), F.lit(True))
    return out


def _guarded(df: DataFrame, source: DataFrame, n: int) -> DataFrame:
    """``df``, failing at run time where ``source`` has fewer than ``n`` rows (K3), also when ``df`` is empty: the check is a
    branch of its own that adds no row, not a filter on the rows."""
    bad = F.when(F.col("_n") < n, F.raise_error(F.concat(
        F.lit(f"cannot select {n} rows from "), F.col("_n").cast("string"), F.lit(" rows"))).cast("int"))
    check = source.agg(F.count(F.lit(1)).alias("_n")).where(bad.isNotNull())
    return df.unionByName(check.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields]))


def first_n(df: DataFrame, id_col: str, n: int, seed: int, rank_col: str = "rank") -> DataFrame:
    """The first ``n`` rows of the seeded shuffle with their 1-based rank; fewer than ``n`` rows raise (K3), also for an empty
    ``df``.  Only chosen rows are numbered, so other rows' texts don't ride through a sort.  Nested by construction:
    for one seed, ``first_n(k)`` is a prefix of ``first_n(k+1)``.  ``id_col`` must be unique."""
    out = first_n_by_seed(df, id_col, n, [seed], rank_col, "_seed_of")
    return out.drop("_seed_of")


def first_n_by_seed(df: DataFrame, id_col: str, n: int, seeds: list[int], rank_col: str = "rank",
                    seed_col: str = "seed") -> DataFrame:
    """``first_n`` for several seeds: rows are replicated per seed only when they are chosen."""
    require_columns(df, id_col)
    seeds = list(dict.fromkeys(int(s) for s in seeds))
    cuts = _cuts(df, id_col, n, seeds) if 0 < n <= BUCKET_ROWS and seeds else None
    if cuts is None:
        top = _ranked_ids(df, id_col, n, seeds).select("_cid", F.col("_seed").alias(seed_col), F.col("rank").alias(rank_col))
        out = df.join(top, F.col(id_col).eqNullSafe(F.col("_cid"))).drop("_cid")
        return _guarded(out, df, n)
    chosen = F.array_compact(F.array(*[F.when(cuts[s], F.lit(s)) for s in seeds]))
    out = df.withColumn(seed_col, F.explode(chosen))
    key = F.md5(F.concat(F.col(seed_col).cast("string"), F.lit(":"), F.col(id_col).cast("string")))
    w = Window.partitionBy(seed_col).orderBy(key, F.col(id_col))
    return out.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= n)


def carve(df: DataFrame, id_col: str, n: int, seed: int = 42, chosen: str = "validation",
          rest: str = "train", split_col: str = "split") -> DataFrame:
    """Label the first ``n`` rows of the seeded shuffle ``chosen`` and the rest ``rest``, for any ``n``: a projection of ``df`` that
    compares keys, after narrow passes over the ids (``_cuts``).

    Disjoint and exhaustive by construction (K16); fewer than ``n`` rows raise (K3) when the result is read, an empty ``df``
    included.  ``id_col`` must be unique; copies of an id get the same label.
    """
    require_columns(df, id_col)
    cuts = _cuts(df, id_col, n, [seed]) if n > 0 else {seed: F.lit(False)}
    if cuts is None:
        return _guarded(df.withColumn(split_col, F.lit(rest)), df, n)
    return df.withColumn(split_col, F.when(cuts[seed], F.lit(chosen)).otherwise(F.lit(rest)))


# J7 -------------------------------------------------------------------------------------------
def complement(df: DataFrame, chosen: DataFrame, id_col: str) -> DataFrame:
    """Rows of ``df`` whose id is not in ``chosen`` (left anti join)."""
    return df.join(chosen.select(id_col), id_col, "left_anti")


# A13 ------------------------------------------------------------------------------------------
def split_sizes(df: DataFrame, split_col: str = "split") -> DataFrame:
    return df.groupBy(split_col).agg(F.count(F.lit(1)).alias("n_rows"))
