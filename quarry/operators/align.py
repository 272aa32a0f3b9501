"""Keyed alignment of responses with references.

The reference pairs two lists by position; here both sides carry ``example_id`` and are joined on
it (sort-merge or broadcast, chosen by Catalyst/AQE from sizes).  A response list that is short or
has gaps is reported instead of silently mis-paired.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._check import require_columns


def _unique_references(references: DataFrame, key: str) -> DataFrame:
    """One row per reference id.  Copies of an id collapse map-side (a hot id never reaches the join
    as many rows); an id whose copies differ is an error, raised at run time."""
    cols = [c for c in references.columns if c != key]
    # null flags next to the values: Spark's hash skips NULLs, so (NULL, 'x') and ('x', NULL)
    # would otherwise hash alike
    content = F.xxhash64(*[x for c in cols for x in (F.col(c), F.col(c).isNull())]) if cols else F.lit(0)
    agg = references.groupBy(key).agg(
        F.count(F.lit(1)).alias("_copies"), F.min(content).alias("_lo"), F.max(content).alias("_hi"),
        *[F.first(c).alias(c) for c in cols])
    guard = F.when(F.col("_lo") != F.col("_hi"), F.raise_error(F.concat(
        F.lit(f"conflicting references for {key} "), F.col(key).cast("string"))))
    return agg.where(guard.isNull()).drop("_lo", "_hi")


def align_diagnostics(references: DataFrame, responses: DataFrame, key: str = "example_id") -> DataFrame:
    """Full outer join with presence flags: every id on either side, once per response.

    References are reduced to one row per id first (``_unique_references``), so the join is
    one-to-many (a reference and its responses / generations) and never emits pairs inside a group
    of copies.
    """
    require_columns(references, key)
    require_columns(responses, key)
    r = _unique_references(references, key).drop("_copies").withColumn("_has_ref", F.lit(True))
    p = responses.withColumn("_has_resp", F.lit(True))
    j = r.join(p, key, "full_outer")
    return (j.withColumn("has_reference", F.coalesce("_has_ref", F.lit(False)))
            .withColumn("has_response", F.coalesce("_has_resp", F.lit(False)))
            .drop("_has_ref", "_has_resp"))


def _unique_responses(responses: DataFrame, keys: list[str]) -> DataFrame:
    """Responses, one row per key; a repeated key is an error, raised at run time (it would count twice in every score)."""
    cols = [c for c in responses.columns if c not in keys]
    agg = responses.groupBy(*keys).agg(F.count(F.lit(1)).alias("_copies"), *[F.first(c).alias(c) for c in cols])
    name = F.concat_ws(", ", *[F.col(k).cast("string") for k in keys])
    guard = F.when(F.col("_copies") > 1, F.raise_error(F.concat(F.lit(f"several responses for {', '.join(keys)} "), name)))
    return agg.where(guard.isNull()).drop("_copies")


def align(references: DataFrame, responses: DataFrame, key: str = "example_id",
          on_missing: str = "raise", unique_responses: bool = False, generation: str = "gen_id") -> DataFrame:
    """One row per reference and response.  With ``unique_responses`` several responses for one reference (and
    ``generation``, where responses have that column) fail the job, as scores need.

    ``on_missing='raise'``: a reference without a response (or a response without a reference)
    fails the job.  ``on_missing='wrong'``: a missing response stays NULL (scored as wrong); a
    response without a reference still fails.
    """
    if on_missing not in ("raise", "wrong"):
        raise ValueError("on_missing must be 'raise' or 'wrong'")
    keys = [key, generation] if generation in responses.columns else [key]
    d = align_diagnostics(references, _unique_responses(responses, keys) if unique_responses else responses, key)
    orphan = ~F.col("has_reference")
    bad = orphan | ~F.col("has_response") if on_missing == "raise" else orphan
    guard = F.when(bad, F.raise_error(F.concat(F.lit(f"unaligned {key} "), F.col(key).cast("string"))))
    return d.where(guard.isNull()).drop("has_reference", "has_response")
