"""Test-outcome metrics by difficulty.

Input: one row per (problem, generation, test) with a status: -2 compile error, -1 runtime error,
0 (or False) failed, > 0 (or True) passed.  Everything is two partial-aggregated group-bys
(per generation, then per difficulty); a problem holding a third of all rows is pre-aggregated
map-side and never gathered into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._check import require_columns


# J6 / L5 --------------------------------------------------------------------------------------
def range_label(pos, bounds: list[tuple[str, object, object]]) -> Column:
    """Label of the half-open range ``[lo, hi)`` containing ``pos``; NULL outside all ranges.

    The bound list is small and fixed per call (three APPS slices), so the range join compiles to a
    CASE expression — no join operator, no nested loop.  Bounds may be numbers or Columns (e.g.
    scalar subqueries).
    """
    p = F.col(pos) if isinstance(pos, str) else pos
    expr = None
    for label, lo, hi in bounds:
        cond = (p >= lo) & (p < hi)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr


def proportional_bounds(n: Column, fractions: list[tuple[str, float, float]]) -> list[tuple[str, Column, Column]]:
    return [(label, n * lo, n * hi) for label, lo, hi in fractions]


# per-generation summary -----------------------------------------------------------------------
def generation_summary(outcomes: DataFrame, problem: str = "problem_id", generation: str = "gen_id",
                       status: str = "status", group_by: list[str] | None = None) -> DataFrame:
    """One row per (problem, generation): share of passed tests, all passed, any compile/runtime error."""
    require_columns(outcomes, problem, generation, status, *(group_by or []))
    s = F.col(status).cast("int")
    return outcomes.groupBy(*(group_by or []), problem, generation).agg(
        F.avg(F.when(s > 0, F.lit(1.0)).otherwise(F.lit(0.0))).alias("pass_share"),
        # a test without a status has not passed
        F.bool_and(F.coalesce(s > 0, F.lit(False))).alias("all_pass"),
        F.bool_or(F.coalesce(s == -2, F.lit(False))).alias("compile_error"),
        F.bool_or(F.coalesce(s == -1, F.lit(False))).alias("runtime_error"),
    )


# A5 / A6 / A7 ---------------------------------------------------------------------------------
def accuracy(outcomes: DataFrame, group_by: list[str], problem: str = "problem_id",
             generation: str = "gen_id", status: str = "status") -> DataFrame:
    """Accuracy per group over all (problem, generation) rows: average accuracy (mean share of passed tests), strict
    accuracy (share passing every test) and compile/runtime error counts and rates.  With one generation per
    problem these are the single-generation figures."""
    g = generation_summary(outcomes, problem, generation, status, group_by)
    n = F.count(F.lit(1))
    return g.groupBy(*group_by).agg(
        F.avg("pass_share").alias("avg_accuracy"),
        F.avg(F.col("all_pass").cast("double")).alias("strict_accuracy"),
        F.sum(F.col("compile_error").cast("long")).alias("compile_errors"),
        F.sum(F.col("runtime_error").cast("long")).alias("runtime_errors"),
        (F.sum(F.col("compile_error").cast("double")) / n).alias("compile_error_rate"),
        (F.sum(F.col("runtime_error").cast("double")) / n).alias("runtime_error_rate"),
        n.alias("n_generations"),
        F.countDistinct(problem).alias("n_problems"),
    )


# A8 -------------------------------------------------------------------------------------------
def pass_at_k_estimate(n: Column, c: Column, k: int) -> Column:
    """Unbiased pass@k = 1 - C(n-c, k) / C(n, k) = 1 - prod_{i=n-c+1..n} (1 - k / i); 1 when n-c < k."""
    prod = F.aggregate(
        F.when(c >= 1, F.sequence(n - c + 1, n)).otherwise(F.array().cast("array<bigint>")),
        F.lit(1.0), lambda acc, i: acc * (F.lit(1.0) - F.lit(float(k)) / i.cast("double")))
    return F.when(n - c < k, F.lit(1.0)).otherwise(F.lit(1.0) - prod)


def pass_at_k(outcomes: DataFrame, ks=(1, 10, 100), group_by: list[str] | None = None,
              problem: str = "problem_id", generation: str = "gen_id", status: str = "status") -> DataFrame:
    """Mean pass@k per group, one row per (group, k); a k is reported only when every problem in
    the group has at least k generations.  A generation passes when all its tests pass."""
    group_by = list(group_by or [])
    g = generation_summary(outcomes, problem, generation, status, group_by)
    per_problem = g.groupBy(*group_by, problem).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("all_pass").cast("long")).alias("c"))
    ks_col = F.explode(F.array(*[F.lit(int(k)) for k in ks])).alias("k")
    est = per_problem.select(*group_by, "n", "c", ks_col)
    # one estimator per literal k keeps the aggregate expression constant-folded
    pk = None
    for k in ks:
        e = F.when(F.col("k") == k, pass_at_k_estimate(F.col("n"), F.col("c"), int(k)))
        pk = e if pk is None else F.coalesce(pk, e)
    res = est.withColumn("_p", pk).groupBy(*group_by, "k").agg(
        F.avg("_p").alias("pass_at_k"), F.min("n").alias("min_n"))
    return res.where(F.col("min_n") >= F.col("k")).drop("min_n")
