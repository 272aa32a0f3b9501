"""Run analytics: parameter grids (G1, G2), telemetry summaries (A11, A12), running peak and
progress (W4, W5), best run per sweep (A14) and seed aggregation (A15).

Running (ordered, cumulative) quantities are a prefix scan over a global range sort, so that no run, instant or
group of rows without a time — even one holding most rows — is ordered inside a single task: rows are cut into parts of
about equal size, totals (one row per run and part) give each part its carry-in, and the per-row window is
partitioned by (run, part).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.time import epoch_micros
from ..session import scratch_path
from ._check import join_null_safe, require_columns


# G1 / G2 --------------------------------------------------------------------------------------
def param_grid(spark: SparkSession, params: dict[str, list]) -> DataFrame:
    """Cartesian grid of parameter values, built by successive ``explode`` of literal arrays."""
    df = spark.range(1)
    for name, values in params.items():
        df = df.select("*", F.explode(F.array(*[F.lit(v) for v in values])).alias(name))
    return df.drop("id")


def grid_missing(grid: DataFrame, runs: DataFrame, metric: str | None = None) -> DataFrame:
    """Grid cells with no finished run.  With ``metric`` a run counts once its metric is not NULL
    (failed or unfinished runs leave the cell missing); without one, every listed run counts.
    Null-safe anti join on every grid column."""
    cols = grid.columns
    require_columns(runs, *cols, *([metric] if metric else []))
    done = (runs.where(F.col(metric).isNotNull()) if metric else runs).select(*cols).distinct()
    return join_null_safe(grid, done, cols, "left_anti")


def grid_coverage(grid: DataFrame, runs: DataFrame, metric: str) -> DataFrame:
    """Every grid cell with its number of finished runs (metric not NULL) and best (lowest) metric;
    0 / NULL when none finished."""
    cols = grid.columns
    require_columns(runs, *cols, metric)
    per_cell = runs.groupBy(*cols).agg(F.count(metric).alias("n_runs"), F.min(metric).alias(f"best_{metric}"))
    return (join_null_safe(grid, per_cell, cols, "left")
            .withColumn("n_runs", F.coalesce(F.col("n_runs"), F.lit(0).cast("long"))))


# A12 / A11 ------------------------------------------------------------------------------------
def poll_totals(telemetry: DataFrame, devices: list[int] | None = None, run: str = "run_id",
                ts: str = "poll_ts", device: str = "device", value: str = "used_mb") -> DataFrame:
    """Memory summed over the selected devices per (run, poll); a failed read (< 0) on any selected
    device makes the whole poll -1, as a failed poll reports."""
    require_columns(telemetry, run, ts, device, value)
    t = telemetry if devices is None else telemetry.where(F.col(device).isin(list(devices)))
    return t.groupBy(run, ts).agg(
        F.when(F.bool_or(F.col(value) < 0), F.lit(-1.0)).otherwise(F.sum(value)).alias(value))


def run_summary(polls: DataFrame, run: str = "run_id", ts: str = "poll_ts", value: str = "used_mb") -> DataFrame:
    """Per run: initial reading (first successful poll, else the first poll), peak, elapsed seconds
    between first and last poll, number of polls.  All aggregates are partial (map-side)."""
    require_columns(polls, run, ts, value)
    t = epoch_micros(polls, ts)  # as stored: no session-time-zone (DST) conversion
    ok_ts = F.when(F.col(value) >= 0, t)
    return polls.groupBy(run).agg(
        F.coalesce(F.min_by(value, ok_ts), F.min_by(value, t)).alias("initial_mb"),
        F.max(value).alias("peak_mb"),
        ((F.max(t) - F.min(t)) / 1e6).alias("elapsed_s"),
        F.count(F.lit(1)).alias("n_polls"),
    )


# W4 / W5 --------------------------------------------------------------------------------------
def _order(order: list[str]) -> list:
    return [F.col("_epoch_us").asc_nulls_last(), *[F.col(o).asc_nulls_last() for o in order], F.col("_tie")]


def _range_parts(df: DataFrame, run: str, order: list[str], partitions: int | None) -> DataFrame:
    """``df`` with ``_rkey``, ``_epoch_us``, ``_tie`` and the number ``_chunk`` of its range partition, written once: these numbers must
    not change between two readings."""
    spark = df.sparkSession
    c = df.select("*", F.struct(F.col(run).alias("r")).alias("_rkey"),
                  epoch_micros(df, order[0]).alias("_epoch_us")).withColumn("_tie", F.monotonically_increasing_id())
    along = [F.col("_rkey"), *_order(order)]
    parts = c.repartitionByRange(partitions, *along) if partitions else c.repartitionByRange(*along)
    parts = parts.withColumn("_chunk", F.spark_partition_id())
    path = scratch_path(spark, "running-parts")
    parts.write.parquet(path)
    return spark.read.schema(parts.schema).parquet(path)


def running_stats(df: DataFrame, run: str, order: list[str], value: str | None = None,
                  partitions: int | None = None) -> DataFrame:
    """Adds ``processed`` (rows so far, inclusive), ``total`` (rows in the run), ``pct`` and, with
    ``value``, ``running_peak`` (max so far) per run in ``order`` (first column a timestamp; NULLs
    last, as SQL engines order by default).

    A prefix scan over a global range sort: rows are range-partitioned by (run, time, other order columns, row), so
    parts are about equal whatever the skew: a run that holds most rows, one instant or rows without a time are cut like
    any others.  The parts are written once (their numbers must not change between the two readings); carry-ins come from a
    table with one row per run and part, and the ordered window only ever sees one run in one part.  The result does not
    depend on ``partitions`` (default: Spark's), nor, as rows are ordered by the epoch of the times as stored, on the session's
    time zone; rows that no order column tells apart come in any order.  The run key travels as ``struct(run)`` — never NULL itself,
    while a NULL run id inside it matches NULL — so the join to the carry-ins and the window share one
    hash partitioning.
    """
    require_columns(df, run, *order, *([value] if value else []))
    c = _range_parts(df, run, order, partitions)
    rk = ["_rkey"]
    aggs = [F.count(F.lit(1)).alias("_ccnt")] + ([F.max(value).alias("_cmax")] if value else [])
    chunks = c.groupBy(*rk, "_chunk").agg(*aggs)
    before = Window.partitionBy(*rk).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = chunks.select(
        *rk, "_chunk",
        F.coalesce(F.sum("_ccnt").over(before), F.lit(0)).alias("_prev_cnt"),
        F.sum("_ccnt").over(Window.partitionBy(*rk)).alias("total"),
        *([F.max("_cmax").over(before).alias("_prev_max")] if value else []))
    # the parsed time first, then every order column as given (ties)
    inside = Window.partitionBy(*rk, "_chunk").orderBy(*_order(order))
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    j = c.join(carry, [*rk, "_chunk"])
    out = j.withColumn("processed", F.col("_prev_cnt") + F.row_number().over(inside))
    if value:
        # greatest() skips NULLs: the first chunk of a run has no carry-in
        out = out.withColumn("running_peak", F.greatest(F.max(value).over(upto), F.col("_prev_max")))
    out = out.withColumn("pct", F.round(100.0 * F.col("processed") / F.col("total"), 2))
    return out.drop("_chunk", "_prev_cnt", "_prev_max", "_rkey", "_epoch_us", "_tie")


# A14 / A15 ------------------------------------------------------------------------------------
def best_run(runs: DataFrame, params: list[str], metric: str, sweep: list[str] | None = None) -> DataFrame:
    """Per sweep: the parameters of the finished run minimising ``metric`` (ties: smallest parameters)."""
    sweep = list(sweep or [])
    require_columns(runs, *params, metric, *sweep)
    key = F.struct(F.col(metric), *[F.col(p) for p in params])
    best = F.min_by(F.struct(*[F.col(p) for p in params], F.col(metric)), key)
    # runs without a metric (failed / unfinished) cannot be the best run
    finished = runs.where(F.col(metric).isNotNull())
    return finished.groupBy(*sweep).agg(best.alias("_b")).select(*sweep, "_b.*")


def seed_summary(runs: DataFrame, group_by: list[str], metric: str, seed: str = "seed") -> DataFrame:
    """Mean / sample stddev / min / max of ``metric`` over seeds, per configuration."""
    require_columns(runs, *group_by, metric, seed)
    return runs.groupBy(*group_by).agg(
        F.countDistinct(F.when(F.col(metric).isNotNull(), F.col(seed))).alias("n_seeds"),  # finished seeds
        F.avg(metric).alias(f"mean_{metric}"),
        F.stddev_samp(metric).alias(f"std_{metric}"),
        F.min(metric).alias(f"min_{metric}"),
        F.max(metric).alias(f"max_{metric}"),
    )
