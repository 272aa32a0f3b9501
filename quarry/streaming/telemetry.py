"""Incremental run telemetry (X4) with Structured Streaming.

Two streams are offered.  ``run_sessions_stream`` reads device readings, sums them per poll (A12) and summarises polls per run
(A11) in one query of two chained stateful operators; its state ends with the run, and its sink is append-only.
``run_summary_stream`` publishes a summary of all runs so far after every trigger, as described below.

Poll rows (run, poll time, memory summed over devices) arrive as files; the stream keeps one state
row per run (first successful reading, peak, first/last poll time, poll count) and publishes the
A11 summary.  State is bounded by the number of runs.  The device sum (A12) happens upstream — the
producer of a poll already sums its devices — because two chained aggregations are not allowed in
complete mode.

Sink: ``foreachBatch`` overwrites a parquet table under the shared checkpoint folder with the
complete result of each micro-batch (idempotent per batch id, so a retried batch rewrites the same
rows).  The stream's checkpoint lives there too, so a restarted query resumes where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

POLL_SCHEMA = "run_id bigint, poll_ts timestamp, used_mb double"


def summary_stream(polls: DataFrame) -> DataFrame:
    """Streaming A11 over a poll stream (``poll_ts`` must be TIMESTAMP, not TIMESTAMP_NTZ).

    State is one row per run and is kept for the life of the query: a run has no end that the stream could see, and a late
    poll still counts.  The published table holds every run, so the output mode is complete and a watermark would do nothing.
    """
    ok_ts = F.when(F.col("used_mb") >= 0, F.col("poll_ts"))
    return (polls.groupBy("run_id")
            .agg(F.min_by("used_mb", ok_ts).alias("_initial_ok"),
                 F.min_by("used_mb", F.col("poll_ts")).alias("_initial_any"),
                 F.max("used_mb").alias("peak_mb"),
                 F.min("poll_ts").alias("_first"), F.max("poll_ts").alias("_last"),
                 F.count(F.lit(1)).alias("n_polls")))


def finish_summary(state: DataFrame) -> DataFrame:
    return state.select(
        "run_id",
        F.coalesce("_initial_ok", "_initial_any").alias("initial_mb"),
        "peak_mb",
        ((F.unix_micros("_last") - F.unix_micros("_first")) / 1e6).alias("elapsed_s"),  # instants
        "n_polls")


def run_summary_stream(spark: SparkSession, source_dir: str, out_dir: str | None = None,
                       checkpoint_dir: str | None = None,
                       available_now: bool = True, max_files_per_trigger: int | None = None):
    """Start the stream over parquet poll files in ``source_dir``; returns (query, out_dir).

    With ``available_now`` the query processes every file present and stops (batch-like catch-up);
    otherwise it keeps running and the caller owns ``query.stop()``.  Each trigger overwrites the table in ``out_dir``; read
    it between triggers, or after the query has ended.
    """
    out_dir = out_dir or scratch_path(spark, "telemetry-summary")
    checkpoint_dir = checkpoint_dir or scratch_path(spark, "telemetry-ckpt")
    reader = spark.readStream.schema(POLL_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    polls = reader.parquet(source_dir)
    state = summary_stream(polls)

    def publish(batch: DataFrame, batch_id: int) -> None:
        finish_summary(batch).write.mode("overwrite").parquet(out_dir)

    writer = (state.writeStream.outputMode("complete").foreachBatch(publish)
              .option("checkpointLocation", checkpoint_dir))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start(), out_dir


READING_SCHEMA = "run_id bigint, poll_ts timestamp, device int, used_mb double"


def run_sessions(readings: DataFrame, gap: str, lateness: str | None = None, devices: list[int] | None = None) -> DataFrame:
    """A12 and A11 over device readings, one row per session of a run; the same plan for a table and for a stream.

    A session is a stretch of a run's polls in which none follows the one before by more than ``gap``: a run that is silent for longer
    has ended, and one that goes on later is a new session.  ``(run_id, first_poll, initial_mb, peak_mb, elapsed_s, n_polls)``.

    As a stream (``lateness`` given) a poll is summed once the watermark, the latest time seen less ``lateness``, has passed it, and a
    session is emitted, and its state dropped, once the watermark has passed its last poll by ``gap``.  A reading older than the
    watermark is dropped, also if its session is still open.  State is therefore bounded by the polls within ``lateness`` and the
    sessions within ``lateness + gap``, not by the number of runs ever seen.

    A failed reading (< 0) makes its poll -1, as in ``poll_totals``.  Readings without a run or a time take no part (a row without a
    run still moves the watermark: a heartbeat that lets the last runs end).
    """
    if lateness is not None:
        readings = readings.withWatermark("poll_ts", lateness)
    counts = [F.col("poll_ts").isNotNull(), F.col("run_id").isNotNull()]
    if devices is not None:
        counts.append(F.col("device").isin(list(devices)))
    # one predicate that names the event time: as a conjunction its other parts would be pushed below the watermark, where
    # heartbeats would be lost before they move it
    r = readings.where(F.forall(F.array(*counts), lambda ok: ok))
    polls = r.groupBy("run_id", "poll_ts").agg(
        F.when(F.bool_or(F.col("used_mb") < 0), F.lit(-1.0)).otherwise(F.sum("used_mb")).alias("used_mb"))
    ok_ts = F.when(F.col("used_mb") >= 0, F.col("poll_ts"))
    return (polls.groupBy("run_id", F.session_window("poll_ts", gap).alias("_session"))
            .agg(F.coalesce(F.min_by("used_mb", ok_ts), F.min_by("used_mb", F.col("poll_ts"))).alias("initial_mb"),
                 F.max("used_mb").alias("peak_mb"), F.min("poll_ts").alias("first_poll"), F.max("poll_ts").alias("_last"),
                 F.count(F.lit(1)).alias("n_polls"))
            .select("run_id", "first_poll", "initial_mb", "peak_mb",
                    ((F.unix_micros("_last") - F.unix_micros("first_poll")) / 1e6).alias("elapsed_s"), "n_polls"))


def run_sessions_stream(spark: SparkSession, source_dir: str, out_dir: str, checkpoint_dir: str, gap: str = "6 hours",
                        lateness: str = "1 hour", devices: list[int] | None = None, available_now: bool = True,
                        max_files_per_trigger: int | None = None):
    """Start ``run_sessions`` over parquet files of readings in ``source_dir``; returns the query.

    Files are read in the order of their modification times.  Sessions are appended to parquet files in ``out_dir``, whose log names the
    files of every finished batch: a reader sees whole batches only, and a batch that is repeated after a failure counts once.  Started
    again with the same three folders, the query goes on where it stopped.
    """
    reader = spark.readStream.schema(READING_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    sessions = run_sessions(reader.parquet(source_dir), gap, lateness, devices)
    writer = (sessions.writeStream.format("parquet").outputMode("append").option("path", out_dir)
              .option("checkpointLocation", checkpoint_dir))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()
