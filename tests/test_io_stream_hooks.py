"""Round trips (S2-S8), the telemetry stream (X4) and the model hooks."""

import json
import os
import tempfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from paths import SF01
from plan_util import plan_text
from quarry.operators import hooks as HK
from quarry.operators import runs as RN
from quarry.plans import fixtures as fx
from quarry.session import scratch_path
from quarry.sources import files as IO
from quarry.streaming import telemetry as ST


def _local(path: str) -> str:
    """A ``file:`` URI (scratch paths follow the checkpoint directory) as a local path."""
    return path[len("file:"):] if path.startswith("file:") else path


def test_prepared_roundtrip_prunes_partitions(spark):
    p = fx.pairs(spark, SF01)
    path = scratch_path(spark, "t-prepared")
    IO.save_prepared(p, path)
    test = IO.load_prepared(spark, path, "test")
    assert test.count() == p.where("split = 'test'").count()
    plan = plan_text(test)
    assert "PartitionFilters: [isnotnull(split" in plan and "(split#" in plan


def test_load_corpus_tags_split(spark):
    df = IO.load_corpus(spark, f"{SF01}/benchmark.parquet", split="test")
    assert df.select("split").distinct().collect()[0].split == "test"
    assert df.count() == spark.read.parquet(f"{SF01}/benchmark.parquet").count()


def test_legacy_response_list_import(spark):
    d = tempfile.mkdtemp(prefix="quarry-test-")
    data = [["first\nline"], ["second"], ["third", "alt"]]
    with open(os.path.join(d, "responses_x.json"), "w") as f:
        json.dump(data, f)
    got = sorted((r.example_id, r.gen_id, r.response) for r in IO.read_response_lists(spark, d).collect())
    assert got == [(0, 0, "first\nline"), (1, 0, "second"), (2, 0, "third"), (2, 1, "alt")]


def test_responses_keyed_roundtrip_and_preview(spark):
    r = fx.responses(spark, SF01).select("example_id", F.col("raw").alias("response"))
    path = scratch_path(spark, "t-responses")
    IO.write_responses(r, path, fmt="json")
    back = spark.read.json(path)
    assert back.count() == r.count()
    prev = IO.preview(back, 300).collect()
    assert [x.example_id for x in prev] == sorted(x.example_id for x in prev)
    assert all(x.example_id < 300 for x in prev)


def test_export_aligned_lines(spark):
    p = fx.pairs(spark, SF01)
    path = scratch_path(spark, "t-export")
    IO.export_aligned_text(p, path, {"predictions": "prediction", "references": "reference"}, parts=5)
    def lines(kind):
        out = []
        for name in sorted(os.listdir(os.path.join(_local(path), f"kind={kind}"))):
            if name.startswith("part-"):
                with open(os.path.join(_local(path), f"kind={kind}", name), encoding="utf-8") as f:
                    out += f.read().split("\n")[:-1]
        return out
    pred, ref = lines("predictions"), lines("references")
    exp = sorted((r.example_id, r.prediction, r.reference) for r in p.collect())
    esc = lambda s: s.replace("\\", "\\\\").replace("\n", "\\n").replace("\r", "\\r")
    assert pred == [esc(x[1]) for x in exp]
    assert ref == [esc(x[2]) for x in exp]


def test_run_outputs_layout_and_tall_metrics(spark):
    df = spark.createDataFrame([("m", "conala", 0.2, "icl", 3, 42, 0.5, 0.25)],
                               "model string, dataset string, temperature double, strategy string, n int, seed int, "
                               "em double, chrf double")
    tall = IO.to_tall(df, IO.RUN_ADDRESS, ["em", "chrf"])
    assert sorted((r.metric, r.value) for r in tall.collect()) == [("chrf", 0.25), ("em", 0.5)]
    path = scratch_path(spark, "t-runs")
    IO.write_run_outputs(tall, path)
    IO.write_run_outputs(tall, path)  # a rerun rewrites its own run, no duplicates
    assert os.path.isdir(os.path.join(_local(path), "model=m", "dataset=conala", "temperature=0.20", "strategy=icl",
                                      "n=3", "seed=42"))
    other = tall.withColumn("model", F.lit("m2"))
    IO.write_run_outputs(other, path)  # another run leaves the first one alone
    assert spark.read.parquet(path).count() == 4
    assert df.select(IO.format_with_unit("em", "MB").alias("x")).first().x == "0.5 MB"


def test_write_metrics_json(spark):
    df = spark.createDataFrame([("conala", "chrf", 56.85), ("conala", "exact_match", 0.35)],
                               "dataset string, metric string, value double")
    path = scratch_path(spark, "t-metrics")
    IO.write_metrics(df, path, partition_by=["dataset"])
    back = {r.metric: r.value for r in spark.read.json(path).collect()}
    assert back == {"chrf": 56.85, "exact_match": 0.35}


def test_stream_equals_batch(spark):
    polls = RN.poll_totals(fx.telemetry(spark, SF01), [0, 1]).select(
        F.col("run_id").cast("long").alias("run_id"), F.col("poll_ts").cast("timestamp").alias("poll_ts"), "used_mb")
    staged = scratch_path(spark, "t-polls")
    # files cut by time: every run has polls in several files, so its state is merged across
    # micro-batches (one file per trigger), including runs whose first successful poll comes later
    polls.repartitionByRange(4, "poll_ts").write.parquet(staged)
    query, out = ST.run_summary_stream(spark, staged, max_files_per_trigger=1)
    query.awaitTermination()
    streamed = sorted(tuple(r) for r in spark.read.parquet(out).select(
        "run_id", "initial_mb", "peak_mb", "elapsed_s", "n_polls").collect())
    batch = sorted(tuple(r) for r in RN.run_summary(polls).select(
        "run_id", "initial_mb", "peak_mb", "elapsed_s", "n_polls").collect())
    assert len(streamed) == len(batch)
    for a, b in zip(streamed, batch):
        assert a[0] == b[0] and a[4] == b[4]
        assert a[1] == pytest.approx(b[1]) and a[2] == pytest.approx(b[2]) and a[3] == pytest.approx(b[3])


def _readings(spark, rows):
    """(run, minutes, device, value) as readings."""
    df = spark.createDataFrame(rows, "run_id long, m long, device int, used_mb double")
    return df.select("run_id", F.timestamp_seconds(F.col("m") * 60 + 1_700_000_000).alias("poll_ts"), "device", "used_mb").coalesce(1)


def _sessions(df):
    return sorted((r["run_id"], (r["first_poll"].timestamp() - 1_700_000_000) // 60, r["initial_mb"], r["peak_mb"], r["elapsed_s"] / 60, r["n_polls"])
                  for r in df.collect())


def test_session_stream_lateness_end_and_restart(spark):
    src, out, ckpt = (scratch_path(spark, x) for x in ("t-readings", "t-sessions", "t-sessions-ckpt"))
    seen = []

    def more(rows):
        _readings(spark, rows).write.mode("append").parquet(src)
        q = ST.run_sessions_stream(spark, src, out, ckpt, gap="60 minutes", lateness="10 minutes")  # a restart each time
        q.awaitTermination()
        seen.append([o["numRowsTotal"] for o in q.lastProgress["stateOperators"]])
        return _sessions(spark.read.schema("run_id long, first_poll timestamp, initial_mb double, peak_mb double, elapsed_s double, "
                                           "n_polls long").parquet(out))

    # two devices per poll are summed, a failed one makes its poll -1; the session is open, so nothing is emitted
    assert more([(1, 0, 0, -1.0), (1, 0, 1, 5.0), (1, 5, 0, 2.0), (1, 5, 1, 3.0), (2, 6, 0, 1.0), (1, 20, 0, 1.0)]) == []
    # the watermark stands at 10: a reading of minute 9 is late and dropped, one of minute 12 counts, in the session still open
    assert more([(1, 9, 0, 99.0), (1, 12, 0, 7.0), (3, 30, 0, 1.0)]) == []
    # at 300 all earlier runs have ended; run 1 goes on as a new session
    first = [(1, 0, 5.0, 7.0, 20, 4), (2, 6, 1.0, 1.0, 0, 1), (3, 30, 1.0, 1.0, 0, 1)]
    assert more([(1, 300, 0, 4.0)]) == first
    # a heartbeat and a reading without a time: the last session ends and no state is left
    assert more([(None, 5000, None, None), (4, None, 0, 1.0)]) == sorted([*first, (1, 300, 4.0, 4.0, 0, 1)])
    assert sum(seen[0]) > 0 and sum(seen[-1]) == 0


def test_session_stream_equals_table(spark):
    t = fx.telemetry(spark, SF01)
    r = t.select(F.col("run_id").cast("long").alias("run_id"), F.col("poll_ts").cast("timestamp").alias("poll_ts"), "device", "used_mb")
    # a run that holds most rows, and one without polls but failed ones
    r = r.withColumn("run_id", F.when(F.col("run_id") < 14, 1).otherwise(F.col("run_id")))
    r = r.withColumn("used_mb", F.when(F.col("run_id") == 15, -1.0).otherwise(F.col("used_mb")))
    hi = r.agg(F.max("poll_ts")).first()[0]
    beat = spark.createDataFrame([(None, hi + pd.Timedelta(days=9).to_pytimedelta(), 0, 0.0)], r.schema)
    src, out, ckpt = (scratch_path(spark, x) for x in ("t-readings", "t-sessions", "t-sessions-ckpt"))
    r.unionByName(beat).write.parquet(src)
    ST.run_sessions_stream(spark, src, out, ckpt, gap="3 hours", devices=[0, 1]).awaitTermination()
    got, want = _sessions(spark.read.parquet(out)), _sessions(ST.run_sessions(r, "3 hours", devices=[0, 1]))
    assert len(want) > 10
    assert [(*g[:2], *np.round(g[2:], 6)) for g in got] == [(*w[:2], *np.round(w[2:], 6)) for w in want]


def test_generate_hook(spark):
    # nested callables are pickled by value, so workers need not import this test module
    def _upper(s: pd.Series) -> pd.Series:
        return s.str.upper()
    df = spark.createDataFrame([(1, "ab"), (2, "c")], "i int, prompt string")
    first = HK.generate_with(df, _upper)
    assert {r.i: r.response for r in first.collect()} == {1: "AB", 2: "C"}
    again = HK.generate_with(first, lambda s: s.str.lower())  # replaces the earlier response
    assert again.columns == ["i", "prompt", "response"]
    assert {r.i: r.response for r in again.collect()} == {1: "ab", 2: "c"}


def test_embed_hook_unit_norm(spark):
    def _lens(s: pd.Series):
        return np.stack([s.str.len().to_numpy(float), np.ones(len(s))], axis=1)
    df = spark.createDataFrame([(1, "abc"), (2, "")], "i int, text string")
    out = {r.i: r.embedding for r in HK.embed_with(df, _lens).collect()}
    assert np.linalg.norm(out[1]) == pytest.approx(1.0, abs=1e-6)
    assert out[2] == pytest.approx([0.0, 1.0])


def test_checkpoint_dir_follows_the_context(spark):
    from quarry.session import ensure_checkpoint_dir
    assert ensure_checkpoint_dir(spark) == spark.sparkContext.getCheckpointDir()
    assert scratch_path(spark, "x").startswith(spark.sparkContext.getCheckpointDir())
