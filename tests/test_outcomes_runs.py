"""Outcome metrics (A5-A8), telemetry (A11, A12, W4, W5), sweeps."""

import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from paths import SF01
from plan_util import plan_text
from quarry.operators import outcomes as OC
from quarry.operators import runs as RN
from quarry.plans import fixtures as fx


def _py_pass_at_k(n, c, k):
    if n - c < k:
        return 1.0
    return 1.0 - math.prod(1.0 - k / i for i in range(n - c + 1, n + 1))


def test_pass_at_k_estimator(spark):
    rows = [(n, c) for n in range(1, 8) for c in range(0, n + 1)]
    df = spark.createDataFrame(rows, "n long, c long")
    for k in (1, 2, 3):
        got = df.select("n", "c", OC.pass_at_k_estimate(F.col("n"), F.col("c"), k).alias("p")).collect()
        for r in got:
            assert r.p == pytest.approx(_py_pass_at_k(r.n, r.c, k), abs=1e-12)
            assert r.p == pytest.approx(1 - math.comb(r.n - r.c, k) / math.comb(r.n, k), abs=1e-12) if r.n >= k else True


def test_strict_not_above_average(spark):
    o = fx.outcomes(spark, SF01).where("gen_id = 0").withColumn("grp", F.lit("all"))
    r = OC.accuracy(o, ["grp"]).first()
    assert r.strict_accuracy <= r.avg_accuracy
    assert r.compile_errors >= 0 and r.n_problems == o.select("problem_id").distinct().count()


def test_pass_at_k_only_reports_valid_k(spark):
    o = fx.outcomes(spark, SF01)
    ks = sorted(r.k for r in OC.pass_at_k(o, ks=(1, 3, 10)).collect())
    assert ks == [1, 3]


def test_range_label_is_a_case_not_a_join(spark):
    o = fx.outcomes(spark, SF01)
    n = o.select((F.max("problem_id") + 1).alias("n")).scalar()
    lab = o.withColumn("d", OC.range_label("problem_id", OC.proportional_bounds(n, [("a", 0.0, 0.5), ("b", 0.5, 1.0)])))
    plan = plan_text(lab)
    assert "Join" not in plan and "CartesianProduct" not in plan
    assert lab.where("d is null").count() == 0


def test_running_stats_match_pandas_and_chunk_independent(spark):
    polls = RN.poll_totals(fx.telemetry(spark, SF01), [0, 1])
    a = RN.running_stats(polls, "run_id", ["poll_ts"], value="used_mb", partitions=1)
    b = RN.running_stats(polls, "run_id", ["poll_ts"], value="used_mb", partitions=5)
    key = lambda r: (r.run_id, r.poll_ts)
    ra = sorted(a.select("run_id", "poll_ts", "running_peak", "processed", "total").collect(), key=key)
    rb = sorted(b.select("run_id", "poll_ts", "running_peak", "processed", "total").collect(), key=key)
    assert ra == rb
    pdf = polls.toPandas().sort_values(["run_id", "poll_ts"])
    pdf["peak"] = pdf.groupby("run_id")["used_mb"].cummax()
    pdf["proc"] = pdf.groupby("run_id").cumcount() + 1
    exp = {(r.run_id, r.poll_ts): (r.peak, r.proc) for r in pdf.itertuples()}
    for r in ra:
        pk, pc = exp[(r.run_id, r.poll_ts)]
        assert r.running_peak == pytest.approx(pk) and r.processed == pc


def test_run_summary_excludes_failed_initial(spark):
    df = spark.createDataFrame(
        [(1, "2024-01-01 00:00:00", -1.0), (1, "2024-01-01 01:00:00", 5.0), (1, "2024-01-01 02:00:00", 9.0),
         (2, "2024-01-01 00:00:00", -1.0)], "run_id int, t string, used_mb double") \
        .withColumn("poll_ts", F.to_timestamp("t"))
    got = {r.run_id: r for r in RN.run_summary(df).collect()}
    assert got[1].initial_mb == 5.0 and got[1].peak_mb == 9.0 and got[1].elapsed_s == 7200.0
    assert got[2].initial_mb == -1.0 and got[2].n_polls == 1


def test_failed_device_makes_poll_fail(spark):
    df = spark.createDataFrame([(1, 0, 3.0), (1, 1, -1.0), (2, 0, 2.0), (2, 1, 4.0)],
                               "poll_ts int, device int, used_mb double").withColumn("run_id", F.lit(1))
    got = {r.poll_ts: r.used_mb for r in RN.poll_totals(df).collect()}
    assert got == {1: -1.0, 2: 6.0}


def test_grid_and_best_run(spark):
    grid = RN.param_grid(spark, {"lora_r": [8, 16, 32, 64], "lora_alpha": [16, 32, 64, 128]})
    assert grid.count() == 16 and "CartesianProduct" not in plan_text(grid)
    runs = fx.sweep_runs(spark, SF01)
    missing = [(r.lora_r, r.lora_alpha) for r in RN.grid_missing(grid, runs, "eval_loss").collect()]
    assert missing == [(64, 32)]  # cell index 13
    best = {r.seed: (r.lora_r, r.lora_alpha, r.eval_loss) for r in
            RN.best_run(runs, ["lora_r", "lora_alpha"], "eval_loss", sweep=["seed"]).collect()}
    by_seed = defaultdict(list)
    for r in runs.collect():
        by_seed[r.seed].append((r.eval_loss, r.lora_r, r.lora_alpha))
    for seed, vals in by_seed.items():
        loss, lr, la = min(vals)
        assert best[seed] == (lr, la, loss)


def test_best_run_ignores_unfinished_and_grid_is_null_safe(spark):
    runs = spark.createDataFrame([(8, 16, 42, None), (16, 32, 42, 0.5), (32, 64, 42, 0.7)],
                                 "lora_r int, lora_alpha int, seed int, eval_loss double")
    best = RN.best_run(runs, ["lora_r", "lora_alpha"], "eval_loss", sweep=["seed"]).first()
    assert (best.lora_r, best.lora_alpha, best.eval_loss) == (16, 32, 0.5)
    grid = spark.createDataFrame([("none", None), ("icl", 42)], "strategy string, seed int")
    done = spark.createDataFrame([("none", None, 0.1)], "strategy string, seed int, m double")
    assert [(r.strategy, r.seed) for r in RN.grid_missing(grid, done, "m").collect()] == [("icl", 42)]
    cov = {(r.strategy, r.seed): r.n_runs for r in RN.grid_coverage(grid, done, "m").collect()}
    assert cov == {("none", None): 1, ("icl", 42): 0}


def test_run_summary_accepts_epoch_seconds(spark):
    df = spark.createDataFrame([(1, 0, 1.0), (1, 3600, 2.0)], "run_id int, poll_ts long, used_mb double")
    r = RN.run_summary(df).first()
    assert r.elapsed_s == 3600.0 and r.peak_mb == 2.0


def test_running_stats_keeps_null_timestamps(spark):
    df = spark.createDataFrame([(1, "2024-01-01 00:00:00", 1.0), (1, None, 2.0), (1, "2024-01-01 01:00:00", 3.0)],
                               "run_id int, t string, used_mb double").withColumn("ts", F.to_timestamp("t"))
    out = RN.running_stats(df, "run_id", ["ts"], value="used_mb").collect()
    assert len(out) == 3 and {r.total for r in out} == {3}
    # NULL timestamps come last, as SQL engines order them by default
    assert {r.t: r.processed for r in out} == {"2024-01-01 00:00:00": 1, "2024-01-01 01:00:00": 2, None: 3}


def test_chunks_follow_stored_order_across_dst(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.createDataFrame([(1, "2024-03-10 01:30:00", 5.0), (1, "2024-03-10 02:30:00", 1.0),
                                    (1, "2024-03-10 03:10:00", 2.0)], "run_id int, t string, used_mb double") \
            .withColumn("ts", F.to_timestamp_ntz("t"))
        res = []
        for chunk in (1, 3):
            rows = RN.running_stats(df, "run_id", ["ts"], value="used_mb", partitions=chunk).orderBy("ts").collect()
            res.append([(r.processed, r.running_peak) for r in rows])
        assert res[0] == res[1] == [(1, 5.0), (2, 5.0), (3, 5.0)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_unfinished_runs_do_not_count(spark):
    runs = spark.createDataFrame([(16, 32, 42, 0.5), (16, 32, 7, None), (8, 16, 42, None)],
                                 "lora_r int, lora_alpha int, seed int, eval_loss double")
    s = {(r.lora_r, r.lora_alpha): r.n_seeds for r in RN.seed_summary(runs, ["lora_r", "lora_alpha"], "eval_loss").collect()}
    assert s == {(16, 32): 1, (8, 16): 0}
    grid = RN.param_grid(spark, {"lora_r": [8, 16], "lora_alpha": [16, 32]})
    missing = sorted((r.lora_r, r.lora_alpha) for r in RN.grid_missing(grid, runs, "eval_loss").collect())
    assert missing == [(8, 16), (8, 32), (16, 16)]
    cov = {(r.lora_r, r.lora_alpha): r.n_runs for r in RN.grid_coverage(grid, runs, "eval_loss").collect()}
    assert cov[(8, 16)] == 0 and cov[(16, 32)] == 1


def test_time_columns_of_any_stored_type(spark):
    base = [(1, "2024-01-01 00:00:00", 1.0), (1, "2024-01-01 02:00:00", 3.0)]
    df = spark.createDataFrame(base, "run_id int, t string, used_mb double")
    for col in (F.col("t"), F.to_timestamp_ntz("t"), F.to_timestamp("t")):
        r = RN.run_summary(df.withColumn("poll_ts", col)).first()
        assert r.elapsed_s == 7200.0
    d = spark.createDataFrame([(1, "2024-01-01", 1.0), (1, "2024-01-03", 2.0)], "run_id int, t string, used_mb double")
    assert RN.run_summary(d.withColumn("poll_ts", F.to_date("t"))).first().elapsed_s == 2 * 86400.0
    old = spark.conf.get("spark.sql.timestampType")
    spark.conf.set("spark.sql.timestampType", "TIMESTAMP_NTZ")
    try:
        r = RN.run_summary(df.withColumn("poll_ts", F.to_timestamp_ntz("t"))).first()
        assert r.elapsed_s == 7200.0
    finally:
        spark.conf.set("spark.sql.timestampType", old)


def test_running_stats_single_row_shuffle_when_not_broadcast(spark):
    polls = RN.poll_totals(fx.telemetry(spark, SF01), [0, 1])
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_text(RN.running_stats(polls, "run_id", ["poll_ts"], value="used_mb"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    lines = plan.split("== Physical Plan ==")[-1].splitlines()
    win = next(i for i, ln in enumerate(lines) if "Window [row_number()" in ln)
    smj = next(i for i, ln in enumerate(lines) if "SortMergeJoin" in ln)
    # the per-chunk window runs on the join's partitioning: no exchange between them
    assert win < smj and not any("Exchange" in ln for ln in lines[win:smj])
    # the rows are exchanged once, directly under the join (the other exchanges move the small
    # per-(run, chunk) carry table)
    assert "Exchange hashpartitioning(_rkey" in lines[smj + 1] or "Exchange hashpartitioning(_rkey" in lines[smj + 2]


def test_running_stats_key_and_time_edge_cases(spark):
    # -0.0 and 0.0 are one run (as for groupBy); NULL run ids form their own run
    df = spark.createDataFrame([(0.0, 1, 1.0), (-0.0, 2, 2.0), (None, 3, 3.0)], "run_id double, t long, used_mb double")
    out = {(r.run_id is None, r.t): (r.processed, r.total) for r in RN.running_stats(df, "run_id", ["t"]).collect()}
    assert out == {(False, 1): (1, 2), (False, 2): (2, 2), (True, 3): (1, 1)}
    # time as text: epoch seconds or wall clocks; unparsable text is processed last, not an error
    s = spark.createDataFrame([(1, "1704067200"), (1, "1704070800"), (1, "")], "run_id int, t string")
    got = {r.t: r.processed for r in RN.running_stats(s, "run_id", ["t"]).collect()}
    assert got == {"1704067200": 1, "1704070800": 2, "": 3}
    w = spark.createDataFrame([(1, "2024-01-01 9:00:00"), (1, "2024-01-01 10:00:00"), (1, "2024-01-01 10:30:00")],
                              "run_id int, t string")
    for chunk in (1, 3):
        got = {r.t: r.processed for r in RN.running_stats(w, "run_id", ["t"], partitions=chunk).collect()}
        assert got == {"2024-01-01 9:00:00": 1, "2024-01-01 10:00:00": 2, "2024-01-01 10:30:00": 3}


def test_time_edge_values(spark):
    # several raw values in one microsecond keep their raw order; NaN / inf / junk are processed last
    d = spark.createDataFrame([(1, 1.00000005), (1, 1.0000001), (1, 1.0000002), (1, 1.0000003)], "run_id int, t double")
    got = [r.processed for r in RN.running_stats(d, "run_id", ["t"]).orderBy("t").collect()]
    assert got == [1, 2, 3, 4]
    s = spark.createDataFrame([(1, "1704067200"), (1, "NaN"), (1, "inf"), (1, "20240101093000")], "run_id int, t string")
    got = {r.t: r.processed for r in RN.running_stats(s, "run_id", ["t"]).collect()}
    assert got["1704067200"] == 1 and sorted(got.values()) == [1, 2, 3, 4]
    # an explicit zone in the text is honoured: 08:00Z happened before 09:00Z
    z = spark.createDataFrame([(1, "2024-01-01T10:00:00+02:00"), (1, "2024-01-01T09:00:00Z")], "run_id int, poll_ts string") \
        .withColumn("used_mb", F.lit(1.0))
    assert RN.run_summary(z).first().elapsed_s == 3600.0
    got = {r.poll_ts: r.processed for r in RN.running_stats(z, "run_id", ["poll_ts"]).collect()}
    assert got == {"2024-01-01T10:00:00+02:00": 1, "2024-01-01T09:00:00Z": 2}


def test_hot_runs_instants_and_rows_without_time_are_spread(spark):
    """Nine tenths of the rows lie in one second, a tenth of these in one instant; others have no time at all."""
    base = spark.range(20_000)
    hour = base.select(F.lit(1).alias("run_id"), F.timestamp_micros(F.lit(1_704_067_200_000_000) + F.when(F.col("id") < 200, F.col("id") * 150_000_000)
                       .when(F.col("id") % 10 == 0, 30_000_000_000).otherwise(30_000_000_000 + F.col("id"))).alias("ts"),
                       F.col("id").alias("n"), (F.col("id") % 977).cast("double").alias("used_mb"))
    bare = base.select(F.lit(2).alias("run_id"), F.lit(None).cast("timestamp").alias("ts"), F.col("id").alias("n"), F.col("id").cast("double").alias("used_mb"))
    both = hour.unionByName(bare)
    sizes = [r["count"] for r in RN._range_parts(both, "run_id", ["ts"], 8).groupBy("_chunk").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * 40_000 / 8
    out = RN.running_stats(both, "run_id", ["ts", "n"], value="used_mb", partitions=8)
    for run in (1, 2):
        got = out.where(F.col("run_id") == run).orderBy(F.col("ts").asc_nulls_last(), "n").select("processed", "total", "running_peak", "used_mb").collect()
        assert [r.processed for r in got] == list(range(1, 20_001)) and {r.total for r in got} == {20_000}
        peak = 0.0
        for r in got:
            peak = max(peak, r.used_mb)
            assert r.running_peak == peak
    tied = RN.running_stats(both, "run_id", ["ts"], partitions=8)  # without the second order column ties come in any order
    assert sorted(r.processed for r in tied.where("run_id = 2").collect()) == list(range(1, 20_001))
