"""Registered queries: one Spark builder per SURVEY section 7.3 entry (the DuckDB oracle SQL for
each lives in ``oracle.py``).

Every builder reads whole tables under ``sf_dir`` (through the fixture views) and returns a flat
DataFrame; column names match the oracle's.  Floating results are rounded in both engines.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import FENCE_STOP, ICL_SEEDS, ICL_SIZES, INSTRUCTION_PREFIX, SWEEP_GRID
from ..functions.time import as_instant
from ..functions.text import (completion_span, contains_any, earliest_stop, fence_cut, json_first_element,
                              json_truthy_field, render_cut, render_messages, stop_truncate)
from ..operators import align as AL
from ..operators import fewshot as FS
from ..operators import hooks as HK
from ..operators import late_interaction as LI
from ..operators import metrics as M
from ..operators import outcomes as OC
from ..operators import prompt as PR
from ..operators import retrieve as RT
from ..operators import runs as RN
from ..operators import sample as SA
from ..session import scratch_path
from ..sources import files as IO
from ..streaming import telemetry as ST
from . import fixtures as fx
from . import workflows as WF

# query parameters (fixed per registered query)
CARVE_N = 100
ICL_N = 3
ICL_SEED = 42
SESSION_GAP = "6 hours"
KNN_K = 5
KNN_BLOCK = 4096
RERANK_RETRIEVE, RERANK_FINAL = 10, 3
RAG_RETRIEVE, RAG_FINAL = 5, 2
TOKEN_DIM = 8
TELEMETRY_DEVICES = [0, 1]
STOPS = ["<|end|>", FENCE_STOP]
RESPONSE_TEMPLATE = "<|im_start|>assistant\n"
PASS_KS = (1, 2, 3)
DIFFICULTY = [("interview", 0.0, 0.6), ("competition", 0.6, 0.8), ("introductory", 0.8, 1.0)]


# ----------------------------------------------------------------------------------------------
# Spark side
# ----------------------------------------------------------------------------------------------
def _posexplode_messages(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*keys, F.posexplode("messages").alias("msg_idx", "m")).select(
        *keys, F.col("msg_idx").cast("long").alias("msg_idx"), F.col("m.role").alias("role"),
        F.col("m.content").alias("content"))


def q_messages_plain(spark, sf):
    p = fx.pairs(spark, sf).where(F.col("split") == "train")
    n = PR.normalize_corpus(p.withColumnRenamed("reference", "cmd"), "conala", keep=("example_id",))
    return _posexplode_messages(PR.plain_messages(n, "instruction", "reference"), ["example_id"])


def _templated_pairs(spark, sf):
    p = PR.blind_test_labels(fx.pairs(spark, sf), "reference")
    p = p.withColumn("dataset", F.lit("conala"))
    return p.withColumn("messages", PR.templated_turns(F.col("nl"), F.col("reference"), PR.prefix_for("dataset")))


def q_messages_templated(spark, sf):
    return _posexplode_messages(_templated_pairs(spark, sf), ["example_id", "split"])


def q_prompt_with_tests(spark, sf):
    m = fx.mbpp_raw(spark, sf)
    return m.select("doc_id", PR.prompt_with_tests("text", "test_list").alias("prompt"),
                    F.size("test_list").cast("long").alias("n_tests"))


def q_prompt_io_mode(spark, sf):
    a = PR.apps_messages(fx.apps_raw(spark, sf))
    return a.select("doc_id", "split", F.col("messages")[0]["content"].alias("user_content"),
                    F.col("messages")[1]["content"].alias("assistant_content"))


def _dataset_paths(spark, sf):
    d = fx.table(spark, sf, "documents")
    m4 = F.col("doc_id") % 4
    name = F.when(m4 == 0, "conala").when(m4 == 1, "mbpp").when(m4 == 2, "apps").otherwise(F.col("source"))
    return d.select("doc_id", F.concat(F.lit("datasets/"), F.col("lang"), F.lit("/"), name).alias("path"))


def q_dataset_config(spark, sf):
    c = PR.dataset_config(_dataset_paths(spark, sf), "path")
    return c.select("doc_id", "dataset_name", F.col("max_new_tokens").cast("int").alias("max_new_tokens"),
                    "instruction_field", "reference_field")


def q_joint_union(spark, sf):
    conala = PR.normalize_corpus(fx.pairs(spark, sf).withColumnRenamed("reference", "cmd"), "conala")
    mbpp = PR.normalize_corpus(fx.mbpp_raw(spark, sf), "mbpp")
    u = PR.union_corpora([conala, mbpp])
    return u.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_rows"),
                                    F.sum(F.length("instruction")).cast("long").alias("instruction_chars"),
                                    F.sum(F.length("reference")).cast("long").alias("reference_chars"))


def q_split_carve(spark, sf):
    d = fx.table(spark, sf, "documents").select("doc_id")
    return SA.carve(d, "doc_id", CARVE_N, seed=42).select("doc_id", "split")


def q_split_carve_half(spark, sf):
    """L2 with half of all rows chosen."""
    d = fx.table(spark, sf, "documents").select("doc_id")
    return SA.carve(d, "doc_id", d.count() // 2, seed=42).select("doc_id", "split")


def q_split_sizes(spark, sf):
    return SA.split_sizes(q_split_carve(spark, sf))


def q_icl_exemplars(spark, sf):
    train = fx.pairs(spark, sf).where(F.col("split") == "train")
    ex = SA.first_n_by_seed(train, "example_id", ICL_N, ICL_SEEDS)
    return ex.select(F.col("seed").cast("int").alias("seed"), F.col("rank").cast("long").alias("rank"), "example_id")


def _conala_test_messages(spark, sf):
    t = fx.pairs(spark, sf).where(F.col("split") == "test")
    return t.withColumn("messages", PR.templated_turns(F.col("nl"), F.lit(None).cast("string"),
                                                       INSTRUCTION_PREFIX["conala"]))


def q_icl_prompt(spark, sf):
    p = fx.pairs(spark, sf)
    test = _conala_test_messages(spark, sf)
    train = p.where(F.col("split") == "train")
    out = FS.icl_prompt(test, train, ICL_N, ICL_SEED, "example_id", "nl", "reference", "conala")
    return out.select("example_id", F.size("messages").cast("long").alias("n_messages"),
                      render_cut("messages").alias("prompt"))


def q_icl_grid(spark, sf):
    """G1 x T7: every test prompt for every (n, seed) of the ICL grid, in one job."""
    p = fx.pairs(spark, sf)
    out = FS.icl_grid(_conala_test_messages(spark, sf), p.where(F.col("split") == "train"), ICL_SIZES, ICL_SEEDS,
                      "example_id", "nl", "reference", "conala")
    return out.select("example_id", F.col("seed").cast("int").alias("seed"), F.col("n").cast("int").alias("n"),
                      F.size("messages").cast("long").alias("n_messages"), render_cut("messages").alias("prompt"))


def q_icl_prompt_by_n(spark, sf):
    """A15 over the ICL grid: mean prompt length per (dataset, n) over the seeds."""
    runs = q_icl_grid(spark, sf).groupBy("seed", "n").agg(F.avg(F.length("prompt")).alias("prompt_chars"))
    s = RN.seed_summary(runs.withColumn("dataset", F.lit("conala")), ["dataset", "n"], "prompt_chars")
    return s.select("dataset", "n", "n_seeds", *[F.round(f"{f}_prompt_chars", 4).alias(f"{f}_prompt_chars") for f in ("mean", "std", "min", "max")])


def _grid_model(prompts: pd.Series) -> pd.Series:
    """Deterministic stand-in whose answer depends on the whole prompt's length: the prompt's beginning."""
    return pd.Series([p[:len(p) % 200 + 50] for p in prompts], index=prompts.index, dtype="object")


def q_icl_scores_by_n(spark, sf):
    """A15 over the scored few-shot grid: exact match and chrF of the model's answers per (dataset, n), over the seeds."""
    train = fx.pairs(spark, sf).where(F.col("split") == "train")
    runs = WF.icl_grid_scores(_conala_test_messages(spark, sf), train, ICL_SIZES, ICL_SEEDS, _grid_model, "example_id", "nl", "reference", "conala")
    runs = runs.where(F.col("metric").isin("exact_match", "chrf")).withColumn("dataset", F.lit("conala"))
    s = RN.seed_summary(runs, ["dataset", "n", "metric"], "value")
    return s.select("dataset", F.col("n").cast("int").alias("n"), "metric", "n_seeds", *[F.round(f"{f}_value", 4).alias(f"{f}_value") for f in ("mean", "std", "min", "max")])


def q_render_cut(spark, sf):
    t = _templated_pairs(spark, sf)
    return t.select("example_id", render_cut("messages").alias("prompt"))


def q_fence_cut(spark, sf):
    r = fx.responses(spark, sf)
    return r.select("example_id", F.when(F.col("api_model"), F.col("raw")).otherwise(fence_cut("raw")).alias("response"))


def q_stop_truncate(spark, sf):
    r = fx.responses(spark, sf)
    hit = earliest_stop(F.col("raw"), STOPS)
    return r.select("example_id", hit.isNotNull().alias("has_stop"), hit["stop"].alias("stop_fired"),
                    stop_truncate("raw", STOPS).alias("truncated"))


def q_completion_span(spark, sf):
    t = _templated_pairs(spark, sf).select("example_id", render_messages("messages").alias("r"))
    s = t.select("example_id", F.length("r").cast("long").alias("n_chars"),
                 completion_span(F.col("r"), RESPONSE_TEMPLATE).alias("s"))
    return s.select("example_id", F.col("s.loss_start").cast("long").alias("loss_start"),
                    F.col("s.loss_chars").cast("long").alias("loss_chars"),
                    F.round(1.0 - F.col("s.loss_chars") / F.col("n_chars"), 6).alias("masked_fraction"))


def _cleaned_responses(spark, sf):
    r = fx.responses(spark, sf)
    return r.select("example_id", F.when(F.col("api_model"), F.col("raw")).otherwise(fence_cut("raw")).alias("response"))


def q_align_responses(spark, sf):
    refs = fx.pairs(spark, sf).select("example_id", "reference")
    d = AL.align_diagnostics(refs, _cleaned_responses(spark, sf))
    return d.select("example_id", "has_reference", "has_response",
                    (F.col("response") == F.col("reference")).alias("exact"))


def _aligned(spark, sf):
    refs = fx.pairs(spark, sf).select("example_id", "split", "reference")
    return AL.align(refs, _cleaned_responses(spark, sf), on_missing="wrong", unique_responses=True)


def q_exact_match(spark, sf):
    p = fx.pairs(spark, sf)
    return M.exact_match(p, "prediction", "reference", group_by=["split"]) \
        .select("split", F.round("exact_match", 6).alias("exact_match"))


def q_chrf(spark, sf):
    return M.chrf(fx.pairs(spark, sf), "prediction", "reference").select(F.round("chrf", 6).alias("chrf"))


def q_chrf_pp(spark, sf):
    return M.chrf(fx.pairs(spark, sf), "prediction", "reference", word_order=2, out="chrf_pp") \
        .select(F.round("chrf_pp", 6).alias("chrf_pp"))


def q_chrf_per_example(spark, sf):
    c = M.chrf_per_example(fx.pairs(spark, sf), "prediction", "reference")
    return c.select("example_id", F.round("chrf", 6).alias("chrf"))


def q_em_at_k(spark, sf):
    e = M.em_at_k(fx.candidates(spark, sf), ks=(1, 5, 10))
    return e.select(*[F.round(f"em_at_{k}", 6).alias(f"em_at_{k}") for k in (1, 5, 10)])


def q_ngram_bleu(spark, sf):
    return M.ngram_overlap(fx.pairs(spark, sf), "prediction", "reference").select(F.round("bleu", 6).alias("bleu"))


def q_weighted_bleu(spark, sf):
    return M.keyword_weighted_overlap(fx.pairs(spark, sf), "prediction", "reference") \
        .select(F.round("weighted_bleu", 6).alias("weighted_bleu"))


def q_flagship_eval(spark, sf):
    """J1 -> T2 -> A1 + A2 by split: keyed alignment of cleaned responses, EM and corpus chrF."""
    a = _aligned(spark, sf).withColumn("exact_match", F.when(F.col("response") == F.col("reference"), F.lit(1.0)).otherwise(F.lit(0.0)))
    a = a.withColumn("n_responses", F.when(F.col("response").isNotNull(), F.lit(1)))
    # a missing response scores as an empty hypothesis
    a = a.withColumn("response", F.coalesce("response", F.lit("")))
    ch = M.chrf_family(a, "response", "reference", group_by=["split"],
                       also={"example_id": F.count, "n_responses": F.count, "exact_match": F.avg})
    return ch.select("split", F.col("example_id").alias("n_examples"), "n_responses", F.round("exact_match", 6).alias("exact_match"),
                     F.round("chrf", 6).alias("chrf"))


PREP_VALIDATION = 50


def _turn_columns(df: DataFrame, key: str) -> DataFrame:
    return df.select(key, "split", F.col("messages")[0]["content"].alias("user_content"),
                     F.col("messages")[1]["content"].alias("assistant_content"))


def q_prepare_apps(spark, sf):
    """E1 for apps: validation carved from train, I/O-mode prompt, first solution, test blinded."""
    prepared = WF.prepare_dataset(fx.apps_raw(spark, sf), "apps", "doc_id", validation_size=PREP_VALIDATION)
    return _turn_columns(prepared, "doc_id")


def q_prepare_mbpp(spark, sf):
    """E1 for mbpp: tests appended to the prompt, templated, test split blinded."""
    raw = fx.mbpp_raw(spark, sf).withColumn(
        "split", F.when(F.col("doc_id") % 10 == 0, "test").otherwise("train"))
    return _turn_columns(WF.prepare_dataset(raw, "mbpp", "doc_id"), "doc_id")


def q_evaluate_run(spark, sf):
    """E2 scoring: stop strings + fence cut (API outputs raw), keyed alignment, tall metrics by split."""
    cleaned = WF.clean_responses(fx.responses(spark, sf), api_model="api_model", stops=STOPS)
    refs = fx.pairs(spark, sf).select("example_id", "split", "reference")
    tall = WF.evaluate_responses(cleaned, refs, group_by=["split"])
    return tall.select("split", "metric", F.round("value", 6).alias("value"))


def q_run_outputs_roundtrip(spark, sf):
    """S6 + S7: the evaluate_run metrics written under a run address (partition directories,
    idempotent per run) and read back."""
    cleaned = WF.clean_responses(fx.responses(spark, sf), api_model="api_model", stops=STOPS)
    refs = fx.pairs(spark, sf).select("example_id", "split", "reference")
    tall = WF.evaluate_responses(cleaned, refs, group_by=["split"])
    addressed = tall.select(F.lit("stub").alias("model"), F.lit("conala").alias("dataset"),
                            F.lit(0.2).alias("temperature"), F.lit("none").alias("strategy"),
                            F.lit(0).alias("n"), F.lit(None).cast("int").alias("seed"), "split", "metric", "value")
    path = scratch_path(spark, "run-outputs")
    IO.write_run_outputs(addressed, path)
    back = spark.read.parquet(path)
    return back.select("model", "dataset", F.col("temperature").cast("double").alias("temperature"), "strategy",
                       F.col("n").cast("int").alias("n"), "split", "metric", F.round("value", 6).alias("value"))


def q_knn_topk(spark, sf):
    res = RT.knn_topk(fx.retrieval_queries(spark, sf), fx.knowledge_base(spark, sf), KNN_K)
    return res.select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"),
                      F.round("sim", 5).alias("sim"))


def _reranked(q, kb, n_retrieve, n_final):
    cand = RT.knn_topk(q, kb, n_retrieve)
    return RT.rerank(cand, q, kb, n_final, TOKEN_DIM), cand.count()


def q_rerank_maxsim(spark, sf):
    r, _ = _reranked(fx.retrieval_queries(spark, sf), fx.knowledge_base(spark, sf), RERANK_RETRIEVE, RERANK_FINAL)
    return r.select("query_id", "doc_id", F.col("final_rank").cast("long").alias("final_rank"),
                    F.round("maxsim", 5).alias("maxsim"))


def q_maxsim_search(spark, sf):
    """J4 as a search of the whole knowledge base: posting lists of tokens by centroid."""
    res = LI.maxsim_topk(fx.retrieval_queries(spark, sf), fx.knowledge_base(spark, sf), RERANK_RETRIEVE, TOKEN_DIM)
    return res.select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"), F.round("maxsim", 5).alias("maxsim"))


def q_knn_topk_blocked(spark, sf):
    """J2 with the query side treated as too large to broadcast: queries visit the pivot cells that can hold their nearest rows."""
    res = RT.knn_topk(fx.retrieval_queries(spark, sf), fx.knowledge_base(spark, sf), KNN_K, max_broadcast_bytes=0,
                      block_rows=KNN_BLOCK)
    return res.select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"),
                      F.round("sim", 5).alias("sim"))


def q_knn_self_join(spark, sf):
    """J2/W1 as a join of the whole table with itself: every vector's nearest ones (its own included), through pivot cells."""
    v = fx.table(spark, sf, "embeddings")
    res = RT.knn_topk(v.withColumnRenamed("vec_id", "query_id"), v.withColumnRenamed("vec_id", "doc_id"), KNN_K, max_broadcast_bytes=0)
    return res.select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"), F.round("sim", 5).alias("sim"))


def q_rag_prompt(spark, sf):
    """T6 over all documents: each is in the knowledge base with its own text, unless it is a query's."""
    docs, q = fx.table(spark, sf, "documents"), fx.retrieval_queries(spark, sf)
    r, n_cand = _reranked(q, fx.document_base(spark, sf), RAG_RETRIEVE, RAG_FINAL)
    payload = docs.select("doc_id", F.col("text").alias("page_content"), F.col("source").alias("code"))
    qm = q.select("query_id").join(docs.select(F.col("doc_id").alias("query_id"), "text"), "query_id")
    qm = qm.select("query_id", PR.templated_turns(F.col("text"), F.lit(None).cast("string"),
                                                  INSTRUCTION_PREFIX["conala"]).alias("messages"))
    out = RT.rag_messages(qm, r, payload, "final_rank", "conala", retrieved_rows=n_cand)
    return out.select("query_id", F.size("messages").cast("long").alias("n_messages"),
                      render_cut("messages").alias("prompt"))


def _difficulty(o: DataFrame) -> DataFrame:
    n = o.select((F.max("problem_id") + 1).alias("n")).scalar()
    return o.withColumn("difficulty", OC.range_label("problem_id", OC.proportional_bounds(n, DIFFICULTY)))


def q_apps_accuracy(spark, sf):
    # difficulty is a property of the problem: N comes from the whole outcome table, as in pass_at_k
    o = _difficulty(fx.outcomes(spark, sf))
    a = OC.accuracy(o, ["difficulty"])
    return a.select("difficulty", *[F.round(c, 6).alias(c) for c in
                                    ("avg_accuracy", "strict_accuracy", "compile_error_rate", "runtime_error_rate")],
                    "compile_errors", "runtime_errors", "n_generations", "n_problems")


def q_pass_at_k(spark, sf):
    o = _difficulty(fx.outcomes(spark, sf))
    p = OC.pass_at_k(o, ks=PASS_KS, group_by=["difficulty"])
    return p.select("difficulty", F.col("k").cast("long").alias("k"), F.round("pass_at_k", 6).alias("pass_at_k"))


def _polls(spark, sf, devices=None):
    return RN.poll_totals(fx.telemetry(spark, sf), devices)


def _summary_out(s: DataFrame) -> DataFrame:
    return s.select(F.col("run_id").cast("long").alias("run_id"), F.round("initial_mb", 6).alias("initial_mb"),
                    F.round("peak_mb", 6).alias("peak_mb"), F.round("elapsed_s", 3).alias("elapsed_s"),
                    F.col("n_polls").cast("long").alias("n_polls"))


def q_run_telemetry(spark, sf):
    return _summary_out(RN.run_summary(_polls(spark, sf, TELEMETRY_DEVICES)))  # the choice of devices is A12's


def q_running_peak(spark, sf):
    r = RN.running_stats(_polls(spark, sf), "run_id", ["poll_ts"], value="used_mb")
    return r.select("run_id", "poll_ts", F.round("used_mb", 6).alias("used_mb"),
                    F.round("running_peak", 6).alias("running_peak"),
                    F.col("processed").cast("long").alias("processed"), F.col("total").cast("long").alias("total"),
                    "pct")


def q_run_progress(spark, sf):
    r = RN.running_stats(fx.telemetry(spark, sf), "run_id", ["ts", "device"])
    return r.select("run_id", "ts", "device", F.col("processed").cast("long").alias("processed"),
                    F.col("total").cast("long").alias("total"), "pct")


def q_telemetry_stream(spark, sf):
    """Polls derived from events are staged as parquet files in the shared folder (spread over
    the files by time, so every run's state is merged across micro-batches), consumed by a file
    stream two files per trigger and summarised with bounded per-run state; the published table is
    read back."""
    p = _polls(spark, sf)
    # the wall clock as a UTC instant (a cast would go through the session time zone)
    polls = p.select(F.col("run_id").cast("long").alias("run_id"), as_instant(p, "poll_ts").alias("poll_ts"),
                     "used_mb")
    staged = scratch_path(spark, "telemetry-polls")
    polls.repartitionByRange(4, "poll_ts").write.parquet(staged)
    query, out_dir = ST.run_summary_stream(spark, staged, max_files_per_trigger=2)
    query.awaitTermination()
    return _summary_out(spark.read.parquet(out_dir))


def q_telemetry_sessions(spark, sf):
    """X4 with A12 and A11 in one stream: device readings arrive in two parts, the query is started for each and goes on from its
    checkpoint; a heartbeat lets the last runs end."""
    t = fx.telemetry(spark, sf)
    r = t.select(F.col("run_id").cast("long").alias("run_id"), as_instant(t, "poll_ts").alias("poll_ts"), "device", "used_mb")
    span = r.agg(F.min("poll_ts").alias("lo"), F.max("poll_ts").alias("hi"))
    middle = span.select(F.timestamp_micros(((F.unix_micros("lo") + F.unix_micros("hi")) / 2).cast("long")).alias("at"))
    late = r.join(F.broadcast(middle), F.col("poll_ts") > F.col("at"), "left_semi")
    early = r.join(F.broadcast(middle), F.col("poll_ts") > F.col("at"), "left_anti")
    beat = span.select(F.lit(None).cast("long").alias("run_id"), (F.col("hi") + F.expr("interval 30 days")).alias("poll_ts"),
                       F.lit(None).cast("int").alias("device"), F.lit(None).cast("double").alias("used_mb"))
    staged, out, ckpt = (scratch_path(spark, x) for x in ("readings", "sessions", "sessions-ckpt"))
    for part in (early, late.unionByName(beat)):
        part.write.mode("append").parquet(staged)
        ST.run_sessions_stream(spark, staged, out, ckpt, gap=SESSION_GAP).awaitTermination()
    s = spark.read.parquet(out)
    return s.select("run_id", F.unix_micros("first_poll").alias("first_poll_us"), F.round("initial_mb", 6).alias("initial_mb"),
                    F.round("peak_mb", 6).alias("peak_mb"), F.round("elapsed_s", 3).alias("elapsed_s"),
                    F.col("n_polls").cast("long").alias("n_polls"))


def _sweep_grid(spark):
    return RN.param_grid(spark, SWEEP_GRID)


def q_sweep_grid(spark, sf):
    g = RN.grid_coverage(_sweep_grid(spark), fx.sweep_runs(spark, sf), "eval_loss")
    return g.select(F.col("lora_r").cast("int").alias("lora_r"), F.col("lora_alpha").cast("int").alias("lora_alpha"),
                    "n_runs", "best_eval_loss")


def q_grid_missing(spark, sf):
    g = RN.grid_missing(_sweep_grid(spark), fx.sweep_runs(spark, sf), "eval_loss")
    return g.select(F.col("lora_r").cast("int").alias("lora_r"), F.col("lora_alpha").cast("int").alias("lora_alpha"))


def q_best_run(spark, sf):
    b = RN.best_run(fx.all_sweep_runs(spark, sf), ["lora_r", "lora_alpha"], "eval_loss", sweep=["seed"])
    return b.select(F.col("seed").cast("int").alias("seed"), F.col("lora_r").cast("int").alias("lora_r"),
                    F.col("lora_alpha").cast("int").alias("lora_alpha"), "eval_loss")


def q_icl_by_n(spark, sf):
    s = RN.seed_summary(fx.all_sweep_runs(spark, sf), ["lora_alpha", "lora_r"], "eval_loss")
    return s.select(F.col("lora_alpha").cast("int").alias("lora_alpha"), F.col("lora_r").cast("int").alias("lora_r"),
                    "n_seeds", *[F.round(c, 6).alias(c) for c in
                                 ("mean_eval_loss", "std_eval_loss", "min_eval_loss", "max_eval_loss")])


def q_responses_roundtrip(spark, sf):
    path = scratch_path(spark, "responses")
    r = _cleaned_responses(spark, sf).withColumn("gen_id", F.lit(0))
    IO.write_responses(r, path)
    back = spark.read.parquet(path)
    return back.select("example_id", F.col("gen_id").cast("int").alias("gen_id"), "response")


def q_dataset_roundtrip(spark, sf):
    path = scratch_path(spark, "prepared")
    IO.save_prepared(_templated_pairs(spark, sf).select("example_id", "split", "messages"), path)
    test = IO.load_prepared(spark, path, "test")
    return test.select("example_id", "split", F.size("messages").cast("long").alias("n_messages"),
                       render_cut("messages").alias("prompt"))


def q_export_text(spark, sf):
    path = scratch_path(spark, "export")
    IO.export_aligned_text(fx.pairs(spark, sf), path, {"predictions": "prediction", "references": "reference"})
    back = spark.read.text(path)
    return back.groupBy("kind").agg(F.count(F.lit(1)).alias("n_lines"),
                                    F.sum(F.length("value")).cast("long").alias("n_chars"))


def q_import_text(spark, sf):
    """S8 read back: line-aligned predictions and references paired by their position."""
    path = scratch_path(spark, "import")
    IO.export_aligned_text(fx.pairs(spark, sf), path, {"predictions": "prediction", "references": "reference"})
    back = IO.read_aligned_text(spark, {k: f"{path}/kind={k}" for k in ("predictions", "references")})
    return back.select("line", F.col("predictions").alias("prediction"), F.col("references").alias("reference"))


def q_generate_resumed(spark, sf):
    """X2 run twice under one path: the second run asks the model only for what the first one has not answered."""
    t = _templated_pairs(spark, sf).select("example_id", render_cut("messages").alias("prompt"))
    path = scratch_path(spark, "answers")
    first = t.where(F.crc32(F.col("example_id").cast("string").cast("binary")) % 3 == 0)  # what an interrupted run had done
    HK.generate_resumable(first, lambda: _stub_model, path, batches=2)
    return HK.generate_resumable(t, lambda: _stub_model, path, batches=4)


def _stub_model(prompts: pd.Series) -> pd.Series:
    """Deterministic stand-in for a model: echoes the prompt with 'e' upper-cased."""
    return prompts.str.replace("e", "E", regex=False)


_STUB_CHARS = ["a", "e", "i", "o", "u", " "]


def _stub_encoder(texts: pd.Series):
    """Deterministic stand-in for an encoder: counts of a few characters."""
    return [[float(t.count(ch)) for ch in _STUB_CHARS] for t in texts]


def q_batch_score(spark, sf):
    t = _templated_pairs(spark, sf).select("example_id", render_cut("messages").alias("prompt"))
    return HK.generate_with(t, _stub_model).select("example_id", "response")


def q_embed_normalise(spark, sf):
    d = fx.table(spark, sf, "documents").select("doc_id", "text")
    e = HK.embed_with(d, _stub_encoder, "text")
    return e.select("doc_id", F.posexplode("embedding").alias("dim", "value")).select(
        "doc_id", F.col("dim").cast("long").alias("dim"), F.round(F.col("value").cast("double"), 5).alias("value"))


def q_embed_updated(spark, sf):
    """X3 kept by content: vectors of an earlier state of the table stay, the second call encodes only new texts."""
    d = fx.table(spark, sf, "documents")
    path = scratch_path(spark, "embedding-store")
    earlier = d.where("lang = 'en'")  # what the knowledge base held before
    HK.embed_incremental(earlier, lambda: _stub_encoder, path, ("doc_id",), batches=2)
    e = HK.embed_incremental(d, lambda: _stub_encoder, path, ("doc_id",), batches=4)
    return e.select("doc_id", F.posexplode("embedding").alias("dim", "value")).select(
        "doc_id", F.col("dim").cast("long").alias("dim"), F.round(F.col("value").cast("double"), 5).alias("value"))


# the reference's corpora as they are prepared, and the rules for odd rows -----------------------
def q_prepare_magicoder_oss(spark, sf):
    """E1 for magicoder_oss: problems and solutions as plain turns, validation carved from train."""
    raw = fx.pairs(spark, sf).select("example_id", "split", F.col("nl").alias("problem"), F.col("reference").alias("solution"))
    return _turn_columns(WF.prepare_dataset(raw, "magicoder_oss", "example_id", validation_size=PREP_VALIDATION), "example_id")


def q_prepare_conala(spark, sf):
    """E1 for conala: templated turns, test answers blinded."""
    raw = fx.pairs(spark, sf).select("example_id", "split", "nl", F.col("reference").alias("cmd"))
    return _turn_columns(WF.prepare_dataset(raw, "conala", "example_id"), "example_id")


def q_prepare_joint(spark, sf):
    """The joint training set: messages, split and provenance of both corpora, validation carved once from all train rows."""
    conala = fx.pairs(spark, sf).select(F.concat(F.lit("conala-"), F.col("example_id")).alias("row_id"), "split", "nl",
                                        F.col("reference").alias("cmd"))
    mbpp = fx.mbpp_raw(spark, sf).select(F.concat(F.lit("mbpp-"), F.col("doc_id")).alias("row_id"), F.when(
        F.col("doc_id") % 10 == 0, "test").otherwise("train").alias("split"), "text", "test_list", "code")
    return _turn_columns(WF.prepare_joint({"conala": conala, "mbpp": mbpp}, "row_id", validation_size=PREP_VALIDATION), "row_id") \
        .withColumn("dataset", F.substring_index("row_id", "-", 1))


def q_run_end_to_end(spark, sf):
    """E2 for every run: prompts, model, cleaned responses, scores by split and each run's telemetry in a record of its own, written
    under the run's address and read back; memory and time are shown with their units (F10)."""
    prompts = _templated_pairs(spark, sf).select("example_id", render_cut("messages").alias("prompt"))
    answers = HK.generate_with(prompts, _stub_model).select("example_id", F.col("response").alias("raw"))
    refs = fx.pairs(spark, sf).select("example_id", "split", "reference")
    scores = WF.evaluate_responses(WF.clean_responses(answers, stops=STOPS), refs, group_by=["split"])
    telemetry = RN.run_summary(_polls(spark, sf)).withColumn("checkpoint", F.concat(F.lit("ckpt-"), F.col("run_id").cast("string")))
    path = scratch_path(spark, "run-record")
    WF.write_run_record(scores, telemetry, path, {"model": "stub", "dataset": "conala", "temperature": 0.2,
                                                  "strategy": "none", "n": 0, "seed": None}, group_by=["split"], own_address=["checkpoint"])
    back = spark.read.parquet(path)
    whole = F.round("value").cast("long")
    shown = F.when(F.col("unit") == "s", IO.format_with_unit(whole, "s")).when(F.col("unit") == "MB", IO.format_with_unit(whole, "MB"))
    return back.select("model", "checkpoint", F.coalesce("split", F.lit("all")).alias("split"), "metric", F.round("value", 4).alias("value"),
                       "unit", shown.alias("shown"))


def q_run_address_two_runs(spark, sf):
    """Runs of every seed whose temperatures differ in the third decimal, and base and tuned runs, keep their own results."""
    runs = fx.all_sweep_runs(spark, sf).groupBy("seed").agg(F.round(F.avg("eval_loss"), 6).alias("eval_loss"))
    path = scratch_path(spark, "addresses")
    for t, c in ((0.12, None), (0.124, None), (0.12, "ckpt-1")):
        IO.write_run_outputs(IO.to_tall(runs.select(
            F.lit("m").alias("model"), F.lit("conala").alias("dataset"), F.lit(t).alias("temperature"), F.lit("icl").alias("strategy"),
            F.lit(3).alias("n"), F.col("seed").cast("int").alias("seed"), F.lit(c).cast("string").alias("checkpoint"), F.col("eval_loss")),
            [*IO.RUN_ADDRESS, "checkpoint"], ["eval_loss"]), path)
    back = spark.read.parquet(path)
    return back.select(F.col("temperature").cast("double").alias("temperature"), F.coalesce("checkpoint", F.lit("base")).alias("checkpoint"),
                       F.col("seed").cast("int").alias("seed"), "metric", F.round("value", 6).alias("value"))


def q_apps_metrics_file(spark, sf):
    """Accuracy and pass@k per difficulty as JSON lines under the method and number of exemplars, read back."""
    path = scratch_path(spark, "apps-metrics")
    IO.write_metrics(q_apps_report(spark, sf).withColumns({"method": F.lit("icl"), "n": F.lit(ICL_N)}), path, ["method", "n"])
    return spark.read.json(path).select("method", F.col("n").cast("int").alias("n"), "difficulty", "metric", F.round("value", 6).alias("value"))


def q_apps_report(spark, sf):
    """Accuracy and pass@k per difficulty, over all problems and generations."""
    acc, at_k = WF.apps_report(fx.outcomes(spark, sf), slices=REPORT_SLICES, ks=(1, 2))
    one = acc.select("difficulty", F.lit("strict_accuracy").alias("metric"), F.round("strict_accuracy", 6).alias("value"))
    return one.unionByName(at_k.select("difficulty", F.concat(F.lit("pass_at_"), F.col("k")).alias("metric"), F.round("pass_at_k", 6).alias("value")))


#: difficulty slices by position; problems beyond them are reported as outside
REPORT_SLICES = [("interview", 0, 50), ("competition", 50, 80)]


def q_outcome_null_status(spark, sf):
    """A6/A8 where some tests have no status: such a test has not passed."""
    o = fx.outcomes(spark, sf).withColumn("status", F.when(F.col("test_id") % 7 != 0, F.col("status")))
    a = OC.accuracy(_difficulty(o), ["difficulty"])
    return a.select("difficulty", F.round("avg_accuracy", 6).alias("avg_accuracy"), F.round("strict_accuracy", 6).alias("strict_accuracy"))


def q_json_fields(spark, sf):
    """F5/F6 on odd JSON: trailing characters, falsy values, non-objects, dealt to all documents in turn."""
    texts = F.array(*[F.lit(x) for x, _, _ in fx.JSON_CASES])
    d = fx.table(spark, sf, "documents").select("doc_id", F.element_at(
        texts, (F.col("doc_id") % len(fx.JSON_CASES) + 1).cast("int")).alias("json"))
    return d.select("doc_id", json_truthy_field("json", "fn_name").alias("fn_name"), json_first_element("json").alias("first"))


def q_json_documents(spark, sf):
    """F5/F6 on JSON made of every document: a problem's metadata with its key given twice, and its list of solutions."""
    d = fx.table(spark, sf, "documents").select(
        "doc_id",
        F.concat(F.lit('{"fn_name":"old",'), F.substring(F.to_json(F.struct(F.col("text").alias("fn_name"), "lang"),
                                                                  {"ignoreNullFields": "false"}), 2, 2_000_000_000)).alias("meta"),
        F.to_json(F.array("text", "source")).alias("solutions"))
    return d.select("doc_id", F.md5(json_truthy_field("meta", "fn_name").cast("binary")).alias("fn_name"),
                    F.md5(json_first_element("solutions").cast("binary")).alias("first"))


def q_contains_any(spark, sf):
    """documents that hold any of a list of strings."""
    return fx.table(spark, sf, "documents").select("doc_id", contains_any("text", NEEDLES).alias("found"))


NEEDLES = ["License", "@", "the th"]


def q_preview(spark, sf):
    """The first positions."""
    return IO.preview(fx.table(spark, sf, "documents").select("doc_id", "lang"), 10, "doc_id")


QUERIES = {
    "flagship_eval": q_flagship_eval,
    "messages_plain": q_messages_plain,
    "messages_templated": q_messages_templated,
    "prompt_with_tests": q_prompt_with_tests,
    "prompt_io_mode": q_prompt_io_mode,
    "dataset_config": q_dataset_config,
    "joint_union": q_joint_union,
    "split_carve": q_split_carve,
    "split_carve_half": q_split_carve_half,
    "split_sizes": q_split_sizes,
    "icl_exemplars": q_icl_exemplars,
    "icl_prompt": q_icl_prompt,
    "icl_grid": q_icl_grid,
    "icl_prompt_by_n": q_icl_prompt_by_n,
    "icl_scores_by_n": q_icl_scores_by_n,
    "render_cut": q_render_cut,
    "fence_cut": q_fence_cut,
    "stop_truncate": q_stop_truncate,
    "completion_span": q_completion_span,
    "align_responses": q_align_responses,
    "exact_match": q_exact_match,
    "chrf": q_chrf,
    "chrf_pp": q_chrf_pp,
    "chrf_per_example": q_chrf_per_example,
    "em_at_k": q_em_at_k,
    "ngram_bleu": q_ngram_bleu,
    "weighted_bleu": q_weighted_bleu,
    "prepare_apps": q_prepare_apps,
    "prepare_mbpp": q_prepare_mbpp,
    "evaluate_run": q_evaluate_run,
    "run_outputs_roundtrip": q_run_outputs_roundtrip,
    "knn_topk": q_knn_topk,
    "knn_topk_blocked": q_knn_topk_blocked,
    "knn_self_join": q_knn_self_join,
    "rerank_maxsim": q_rerank_maxsim,
    "maxsim_search": q_maxsim_search,
    "rag_prompt": q_rag_prompt,
    "apps_accuracy": q_apps_accuracy,
    "pass_at_k": q_pass_at_k,
    "run_telemetry": q_run_telemetry,
    "running_peak": q_running_peak,
    "run_progress": q_run_progress,
    "telemetry_stream": q_telemetry_stream,
    "telemetry_sessions": q_telemetry_sessions,
    "sweep_grid": q_sweep_grid,
    "grid_missing": q_grid_missing,
    "best_run": q_best_run,
    "icl_by_n": q_icl_by_n,
    "responses_roundtrip": q_responses_roundtrip,
    "dataset_roundtrip": q_dataset_roundtrip,
    "export_text": q_export_text,
    "import_text": q_import_text,
    "generate_resumed": q_generate_resumed,
    "batch_score": q_batch_score,
    "embed_normalise": q_embed_normalise,
    "embed_updated": q_embed_updated,
    "prepare_magicoder_oss": q_prepare_magicoder_oss,
    "prepare_conala": q_prepare_conala,
    "prepare_joint": q_prepare_joint,
    "run_end_to_end": q_run_end_to_end,
    "run_address_two_runs": q_run_address_two_runs,
    "apps_report": q_apps_report,
    "apps_metrics_file": q_apps_metrics_file,
    "outcome_null_status": q_outcome_null_status,
    "json_fields": q_json_fields,
    "json_documents": q_json_documents,
    "contains_any": q_contains_any,
    "preview": q_preview,
}
