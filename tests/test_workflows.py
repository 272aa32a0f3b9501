"""End-to-end workflows: preparation (E1), prompt strategies (E2, K9, K17), scoring, APPS report."""

import pytest
from pyspark.sql import functions as F

from paths import SF01
from quarry.functions.fixed import PLACEHOLDER
from quarry.operators import prompt as PR
from quarry.plans import fixtures as fx
from quarry.plans import workflows as WF


@pytest.fixture(scope="module")
def magicoder_like(spark):
    p = fx.pairs(spark, SF01)
    return p.select("example_id", F.lit("train").alias("split"), F.col("nl").alias("instruction"),
                    F.col("reference").alias("response"))


def test_prepare_magicoder_plain_and_carved(magicoder_like):
    out = WF.prepare_dataset(magicoder_like, "magicoder", "example_id", validation_size=40)
    sizes = {r.split: r.c for r in out.groupBy("split").agg(F.count("*").alias("c")).collect()}
    assert sizes == {"validation": 40, "train": magicoder_like.count() - 40}
    m = out.first().messages
    assert [x.role for x in m] == ["user", "assistant"] and "```" not in m[0].content


def test_prepare_unknown_corpus(magicoder_like):
    with pytest.raises(ValueError):
        WF.prepare_dataset(magicoder_like, "nope", "example_id", validation_size=0)


def test_build_prompts_strategies(spark):
    p = fx.pairs(spark, SF01)
    test = PR.templated_messages(p.where("split = 'test'").withColumn("none", F.lit(None).cast("string")),
                                 "nl", "none", "conala")
    train = p.where("split = 'train'")
    none = WF.build_prompts(test, "none")
    assert {r.n for r in none.select(F.size("messages").alias("n")).collect()} == {2}
    icl = WF.build_prompts(test, "icl", train=train, instruction="nl", reference="reference", n=2, seed=97)
    assert {r.n for r in icl.select(F.size("messages").alias("n")).collect()} == {6}
    with pytest.raises(ValueError):
        WF.build_prompts(test, "both")
    with pytest.raises(ValueError):
        WF.build_prompts(test, "rag")


def test_build_prompts_rag(spark):
    docs = fx.table(spark, SF01, "documents")
    queries = fx.retrieval_queries(spark, SF01)
    kb = fx.knowledge_base(spark, SF01)
    qtext = queries.select(F.col("query_id").alias("example_id"), (F.col("query_id") % 200).alias("d")) \
        .join(docs.select(F.col("doc_id").alias("d"), "text"), "d")
    test = PR.templated_messages(qtext.withColumn("none", F.lit(None).cast("string")), "text", "none", "conala")
    payload = kb.select("doc_id", (F.col("doc_id") % 200).alias("d")).join(
        docs.select(F.col("doc_id").alias("d"), F.col("text").alias("page_content"), F.col("source").alias("code")), "d")
    out = WF.build_prompts(test, "rag", queries=queries, kb=kb, payload=payload, n_retrieve=3, n_final=2,
                           rerank_token_dim=8)
    sizes = {r.n for r in out.select(F.size("messages").alias("n")).collect()}
    assert sizes == {6}
    assert out.count() == queries.count()


def test_api_messages_drop_placeholder_turn(spark):
    df = spark.createDataFrame([(1, "q", None), (2, "q", "a")], "i int, instr string, resp string")
    m = PR.templated_messages(df, "instr", "resp", "conala")
    got = {r.i: [x.role for x in r.m] for r in m.select("i", WF.api_messages("messages").alias("m")).collect()}
    assert got == {1: ["user"], 2: ["user", "assistant"]}


def test_evaluate_responses_tall(spark):
    cleaned = WF.clean_responses(fx.responses(spark, SF01), api_model="api_model", stops=["<|end|>", "\n```\n"])
    refs = fx.pairs(spark, SF01).select("example_id", "split", "reference")
    tall = WF.evaluate_responses(cleaned, refs)
    metrics = {r.metric: r.value for r in tall.collect()}
    assert set(metrics) == {"n_examples", "exact_match", "chrf", "chrf_pp"}
    assert metrics["n_examples"] == refs.count()
    assert 0 < metrics["chrf"] <= 100 and 0 < metrics["chrf_pp"] <= 100


def test_apps_report_and_position_slice(spark):
    o = fx.outcomes(spark, SF01)
    acc, pk = WF.apps_report(o, slices=[("interview", 0, 90), ("competition", 90, 120), ("introductory", 120, 150)],
                             ks=(1, 3))
    assert {r.difficulty for r in acc.collect()} == {"interview", "competition", "introductory"}
    assert {(r.difficulty, r.k) for r in pk.collect()} >= {("interview", 1)}
    assert WF.position_slice(o, 10, 20, "problem_id").select("problem_id").distinct().count() == 10
    assert PLACEHOLDER  # fixed value importable


def test_align_raises_on_missing_by_default(spark):
    from quarry.operators import align as AL
    refs = spark.createDataFrame([(1, "a"), (2, "b")], "example_id long, reference string")
    resp = spark.createDataFrame([(1, "a")], "example_id long, response string")
    with pytest.raises(Exception, match="unaligned"):
        AL.align(refs, resp).collect()
    assert AL.align(refs, resp, on_missing="wrong").count() == 2
    orphan = spark.createDataFrame([(3, "c")], "example_id long, response string")
    with pytest.raises(Exception, match="unaligned"):
        AL.align(refs, orphan, on_missing="wrong").collect()


def test_align_collapses_reference_copies_and_rejects_conflicts(spark):
    from quarry.operators import align as AL
    refs = spark.createDataFrame([(1, "a")] * 50 + [(2, "b")], "example_id long, reference string")
    resp = spark.createDataFrame([(1, "a"), (1, "a2"), (2, "b")], "example_id long, response string")
    out = AL.align(refs, resp).collect()
    assert len(out) == 3  # one reference row per id, one output row per response
    bad = spark.createDataFrame([(1, "a"), (1, "z")], "example_id long, reference string")
    with pytest.raises(Exception, match="conflicting references"):
        AL.align(bad, resp.where("example_id = 1")).collect()


def test_conflicting_copies_detected_with_nulls(spark):
    from quarry.operators import align as AL
    refs = spark.createDataFrame([(1, None, "x"), (1, "x", None)], "example_id long, reference string, split string")
    resp = spark.createDataFrame([(1, "x")], "example_id long, response string")
    with pytest.raises(Exception, match="conflicting references"):
        AL.align(refs, resp).collect()


def test_unknown_dataset_prefix_raises(spark):
    df = spark.createDataFrame([(1, "q", "a")], "i int, instr string, resp string")
    with pytest.raises(ValueError, match="no instruction prefix"):
        PR.templated_messages(df, "instr", "resp", "magicoder")
    custom = PR.templated_messages(df, "instr", "resp", F.lit("Solve:")).first().messages
    assert custom[0].content.startswith("Solve:\n```")


def test_prepare_keeps_null_split_rows(spark):
    df = spark.createDataFrame([(1, "train", "a", "b"), (2, None, "c", "d"), (3, "train", "e", "f"), (4, "test", "g", "h")],
                               "example_id long, split string, instruction string, response string")
    out = WF.prepare_dataset(df, "magicoder", "example_id", validation_size=1)
    assert out.count() == 4
    assert sorted((r.split or "") for r in out.collect()) == ["", "test", "train", "validation"]


def test_evaluate_null_group_keeps_chrf(spark):
    refs = spark.createDataFrame([(1, None, "same text")], "example_id long, split string, reference string")
    resp = spark.createDataFrame([(1, "same text")], "example_id long, response string")
    m = {r.metric: r.value for r in WF.evaluate_responses(resp, refs, group_by=["split"]).collect()}
    assert m["exact_match"] == 1.0 and m["chrf"] == pytest.approx(100.0) and m["chrf_pp"] == pytest.approx(100.0)


def test_prepare_checks_corpus_columns(spark):
    df = spark.createDataFrame([(1, "train", "q")], "example_id long, split string, nl string")
    with pytest.raises(ValueError, match="missing input columns"):
        WF.prepare_dataset(df, "conala", "example_id")


def test_build_prompts_rag_without_rerank_keeps_top_n_final(spark):
    docs = fx.table(spark, SF01, "documents")
    queries = fx.retrieval_queries(spark, SF01)
    kb = fx.knowledge_base(spark, SF01)
    qtext = queries.select(F.col("query_id").alias("example_id"), (F.col("query_id") % 200).alias("d")) \
        .join(docs.select(F.col("doc_id").alias("d"), "text"), "d")
    test = PR.templated_messages(qtext.withColumn("none", F.lit(None).cast("string")), "text", "none", "conala")
    payload = kb.select("doc_id", (F.col("doc_id") % 200).alias("d")).join(
        docs.select(F.col("doc_id").alias("d"), F.col("text").alias("page_content"), F.col("source").alias("code")), "d")
    out = WF.build_prompts(test, "rag", queries=queries, kb=kb, payload=payload, n_retrieve=4, n_final=1)
    assert {r.n for r in out.select(F.size("messages").alias("n")).collect()} == {4}
