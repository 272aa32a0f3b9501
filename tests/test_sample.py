"""Seeded shuffle, carving and exemplar sampling: invariants and plan shape."""

import pytest
from pyspark.sql import functions as F

from paths import SF01
from plan_util import plan_text
from quarry.operators import fewshot as FS
from quarry.operators import sample as SA
from quarry.plans import fixtures as fx


@pytest.fixture(scope="module")
def docs(spark):
    return fx.table(spark, SF01, "documents").select("doc_id", "source")


def _split_map(df):
    return {r.doc_id: r.split for r in df.select("doc_id", "split").collect()}


def test_carve_disjoint_exhaustive(docs):
    out = SA.carve(docs, "doc_id", 100, seed=42)
    m = _split_map(out)
    assert len(m) == docs.count() == out.count()
    assert sum(v == "validation" for v in m.values()) == 100
    assert set(m.values()) == {"validation", "train"}


def test_carve_partition_independent(docs):
    a = _split_map(SA.carve(docs.repartition(1), "doc_id", 100, seed=42))
    b = _split_map(SA.carve(docs.repartition(7), "doc_id", 100, seed=42))
    assert a == b


def test_carve_seed_sensitive(docs):
    a = _split_map(SA.carve(docs, "doc_id", 100, seed=42))
    b = _split_map(SA.carve(docs, "doc_id", 100, seed=777))
    assert a != b


def test_carve_too_many_raises(docs):
    with pytest.raises(Exception, match="cannot select"):
        SA.carve(docs, "doc_id", 10_000, seed=42).collect()


@pytest.mark.parametrize("n", [0, 1, 299, 300, 301, 1000])
def test_buckets_do_not_change_the_selection(docs, monkeypatch, n):
    whole = _split_map(SA.carve(docs, "doc_id", n, seed=5))
    monkeypatch.setattr(SA, "BUCKET_ROWS", 7)
    assert whole == _split_map(SA.carve(docs, "doc_id", n, seed=5))
    first = {r.doc_id for r in SA.first_n(docs, "doc_id", n, 5).collect()}
    assert first == {i for i, split in whole.items() if split == "validation"}


@pytest.mark.parametrize("reuse", ["true", "false"])
def test_large_carve_is_exact_without_exchange_reuse(spark, reuse):
    ids = spark.range(0, 200_000, 1, 16).withColumnRenamed("id", "doc_id")
    before = spark.conf.get("spark.sql.exchange.reuse")
    try:
        spark.conf.set("spark.sql.exchange.reuse", reuse)
        got = SA.carve(ids, "doc_id", 100_500, seed=1).where("split = 'validation'").select("doc_id")
        want = ids.withColumn("k", SA.shuffle_key("doc_id", 1)).orderBy("k", "doc_id").limit(100_500).select("doc_id")
        assert got.count() == 100_500 and got.exceptAll(want).count() == 0
    finally:
        spark.conf.set("spark.sql.exchange.reuse", before)


def test_an_empty_train_split_raises(docs):
    none = docs.where("doc_id < 0")
    for df in (SA.carve(none, "doc_id", 5), SA.first_n(none, "doc_id", 5, 1), SA.first_n_by_seed(none, "doc_id", 5, [1, 2])):
        with pytest.raises(Exception, match="cannot select 5 rows from 0 rows"):
            df.collect()


def test_carve_moves_ids_alone(docs):
    plan = plan_text(SA.carve(docs, "doc_id", 100, seed=42))
    assert "CartesianProduct" not in plan and "SinglePartition" not in plan.split("Subquery")[0].replace("functions=[count(1)]", "")


def test_first_n_nested(spark):
    train = fx.pairs(spark, SF01).where("split = 'train'")
    ids = [[r.example_id for r in SA.first_n(train, "example_id", n, 777).orderBy("rank").collect()]
           for n in (1, 2, 3)]
    assert ids[0] == ids[1][:1] and ids[1] == ids[2][:2]


def test_first_n_ranks(spark):
    train = fx.pairs(spark, SF01).where("split = 'train'")
    ranks = sorted(r["rank"] for r in SA.first_n(train, "example_id", 5, 42).collect())
    assert ranks == [1, 2, 3, 4, 5]


def test_icl_prompt_message_count_and_no_join(spark):
    p = fx.pairs(spark, SF01)
    from quarry.operators import prompt as P
    test = P.templated_messages(p.where("split = 'test'").withColumn("none", F.lit(None).cast("string")),
                                "nl", "none", "conala")
    out = FS.icl_prompt(test, p.where("split = 'train'"), 2, 42, "example_id", "nl", "reference", "conala")
    sizes = {r.n for r in out.select(F.size("messages").alias("n")).collect()}
    assert sizes == {2 * 2 + 2}
    plan = plan_text(out)
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert "Subquery" in plan


def test_complement_and_split_sizes(docs):
    carved = SA.carve(docs, "doc_id", 50, seed=1)
    chosen = carved.where("split = 'validation'")
    rest = SA.complement(docs, chosen, "doc_id")
    assert rest.count() == docs.count() - 50
    sizes = {r.split: r.n_rows for r in SA.split_sizes(carved).collect()}
    assert sizes == {"validation": 50, "train": docs.count() - 50}


def test_first_n_by_seed_matches_single_seed_and_plans_group_limit(spark):
    train = fx.pairs(spark, SF01).where("split = 'train'")
    multi = SA.first_n_by_seed(train, "example_id", 3, [42, 777, 97])
    got = {}
    for r in multi.collect():
        got.setdefault(r.seed, {})[r["rank"]] = r.example_id
    for seed in (42, 777, 97):
        single = {r["rank"]: r.example_id for r in SA.first_n(train, "example_id", 3, seed).collect()}
        assert got[seed] == single
    plan = plan_text(multi)
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_icl_grid_equals_single_configs_without_cross_join(spark):
    from quarry.functions.text import render_cut
    from quarry.operators import prompt as P
    p = fx.pairs(spark, SF01)
    test = P.templated_messages(p.where("split = 'test'").withColumn("none", F.lit(None).cast("string")),
                                "nl", "none", "conala")
    train = p.where("split = 'train'")
    grid = FS.icl_grid(test, train, [1, 2], [42, 97], "example_id", "nl", "reference", "conala")
    plan = plan_text(grid)
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    got = {(r.seed, r.n, r.example_id): r.p for r in grid.select("seed", "n", "example_id", render_cut("messages").alias("p")).collect()}
    for seed in (42, 97):
        for n in (1, 2):
            one = FS.icl_prompt(test, train, n, seed, "example_id", "nl", "reference", "conala")
            for r in one.select("example_id", render_cut("messages").alias("p")).collect():
                assert got[(seed, n, r.example_id)] == r.p


def test_seeded_order_prefix_equals_first_n(spark):
    train = fx.pairs(spark, SF01).where("split = 'train'")
    ordered = [r.example_id for r in SA.seeded_order(train, "example_id", 5432).select("example_id").collect()]
    first = [r.example_id for r in SA.first_n(train, "example_id", 7, 5432).orderBy("rank").collect()]
    assert ordered[:7] == first
    assert sorted(ordered) == sorted(r.example_id for r in train.select("example_id").collect())


def test_carve_zero_rows_keeps_everything_in_rest(docs):
    m = _split_map(SA.carve(docs, "doc_id", 0, seed=42))
    assert set(m.values()) == {"train"} and len(m) == docs.count()


@pytest.mark.parametrize("small", [1, 3, 10_000])
def test_cut_equals_the_sorted_order(spark, small):
    """Radix counts find the n-th key for every n, with NULL and repeated ids, whatever the bucket size."""
    ids = [f"id{i}" for i in range(60)] + ["id3", "id4"]
    df = spark.createDataFrame([(i,) for i in [*ids, None, None]], "id string")
    keys = [r[0] for r in df.orderBy(SA.shuffle_key("id", 7), "id").collect()]
    for n in (1, 2, 3, 17, 63, 64):
        got = [r[0] for r in df.where(SA._cuts(df, "id", n, [7], small)[7]).collect()]
        first = set(keys[:n])
        assert sorted(map(str, got)) == sorted(str(k) for k in keys if k in first)
    assert SA._cuts(df, "id", 65, [7], small) is None


def test_carve_is_a_projection(spark):
    df = spark.range(1000).selectExpr("id", "repeat('text ', 50) as text")
    plan = SA.carve(df, "id", 300, seed=1)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    assert SA.carve(df, "id", 300, seed=1).where("split = 'validation'").count() == 300
    assert SA.carve(df, "id", 0, seed=1).where("split = 'validation'").isEmpty()
