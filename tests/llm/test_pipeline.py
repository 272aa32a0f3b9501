"""The corpus pipeline, stage by stage, and its edge cases."""

from collections import defaultdict

import corpus_pipeline as CP
from test_neardup import brute

SF = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    docs = CP.table(spark, SF, "documents")
    columns, sizes = docs.columns, [docs.count()]
    for i, (name, stage) in enumerate(CP.STAGES):
        before = docs
        docs = CP.materialise(stage(spark, docs, SF), name)
        sizes.append(docs.count())
        if i < 3:
            assert docs.columns == columns
        if name == "language":
            assert sizes[-1] == sizes[-2]  # this table has no junk; clean documents stay
        if name == "near_dedup":
            rows = [tuple(r) for r in before.select("doc_id", "text").collect()]
            keep = {c for _, _, c in brute(rows, 5)}
            assert {r["doc_id"] for r in docs.select("doc_id").collect()} == keep
    final = sorted(map(str, docs.collect()))
    assert sorted(map(str, CP.run(spark, SF).collect())) == final
    bins = defaultdict(list)
    for r in docs.collect():
        bins[r["bin_id"]].append(r)
    assert all(sum(r["words"] for r in rs) <= 2048 for rs in bins.values())
    assert all(len({r["doc_id"] for r in rs}) == len(rs) for rs in bins.values())


def test_odd_rows(spark, odd_docs, no_docs):
    docs = odd_docs
    for name, stage in CP.STAGES:
        docs = CP.materialise(stage(spark, docs, SF), name)
        if name == "near_dedup":  # of the texts with letters one of each group
            assert {r["doc_id"] for r in docs.select("doc_id").collect()} <= {1, 6, 7, 9}
    docs = no_docs
    for name, stage in CP.STAGES:
        docs = CP.materialise(stage(spark, docs, SF), name)
    assert docs.count() == 0


def test_names_of_the_operators_own(spark):
    """Further columns named like the operators' own come through every stage with their values."""
    own = ["__kept", "__winner", "__q", "__id", "__times", "__size", "__draw", "further6", "a.b"]
    base = CP.table(spark, SF, "documents").limit(60)
    docs = base.selectExpr("*", *[f"concat('{c}', doc_id) as `{c}`" for c in own])
    for name, stage in CP.STAGES[:3]:
        docs = CP.materialise(stage(spark, docs, SF), name)
        assert docs.columns == base.columns + own
    assert docs.where(" or ".join(f"`{c}` <> concat('{c}', doc_id)" for c in own)).isEmpty() and not docs.isEmpty()


def test_stages_delete_what_earlier_ones_left(spark):
    docs = CP.table(spark, SF, "documents")
    one = CP.STAGES[0][1](spark, docs, SF)
    left = list(CP._left)
    assert left
    # not written: the next stage still reads what the first one left
    two = CP.STAGES[1][1](spark, one, SF)
    assert two.count() > 0
    CP.STAGES[3][1](spark, docs, SF)
    assert not set(left) & set(CP.written())
