"""Resumable generation and line-aligned import."""

import pytest
from pyspark.sql import functions as F

from quarry.operators import hooks as HK
from quarry.session import scratch_path
from quarry.sources import files as IO


def logged(folder, fail_on=None):
    """A model that logs every prompt in a file of its own, and every time it is built."""
    import os
    import uuid

    def note(kind, text):
        with open(os.path.join(folder, f"{kind}-{uuid.uuid4().hex}"), "w") as f:
            f.write(text)

    def factory():
        note("built", str(os.getpid()))

        def model(prompts):
            if fail_on is not None and fail_on in set(prompts):
                raise RuntimeError("model failed")
            for p in prompts:
                note("asked", p)
            return prompts.str.upper()
        return model
    return factory


def asked(folder, kind="asked"):
    return sorted(f.read_text() for f in folder.glob(f"{kind}-*"))


def test_rerun_asks_only_for_the_rest(spark, tmp_path):
    df = spark.createDataFrame([(i, g, f"p{i}.{g}") for i in range(20) for g in range(2)] + [(None, 0, "pn")], "example_id long, gen_id int, prompt string")
    path = scratch_path(spark, "answers")
    one, two = tmp_path / "one", tmp_path / "two"
    one.mkdir()
    two.mkdir()
    with pytest.raises(Exception, match="model failed"):
        HK.generate_resumable(df, logged(str(one), "p11.1"), path, ("example_id", "gen_id"), batches=6)
    kept = spark.read.parquet(path).count()
    assert 0 < kept < 41
    res = HK.generate_resumable(df, logged(str(two)), path, ("example_id", "gen_id"), batches=6)
    got = {(r["example_id"], r["gen_id"]): r["response"] for r in res.collect()}
    assert res.count() == 41 and got == {(r["example_id"], r["gen_id"]): r["prompt"].upper() for r in df.collect()}
    assert len(asked(two)) == 41 - kept
    built = asked(two, "built")
    assert len(built) == len(set(built))  # once per worker process
    HK.generate_resumable(df, logged(str(two)), path, ("example_id", "gen_id"))
    assert len(asked(two)) == 41 - kept  # nothing left to ask
    part = HK.generate_resumable(df.where("example_id < 3"), logged(str(two)), path, ("example_id", "gen_id"))
    assert part.count() == 6
    empty = HK.generate_resumable(df.limit(0), logged(str(two)), scratch_path(spark, "answers"), ("example_id", "gen_id"))
    assert empty.count() == 0


ODD = ["plain", "", "two\nlines", "back\\slash", "\\n", "\\\\n\r\n", "\\", "x\\\\", "é漢", " "]


def test_lines_come_back_paired(spark):
    rows = [(i, ODD[i % len(ODD)] + str(i // 50), f"ref {i}") for i in range(1000)]
    df = spark.createDataFrame(rows, "example_id long, a string, b string").repartition(7)
    path = scratch_path(spark, "aligned")
    IO.export_aligned_text(df, path, {"a": "a", "b": "b"}, parts=5)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        for size in ("200b", "128m"):  # many splits of a file, and several files in a task
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            back = IO.read_aligned_text(spark, {k: f"{path}/kind={k}" for k in "ab"})
            assert sorted(tuple(r) for r in back.collect()) == rows
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])


def test_unequal_files_raise(spark):
    path = scratch_path(spark, "unequal")
    spark.range(5).select(F.col("id").cast("string")).coalesce(1).write.text(f"{path}/a")
    spark.range(4).select(F.col("id").cast("string")).coalesce(1).write.text(f"{path}/b")
    with pytest.raises(Exception, match="unequal length: line 4"):
        IO.read_aligned_text(spark, {"a": f"{path}/a", "b": f"{path}/b"}).collect()
    assert [r["line"] for r in IO.read_lines(spark, f"{path}/a").orderBy("line").collect()] == list(range(5))


def test_only_new_texts_reach_the_encoder(spark, tmp_path):
    def encoder(folder, fail_on=None):
        make = logged(folder, fail_on)

        def factory():
            model = make()
            return lambda texts: [None if t == "none" else [float(len(t)), 0.0] for t in model(texts).str.lower()]
        return factory

    schema, path = "doc_id long, text string", scratch_path(spark, "vectors")
    folders = [tmp_path / x for x in ("one", "two", "three")]
    for f in folders:
        f.mkdir()
    old = [(i, f"t{i % 30}") for i in range(300)] + [(900, "hot")] * 200  # copies, one text held by many rows
    df = spark.createDataFrame(old, schema)
    with pytest.raises(Exception, match="model failed"):
        HK.embed_incremental(df, encoder(str(folders[0]), "t7"), path, ("doc_id",), batches=8)
    kept = spark.read.parquet(path).count()
    assert 0 < kept < 31
    assert HK.embed_incremental(df, encoder(str(folders[1])), path, ("doc_id",), batches=8).count() == 500
    assert len(asked(folders[1])) == len(set(asked(folders[1]))) == 31 - kept
    # rows added, changed and removed; a row without a text
    now = spark.createDataFrame(old[50:] + [(1, "t1 changed"), (2, None), (None, "t5"), (4, ""), (5, "none")], schema)
    res = HK.embed_incremental(now, encoder(str(folders[2])), path, ("doc_id",), normalise=False)
    assert asked(folders[2]) == ["", "none", "t1 changed"]
    got = {(r["doc_id"], tuple(r["embedding"]) if r["embedding"] is not None else None) for r in res.collect()}
    want = {(i, None if t in (None, "none") else (float(len(t)), 0.0))
            for i, t in [*old[50:], (1, "t1 changed"), (2, None), (None, "t5"), (4, ""), (5, "none")]}
    assert got == want and res.count() == now.count()
    assert HK.embed_incremental(df.limit(0), encoder(str(folders[2])), scratch_path(spark, "no-vectors"), ("doc_id",)).count() == 0
