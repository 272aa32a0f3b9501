"""A corpus pipeline over ``documents``: language identification, near-duplicate removal, mixing, packing.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet under the shared checkpoint
folder and read again as the next stage's ``docs``.  All but the last return the columns of ``docs`` (further ones
included, whatever their names); rows with NULLs, empty texts, repeated rows and empty tables are handled as the operators'
docstrings say.  As a stage's result is written before the next one begins, each stage begins by deleting the tables that earlier
stages left in the shared folder (but those that its ``docs`` still read).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import drop, materialise, n_words, named, roots, written
from quarry.llm.langid import train
from quarry.llm.mix import mix
from quarry.llm.neardup import near_duplicates
from quarry.llm.pack import pack
from quarry.llm.queries import language_of_documents, table, with_mix_columns


COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
_left: list[str] = []


def _stage(fn: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage whose further columns have names of their own inside it, and which deletes what earlier stages left behind."""
    @wraps(fn)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        read = roots(docs)
        old = [t for t in _left if not any(r.rstrip("/").endswith(t.split(":", 1)[-1]) for r in read)]
        drop(spark, old)
        _left[:] = [t for t in _left if t not in old]
        before = written()
        cols = docs.columns
        plain = [c if c in COLUMNS else f"further{i}" for i, c in enumerate(cols)]
        out = fn(spark, docs.toDF(*plain), sf_dir)
        _left.extend(written(before))
        return out.toDF(*cols) if out.columns == plain else out
    return run


@_stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents of a known language; texts without letters or like no language go."""
    found = language_of_documents(docs, train(docs.select("lang", "text")))
    return found.where("__kept").select(*named(docs.columns))


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group (five-word shingles, similarity 0.8): that of the smallest id."""
    return near_duplicates(docs, shingle=5, percent=80).where("__winner").select(*named(docs.columns))


@_stage
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    out = mix(with_mix_columns(spark, docs, sf_dir), draw=["doc_id", "__draw"])
    out = out.where("__times > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__times"))))
    return out.select(*named(docs.columns))


@_stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of documents in training sequences of 2048 words; repeats of a document never share one."""
    items = docs.select("doc_id", "source", n_words(F.col("text")).alias("__size"), F.xxhash64("text").alias("__cluster"))
    return pack(items, capacity=2048)


STAGES = [("language", language), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: trained models, union-find over sampled trees and sequential packing are not expressible in SQL; see tests/llm
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, f"stage-{name}")
    return docs
