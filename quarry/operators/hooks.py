"""Caller-supplied model hooks (X2 generation, X3 embedding).

Model inference is out of scope; these operators run an injected callable over Arrow batches
(``mapInPandas``) so the DataFrame stays distributed.  The callables receive a ``pd.Series`` of
strings per batch and must be picklable; tests inject deterministic stubs.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._check import require_columns


def generate_with(df: DataFrame, fn: Callable[[pd.Series], pd.Series], prompt_col: str = "prompt",
                  out: str = "response") -> DataFrame:
    """``out = fn(prompt)`` batch by batch."""
    require_columns(df, prompt_col)
    if out != prompt_col:
        df = df.drop(out)  # a rerun replaces an earlier response column
    schema = T.StructType([f for f in df.schema.fields if f.name != out] + [T.StructField(out, T.StringType(), True)])

    def run(batches):
        for pdf in batches:
            res = fn(pdf[prompt_col])
            pdf[out] = pd.Series(list(res), index=pdf.index, dtype="object")
            yield pdf

    return df.mapInPandas(run, schema)


_MODELS: dict[str, Callable[[pd.Series], pd.Series]] = {}


def _model(token: str, factory: Callable[[], Callable[[pd.Series], pd.Series]]) -> Callable[[pd.Series], pd.Series]:
    """The model of a run, built once per worker process."""
    if token not in _MODELS:
        _MODELS[token] = factory()
    return _MODELS[token]


def generate_resumable(df: DataFrame, factory: Callable[[], Callable[[pd.Series], pd.Series]], path: str,
                       keys: tuple[str, ...] = ("example_id",), prompt_col: str = "prompt", out: str = "response",
                       batches: int = 16) -> DataFrame:
    """X2 that survives a failure: ``(keys..., out)`` of every row of ``df``, kept under ``path``.

    Rows are cut by a hash of their keys into ``batches``, each generated and appended by a job of its own.  A rerun with the same
    ``path`` calls the model only for keys without an answer there: what a failed run had written stays, and as files appear whole or
    not at all, a key has its answer exactly once.  ``factory`` builds the model, once per worker process of a run.

    Keys are unique in ``df``; a NULL key is a key like any other.  An answer that is NULL counts as given.  Rows of ``path`` whose key is
    no longer in ``df`` stay there and are not returned.
    """
    require_columns(df, prompt_col, *keys)
    asked = df.select(*keys, F.col(prompt_col).alias("_prompt"))
    given = _resume(asked, factory, path, keys, T.StructField(out, T.StringType(), True), lambda res: list(res), batches)
    wanted = df.select(*keys)
    return given.join(wanted, _same(given, wanted, keys), "left_semi")


def _same(a: DataFrame, b: DataFrame, keys: tuple[str, ...]) -> Column:
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in keys])


def _kept(spark: SparkSession, schema: T.StructType, path: str) -> DataFrame:
    """The answers under ``path``; none if nothing has been written there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def _resume(asked: DataFrame, factory: Callable, path: str, keys: tuple[str, ...], out: T.StructField, values: Callable,
            batches: int) -> DataFrame:
    """All answers under ``path`` once every key of ``asked`` (keys and ``_prompt``) has one; ``values`` turns what the model gives into
    a list of column values."""
    spark, token = asked.sparkSession, uuid.uuid4().hex
    schema = T.StructType([asked.schema[k] for k in keys] + [out])

    def run(rows):
        model = _model(token, factory)
        for pdf in rows:
            pdf[out.name] = pd.Series(values(model(pdf["_prompt"])), index=pdf.index, dtype="object")
            yield pdf[[*keys, out.name]]

    done = _kept(spark, schema, path).select(*keys)
    todo = asked.join(done, _same(asked, done, keys), "left_anti")
    todo = todo.withColumn("_batch", F.pmod(F.xxhash64(*keys), F.lit(batches)))
    for r in todo.groupBy("_batch").count().orderBy("_batch").collect():  # a row per batch
        one = todo.where(F.col("_batch") == r["_batch"]).drop("_batch").select(*keys, "_prompt")
        one.mapInPandas(run, schema).write.mode("append").parquet(path)
    return _kept(spark, schema, path)


def l2_normalise(vec) -> Column:
    """Scale a vector to unit length (a zero vector stays zero)."""
    v = F.col(vec) if isinstance(vec, str) else vec
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    # the norm is evaluated once (as array_repeat's argument) and zipped in: O(d), not O(d^2)
    norms = F.array_repeat(norm, F.size(v))
    return F.when(norm > 0, F.zip_with(v, norms, lambda x, n: (x.cast("double") / n).cast("float"))).otherwise(
        F.transform(v, lambda x: x.cast("float")))


def embed_with(df: DataFrame, fn: Callable[[pd.Series], object], text_col: str = "text",
               out: str = "embedding", normalise: bool = True) -> DataFrame:
    """``out = fn(text)`` (a 2-D array or a sequence of vectors per batch), then L2-normalised
    JVM-side.  Where the encoder gives None, as it may for a NULL text, the vector is NULL."""
    require_columns(df, text_col)
    if out != text_col:
        df = df.drop(out)
    schema = T.StructType([f for f in df.schema.fields if f.name != out]
                          + [T.StructField(out, T.ArrayType(T.FloatType()), True)])

    def run(batches):
        for pdf in batches:
            vecs = fn(pdf[text_col])
            pdf[out] = [None if v is None else np.asarray(v, dtype="float32") for v in vecs]
            yield pdf

    res = df.mapInPandas(run, schema)
    return res.withColumn(out, l2_normalise(out)) if normalise else res


def embed_incremental(df: DataFrame, factory: Callable[[], Callable[[pd.Series], object]], path: str, keys: tuple[str, ...],
                      text_col: str = "text", out: str = "embedding", normalise: bool = True, batches: int = 16) -> DataFrame:
    """X3 for a table that changes: ``(keys..., out)`` of every row of ``df``, with vectors kept under ``path`` by content.

    The store holds a vector per text, addressed by the text's SHA-256.  A call encodes only texts that it lacks, each once however
    many rows hold it, in batches as ``generate_resumable`` does; so a failed run goes on where it ended, and a changed table costs its
    new texts.  The store keeps vectors as the encoder gives them, ``normalise`` applies to what is returned.  ``factory`` builds the
    encoder, once per worker process.  Another encoder needs another ``path``.

    Rows with a NULL text, or one for which the encoder gives None, get a NULL vector; NULL texts never reach the encoder.  Keys are
    passed through as they are, repeated or NULL ones included.
    """
    require_columns(df, text_col, *keys)
    spark = df.sparkSession
    vectors = T.StructField(out, T.ArrayType(T.FloatType()), True)
    content = F.sha2(F.col(text_col).cast("binary"), 256)
    texts = df.where(F.col(text_col).isNotNull()).select(content.alias("_content"), F.col(text_col).alias("_prompt"))
    done = _kept(spark, T.StructType([texts.schema["_content"], vectors]), path).select("_content")
    new = texts.select("_content").distinct().join(done, "_content", "left_anti")  # narrow: known texts are not moved
    asked = texts.join(new, "_content", "left_semi").groupBy("_content").agg(F.first("_prompt").alias("_prompt"))

    def values(res):
        return [None if v is None else np.asarray(v, dtype="float32") for v in res]

    store = _resume(asked, factory, path, ("_content",), vectors, values, batches)
    res = df.select(*keys, content.alias("_content")).join(store, "_content", "left").select(*keys, out)
    return res.withColumn(out, l2_normalise(out)) if normalise else res
