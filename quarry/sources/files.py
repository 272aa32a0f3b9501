"""Sources and sinks.

Datasets are one DataFrame with a ``split`` column, stored ``partitionBy("split")`` so a split read
is a partition filter.  Responses are stored keyed, ``(example_id, gen_id, response)``; position is a
column, never file order.  Run outputs live under a partitioned run address instead of file-name
suffixes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators._check import require_columns

# Where a run's outputs live (``checkpoint`` follows below these).  strategy labels the prompt strategy as the run was made (none /
# icl / rag, and rag_rerank when retrieved documents were re-ranked); n is the number of exemplars or
# kept documents; seed the exemplar seed (NULL when unused); checkpoint names the fine-tuned weights
# (NULL for the base model); temperature is written with all its digits (two decimals at least), so different
# temperatures never share a directory.
RUN_ADDRESS = ["model", "dataset", "temperature", "strategy", "n", "seed"]


# S1 -------------------------------------------------------------------------------------------
def load_corpus(spark: SparkSession, path: str, fmt: str = "parquet", split: str | None = None,
                schema=None) -> DataFrame:
    """Raw corpus from local/distributed files; ``split`` tags every row when the files hold one split."""
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.load(path)
    return df.withColumn("split", F.lit(split)) if split is not None else df


# S2 / S3 --------------------------------------------------------------------------------------
def save_prepared(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    require_columns(df, "split")
    df.write.mode(mode).partitionBy("split").parquet(path)


def load_prepared(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """A prepared dataset, optionally one split (pruned to that partition directory).  A split without rows is an
    error, raised here (K8): one row is looked for, nothing else is read."""
    df = spark.read.parquet(path)
    if split is None:
        return df
    one = df.where(F.col("split") == split)
    if one.isEmpty():
        raise ValueError(f"no rows of split {split!r} under {path}")
    return one


# S4 -------------------------------------------------------------------------------------------
def read_response_lists(spark: SparkSession, path: str) -> DataFrame:
    """Import the legacy ``[[r], [r], ...]`` JSON file(s): one row per (file, position, generation).

    The legacy format is one JSON document per file, so each file is parsed by one task; it is an
    import path for existing result files — the engine's own format is ``write_responses``.
    """
    raw = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    parsed = F.from_json("value", "array<array<string>>")
    parsed = F.coalesce(parsed, F.raise_error(F.concat(F.lit("not a list of response lists: "), F.col("file"))))
    lists = raw.select("file", F.posexplode(parsed).alias("example_id", "gens"))
    # a position without responses stays, with NULLs
    return lists.select("file", F.col("example_id").cast("long").alias("example_id"),
                        F.posexplode_outer("gens").alias("gen_id", "response"))


# S5 / S6 / S7 ---------------------------------------------------------------------------------
def write_responses(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None,
                    mode: str = "overwrite") -> None:
    """Keyed responses; order is the ``example_id`` column, not the file order."""
    require_columns(df, "example_id", "response")
    w = df.write.mode(mode).format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def write_metrics(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    """Tall metric table ``(..., metric, value)`` as JSON lines (numbers stay numbers)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.json(path)


def to_tall(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Wide metric columns -> ``(keys..., metric, value DOUBLE)``."""
    return df.unpivot(keys, metrics, "metric", "value").withColumn("value", F.col("value").cast("double"))


def format_with_unit(value, unit: str):
    """``'<value> <unit>'`` — only at export; tables keep numbers."""
    v = F.col(value) if isinstance(value, str) else value
    return F.concat(v.cast("string"), F.lit(f" {unit}"))


def write_run_outputs(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Results addressed by (model, dataset, temperature, strategy, n, seed, checkpoint) partition directories;
    a frame without ``checkpoint`` holds runs of the base model.

    Idempotent per run: a dynamic partition overwrite replaces exactly the run addresses present in
    ``df`` (a rerun after a failure rewrites its own directory) and leaves every other run alone.
    """
    require_columns(df, *RUN_ADDRESS)
    t = F.col("temperature").cast("double")
    two = t.cast("decimal(20,2)")
    out = df.withColumn("temperature", F.when(two.cast("double") == t, two.cast("string")).otherwise(t.cast("string")))
    if "checkpoint" not in df.columns:
        out = out.withColumn("checkpoint", F.lit(None).cast("string"))
    (out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").format(fmt)
     .partitionBy(*RUN_ADDRESS, "checkpoint").save(path))


# S8 -------------------------------------------------------------------------------------------
def escape_lines(col) -> F.Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")),
                     F.lit("\r"), F.lit("\\r"))


def export_aligned_text(df: DataFrame, path: str, columns: dict[str, str], key: str = "example_id",
                        parts: int | None = None) -> None:
    """Line-aligned text files (e.g. predictions / references) in ``key`` order.

    All outputs come from ONE range partitioning: part i of every output holds the same key range,
    in the same order, so line j of ``kind=a/part-i`` pairs with line j of ``kind=b/part-i``.
    Newlines inside values are escaped.
    """
    require_columns(df, key, *columns.values())
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tall = df.select(key, F.inline(F.array(*[
        F.struct(F.lit(name).alias("kind"), escape_lines(F.col(c).cast("string")).alias("value"))
        for name, c in columns.items()])))
    (tall.repartitionByRange(parts, key).sortWithinPartitions("kind", key)
     .select("kind", "value").write.mode("overwrite").partitionBy("kind").text(path))


def unescape_lines(col) -> F.Column:
    """What ``escape_lines`` was given."""
    c = F.col(col) if isinstance(col, str) else col
    # escaped backslashes part the value into pieces in which every other mark stands for itself
    plain = F.transform(F.split(c, r"\\\\", -1), lambda x: F.replace(F.replace(x, F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r")))
    return F.array_join(plain, "\\")


def read_lines(spark: SparkSession, path: str, line: str = "line") -> DataFrame:
    """``(line, value)``: every line of the text files under ``path`` with its number from 0, files in the order of their names.

    Files are read in splits by many tasks.  A line's number is the number of lines in earlier splits (a table with one row per split)
    plus its place in its own.
    """
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_from"),
                                        F.monotonically_increasing_id().alias("_m"))
    splits = rows.groupBy("_file", "_from").agg(F.count(F.lit(1)).alias("_n"), F.min("_m").alias("_first"))
    before = Window.orderBy("_file", "_from").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("_file", "_from", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    out = rows.join(F.broadcast(splits), ["_file", "_from"])  # a row per split
    return out.select((F.col("_before") + F.col("_m") - F.col("_first")).alias(line), "value")


def read_aligned_text(spark: SparkSession, paths: dict[str, str], line: str = "line") -> DataFrame:
    """Line-aligned text files paired by position: ``line`` (from 0) and one column per name of ``paths``, newlines inside values
    restored.  Files of unequal numbers of lines raise when the result is read."""
    one = None
    for name, path in paths.items():
        part = read_lines(spark, path, line).select(line, unescape_lines("value").alias(name), F.lit(True).alias(f"_has_{name}"))
        one = part if one is None else one.join(part, line, "full")
    whole = F.lit(True)
    for name in paths:
        whole = whole & F.coalesce(F.col(f"_has_{name}"), F.lit(False))
    bad = F.raise_error(F.concat(F.lit("files of unequal length: line "), F.col(line).cast("string"), F.lit(" is not in all of them")))
    checked = F.when(whole, F.col(line)).otherwise(bad.cast("long"))
    return one.select(checked.alias(line), *paths)


# P11 ------------------------------------------------------------------------------------------
def preview(df: DataFrame, n: int = 10, key: str = "example_id") -> DataFrame:
    """The first n positions (``key < n``), deterministic unlike ``limit``."""
    return df.where(F.col(key) < n).orderBy(key)
