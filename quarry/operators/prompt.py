"""Prompt and message construction.

Messages are ``ARRAY<STRUCT<role STRING, content STRING>>``.  Every operator here is a narrow
transformation (a projection): no shuffle, whole-stage codegen, one pass over the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import (CORPUS_COLUMNS, DATASET_CONFIG, DATASET_CONFIG_DEFAULT,
                               INSTRUCTION_PREFIX, IO_MARKER_WITH_FN_NAME,
                               IO_MARKER_WITHOUT_FN_NAME, PLACEHOLDER, PYTHON_FENCE_OPEN, TESTS_SENTENCE)
from ..functions.text import (_c, _lit, empty_to_null, json_first_element, json_truthy_field,
                              last_segment, message, py_strip, strict_lookup)
from ._check import require_columns


# P3 -------------------------------------------------------------------------------------------
def plain_messages(df: DataFrame, user_col: str, assistant_col: str, out: str = "messages") -> DataFrame:
    """Two-turn conversation with no template: ``[{user: u}, {assistant: a}]``."""
    require_columns(df, user_col, assistant_col)
    return df.withColumn(out, F.array(message("user", F.col(user_col)),
                                      message("assistant", F.col(assistant_col))))


# P4 / P5 --------------------------------------------------------------------------------------
def templated_turns(instruction, response, prefix) -> Column:
    """The two templated turns: prefix + fenced stripped instruction; answer in a python fence.

    A NULL response becomes the placeholder (P5), which a later render cut removes (T1).
    """
    user = F.concat(_lit(prefix), F.lit("\n```\n"), py_strip(instruction), F.lit("\n```"))
    answer = F.concat(F.lit(PYTHON_FENCE_OPEN),
                      F.coalesce(py_strip(response), F.lit(PLACEHOLDER)), F.lit("\n```"))
    return F.array(message("user", user), message("assistant", answer))


def resolve_prefix(prefix) -> Column:
    """A dataset name (looked up strictly, F8: unknown names raise) or a Column (e.g. ``F.lit(text)``
    or ``prefix_for(dataset_col)``)."""
    if isinstance(prefix, Column):
        return prefix
    if prefix not in INSTRUCTION_PREFIX:
        raise ValueError(f"no instruction prefix for dataset {prefix!r}; known: {sorted(INSTRUCTION_PREFIX)}"
                         " (pass F.lit(text) for a custom prefix)")
    return F.lit(INSTRUCTION_PREFIX[prefix])


def templated_messages(df: DataFrame, instruction_col: str, response_col: str, prefix,
                       out: str = "messages") -> DataFrame:
    """``prefix`` is a dataset name (strict, F8) or a Column."""
    require_columns(df, instruction_col, response_col)
    return df.withColumn(out, templated_turns(F.col(instruction_col), F.col(response_col), resolve_prefix(prefix)))


def prefix_for(dataset_col) -> Column:
    """F8: instruction prefix of a dataset-name column; unknown names raise."""
    return strict_lookup(INSTRUCTION_PREFIX, dataset_col)


# P6 -------------------------------------------------------------------------------------------
def blind_test_labels(df: DataFrame, response_col: str, split_col: str = "split",
                      test_split: str = "test") -> DataFrame:
    """Null the answer on the test split so the prompt ends in the placeholder."""
    require_columns(df, response_col, split_col)
    return df.withColumn(response_col, F.when(F.col(split_col) == test_split, F.lit(None).cast("string"))
                         .otherwise(F.col(response_col)))


# P7 -------------------------------------------------------------------------------------------
def prompt_with_tests(text, tests) -> Column:
    """``text + ' Your code should pass these tests:' + ''.join('\\n' + t for t in tests)``."""
    lines = F.transform(F.coalesce(_c(tests), F.array().cast("array<string>")),
                        lambda t: F.concat(F.lit("\n"), t))
    return F.concat(_c(text), F.lit(TESTS_SENTENCE), F.array_join(lines, ""))


# P8 -------------------------------------------------------------------------------------------
def prompt_io_mode(question, starter_code, input_output, invert_io_marker: bool = False) -> Column:
    """Question, then starter code (no separator, K1), then the I/O-mode line.

    As in the prepared data, a present ``fn_name`` yields the "Standard Input" line (K1); pass
    ``invert_io_marker=True`` for the opposite mapping.
    """
    fn_name = json_truthy_field(input_output, "fn_name")
    with_fn, without_fn = IO_MARKER_WITH_FN_NAME, IO_MARKER_WITHOUT_FN_NAME
    if invert_io_marker:
        with_fn, without_fn = without_fn, with_fn
    marker = F.when(fn_name.isNotNull(), F.lit(with_fn)).otherwise(F.lit(without_fn))
    return F.concat(_c(question), F.coalesce(empty_to_null(starter_code), F.lit("")), marker)


def apps_messages(df: DataFrame, split_col: str = "split", strict: bool = True,
                  out: str = "messages") -> DataFrame:
    """Full APPS preparation: P8 prompt, F6 first solution, P6 blind test, P4 template.

    A row outside the test split must have an answer: an empty ``solutions`` array raises (``strict``), or, with
    ``strict=False``, gives an empty answer; the placeholder stands for blinded answers only.
    """
    require_columns(df, "question", "starter_code", "input_output", "solutions", split_col)
    answer = F.when(F.col(split_col) == "test", F.lit(None).cast("string")) \
        .otherwise(F.coalesce(json_first_element("solutions", strict=strict), F.lit("")))
    prompt = prompt_io_mode("question", "starter_code", "input_output")
    return df.withColumn(out, templated_turns(prompt, answer, INSTRUCTION_PREFIX["apps"]))


# P9 / F3 --------------------------------------------------------------------------------------
def dataset_config(df: DataFrame, path_col: str) -> DataFrame:
    """Dataset name = last path segment; then (max_new_tokens, instruction_field, reference_field).

    A map literal (constant-folded) replaces a dimension join; names not listed take the default row.
    """
    require_columns(df, path_col)
    entries = []
    for name, (tokens, instr, ref) in DATASET_CONFIG.items():
        entries += [F.lit(name), F.struct(F.lit(tokens).alias("max_new_tokens"),
                                          F.lit(instr).alias("instruction_field"),
                                          F.lit(ref).alias("reference_field"))]
    tokens, instr, ref = DATASET_CONFIG_DEFAULT
    default = F.struct(F.lit(tokens).alias("max_new_tokens"), F.lit(instr).alias("instruction_field"),
                       F.lit(ref).alias("reference_field"))
    name = last_segment(F.col(path_col))
    cfg = F.coalesce(F.try_element_at(F.create_map(*entries), name), default)
    return df.withColumn("dataset_name", name).select("*", cfg.alias("_cfg")).select(
        *[c for c in df.columns], "dataset_name", "_cfg.max_new_tokens", "_cfg.instruction_field",
        "_cfg.reference_field")


# P10 / U1 -------------------------------------------------------------------------------------
def normalize_corpus(df: DataFrame, corpus: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Map a corpus' own columns to ``(dataset, instruction, reference)``."""
    if corpus not in CORPUS_COLUMNS:
        raise ValueError(f"unknown corpus {corpus!r}; known: {sorted(CORPUS_COLUMNS)}")
    instr, ref = CORPUS_COLUMNS[corpus]
    require_columns(df, instr, ref, *keep)
    return df.select(*keep, F.lit(corpus).alias("dataset"), F.col(instr).cast("string").alias("instruction"),
                     F.col(ref).cast("string").alias("reference"))


def union_corpora(frames: list[DataFrame]) -> DataFrame:
    """Bag union by column name (joint training set); provenance is the ``dataset`` column."""
    if not frames:
        raise ValueError("no corpora to union")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
