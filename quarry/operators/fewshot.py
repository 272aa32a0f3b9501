"""In-context (few-shot) prompt assembly.

The n exemplars are drawn once per (seed, n) with a bounded top-n, turned into templated turns,
ordered by their shuffle rank and flattened into ONE array — a single-row aggregate whose size is
bounded by n.  That array enters every test row as a scalar subquery (evaluated once, shipped as a
constant), so there is no join at all, let alone a cross join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import concat_messages
from .prompt import resolve_prefix, templated_turns
from .sample import first_n, first_n_by_seed


def ordered_turns(df: DataFrame, rank_col: str, turns_col: str) -> Column:
    """Aggregate expression flattening per-row turn arrays in rank order (never bare collect_list)."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(rank_col).alias("rk"), F.col(turns_col).alias("t"))))
    return F.flatten(F.transform(pairs, lambda x: x["t"]))


def exemplar_turns(train: DataFrame, n: int, seed: int, id_col: str, instruction, reference,
                   prefix) -> DataFrame:
    """One row, one column ``icl``: the n exemplars' templated turns, best-ranked first."""
    prefix = resolve_prefix(prefix)
    ex = first_n(train, id_col, n, seed, rank_col="_rank")
    inst = F.col(instruction) if isinstance(instruction, str) else instruction
    ref = F.col(reference) if isinstance(reference, str) else reference
    ex = ex.select("_rank", templated_turns(inst, ref, prefix).alias("_turns"))
    return ex.agg(ordered_turns(ex, "_rank", "_turns").alias("icl"))


def icl_prompt(test: DataFrame, train: DataFrame, n: int, seed: int, id_col: str, instruction,
               reference, prefix, messages_col: str = "messages") -> DataFrame:
    """Prepend the same n exemplar turns to every test row's messages.

    ``prefix`` is a dataset name (strict) or a Column.

    For APPS pass ``reference=json_first_element('solutions')`` (K7: always the first solution).
    """
    icl = exemplar_turns(train, n, seed, id_col, instruction, reference, prefix)
    return test.withColumn(messages_col, concat_messages(icl.scalar(), F.col(messages_col)))


def icl_grid(test: DataFrame, train: DataFrame, ns: list[int], seeds: list[int], id_col: str, instruction,
             reference, prefix, messages_col: str = "messages") -> DataFrame:
    """T7 over the whole (n, seed) grid in one job: one row per (test row, seed, n).

    One scan draws max(n) exemplars for every seed (``first_n_by_seed``); for each configuration the
    first n of them (nested: n=1 is a prefix of n=2, ...) form one bounded array — a table of
    len(ns) x len(seeds) rows, broadcast.  Test rows are replicated per configuration by
    ``explode`` of a literal array and equi-joined on (seed, n): no cross join.
    """
    prefix = resolve_prefix(prefix)
    inst = F.col(instruction) if isinstance(instruction, str) else instruction
    ref = F.col(reference) if isinstance(reference, str) else reference
    ex = first_n_by_seed(train, id_col, max(ns), seeds, rank_col="_rank", seed_col="seed")
    ex = ex.select("seed", "_rank", templated_turns(inst, ref, prefix).alias("_turns"))
    cfg = ex.select("*", F.explode(F.array(*[F.lit(int(n)) for n in ns])).alias("n")) \
        .where(F.col("_rank") <= F.col("n"))
    per_cfg = cfg.groupBy("seed", "n").agg(ordered_turns(cfg, "_rank", "_turns").alias("_icl"))
    configs = F.array(*[F.struct(F.lit(int(sd)).alias("seed"), F.lit(int(n)).alias("n"))
                        for sd in seeds for n in ns])
    grid = test.select("*", F.inline(configs))
    out = grid.join(F.broadcast(per_cfg), ["seed", "n"])  # len(seeds) x len(ns) rows
    return out.withColumn(messages_col, concat_messages("_icl", messages_col)).drop("_icl")
