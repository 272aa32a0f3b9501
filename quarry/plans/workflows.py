"""End-to-end workflows composed from the operators.

* ``prepare_dataset`` — E1: corpus rows -> chat messages per split, validation carved from train.
* ``build_prompts`` — E2 prompt side: one strategy enum (none / icl / rag), K9.
* ``evaluate_responses`` — E2 scoring: clean, align by id, EM + chrF + chrF++ as a tall table.
* ``apps_report`` — E3: outcome table -> difficulty -> accuracy and pass@k in one pass each.

Each returns a DataFrame; ``build_prompts("rag")`` runs the retrieval when it is called (its top-k is checkpointed and
counted), the others run nothing before their result is used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import APPS_SLICES, INSTRUCTION_PREFIX, VALIDATION_SIZE
from ..functions.text import fence_cut, render_cut, stop_truncate
from ..operators import align as AL
from ..operators import fewshot as FS
from ..operators import hooks as HK
from ..operators import metrics as M
from ..operators import outcomes as OC
from ..operators import prompt as PR
from ..operators import retrieve as RT
from ..operators import sample as SA
from ..operators._check import require_columns
from ..sources import files as IO


# E1 -------------------------------------------------------------------------------------------
def prepare_dataset(df: DataFrame, corpus: str, id_col: str, split_col: str = "split",
                    validation_size: int | None = None, seed: int = 42) -> DataFrame:
    """Corpus rows (with a ``split`` column) -> rows with ``messages``.

    magicoder / magicoder_oss: plain two-turn messages; train -> train + validation.
    conala: templated, test answers blinded.  mbpp: tests appended to the prompt, templated,
    test blinded.  apps: I/O-mode prompt, first solution, templated, test blinded; train -> train +
    validation.  ``validation_size`` defaults to the corpus' fixed size (none for conala/mbpp).
    """
    needs = {"magicoder": ("instruction", "response"), "magicoder_oss": ("problem", "solution"),
             "conala": ("nl", "cmd"), "mbpp": ("text", "test_list", "code"),
             "apps": ("question", "starter_code", "input_output", "solutions")}
    if corpus not in needs:
        raise ValueError(f"unknown corpus {corpus!r}; known: {sorted(needs)}")
    require_columns(df, id_col, split_col, *needs[corpus])
    n_val = VALIDATION_SIZE.get(corpus) if validation_size is None else validation_size
    if n_val:
        is_train = F.col(split_col).eqNullSafe(F.lit("train"))
        train, rest = df.where(is_train), df.where(~is_train)  # NULL splits stay in ``rest``
        df = SA.carve(train, id_col, n_val, seed=seed, chosen="validation", rest="train",
                      split_col=split_col).unionByName(rest)
    if corpus in ("magicoder", "magicoder_oss"):
        norm = PR.normalize_corpus(df, corpus, keep=(id_col, split_col))
        return PR.plain_messages(norm, "instruction", "reference")
    if corpus == "conala":
        answer = F.when(F.col(split_col) == "test", F.lit(None).cast("string")).otherwise(F.col("cmd"))
        return df.withColumn("messages", PR.templated_turns(F.col("nl"), answer, INSTRUCTION_PREFIX["conala"]))
    if corpus == "mbpp":
        answer = F.when(F.col(split_col) == "test", F.lit(None).cast("string")).otherwise(F.col("code"))
        prompt = PR.prompt_with_tests("text", "test_list")
        return df.withColumn("messages", PR.templated_turns(prompt, answer, INSTRUCTION_PREFIX["mbpp"]))
    if corpus == "apps":
        return PR.apps_messages(df, split_col=split_col)
    raise ValueError(f"unknown corpus {corpus!r}")


def prepare_joint(corpora: dict[str, DataFrame], id_col: str, split_col: str = "split",
                  validation_size: int | None = None, seed: int = 42) -> DataFrame:
    """The joint training set of several corpora: ``(id, dataset, split, messages)``, each prepared by its own rules, then
    validation rows carved once from all train rows.  Ids must be unique over the corpora."""
    parts = [prepare_dataset(df, name, id_col, split_col, validation_size=0, seed=seed).select(
        id_col, F.lit(name).alias("dataset"), split_col, "messages") for name, df in corpora.items()]
    out = PR.union_corpora(parts)
    if not validation_size:
        return out
    is_train = F.col(split_col).eqNullSafe(F.lit("train"))
    carved = SA.carve(out.where(is_train), id_col, validation_size, seed=seed, split_col=split_col)
    return carved.unionByName(out.where(~is_train))


# Prompts ----------------------------------------------------------------------------------
STRATEGIES = ("none", "icl", "rag")


def build_prompts(test: DataFrame, strategy: str, *, train: DataFrame | None = None, id_col: str = "example_id",
                  instruction: str = "instruction", reference: str = "reference", dataset: str = "conala",
                  n: int = 3, seed: int = 42, queries: DataFrame | None = None, kb: DataFrame | None = None,
                  payload: DataFrame | None = None, n_retrieve: int = 1, n_final: int = 1,
                  rerank_token_dim: int | None = None) -> DataFrame:
    """Messages per test row under exactly one strategy (K9).

    icl: ``n`` exemplars from ``train`` drawn with ``seed`` (T7).  rag: ``queries``
    (query_id = ``id_col``, embedding) against ``kb``; optional MaxSim rerank; ``payload`` gives
    (doc_id, page_content, code) (T6).  For apps, pass ``reference`` as the first-solution column.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}")
    require_columns(test, id_col, "messages")
    if strategy == "none":
        return test
    if strategy == "icl":
        if train is None:
            raise ValueError("icl needs the train split")
        return FS.icl_prompt(test, train, n, seed, id_col, instruction, reference, dataset)
    if queries is None or kb is None or payload is None:
        raise ValueError("rag needs queries, kb and payload")
    cand = RT.knn_topk(queries, kb, n_retrieve)
    if rerank_token_dim:
        chosen = RT.rerank(cand, queries, kb, n_final, rerank_token_dim)
        rank_col = "final_rank"
    else:
        chosen = cand.where(F.col("rank") <= n_final)
        rank_col = "rank"
    qm = test.withColumnRenamed(id_col, "query_id")
    out = RT.rag_messages(qm, chosen, payload, rank_col, dataset, retrieved_rows=cand.count())
    return out.withColumnRenamed("query_id", id_col)


def api_messages(messages) -> F.Column:
    """The message form sent to hosted models — a final turn holding only the placeholder
    answer is dropped (the rendered form is cut at the placeholder instead, T1)."""
    from ..functions.fixed import PLACEHOLDER, PYTHON_FENCE_OPEN
    m = F.col(messages) if isinstance(messages, str) else messages
    last = F.element_at(m, -1)
    placeholder_turn = F.lit(f"{PYTHON_FENCE_OPEN}{PLACEHOLDER}\n```")
    return F.when((F.size(m) > 0) & (last["content"] == placeholder_turn),
                  F.slice(m, F.lit(1), F.size(m) - 1)).otherwise(m)


# Scoring ----------------------------------------------------------------------------------
def clean_responses(responses: DataFrame, raw: str = "raw", api_model: str | None = None,
                    stops: list[str] | None = None, out: str = "response") -> DataFrame:
    """T3 then T2: stop strings first (if given), then the fence cut — API outputs stay raw."""
    r = F.col(raw)
    if stops:
        r = stop_truncate(r, stops)
    cleaned = fence_cut(r)
    if api_model:
        cleaned = F.when(F.col(api_model), F.col(raw)).otherwise(cleaned)
    return responses.withColumn(out, cleaned)


def evaluate_responses(responses: DataFrame, references: DataFrame, group_by: list[str] | None = None,
                       key: str = "example_id", response: str = "response", reference: str = "reference",
                       on_missing: str = "wrong") -> DataFrame:
    """(group..., metric, value): n_examples, exact_match, chrf, chrf_pp from keyed responses.

    A missing response (``on_missing='wrong'``) scores as an empty hypothesis.  EM, counts, chrF and chrF++
    come from one pass over the aligned rows (``chrf_family``) and one aggregate.
    """
    keys = list(group_by or [])
    generation = [c for c in ("gen_id",) if c in responses.columns]
    a = AL.align(references.select(key, reference, *keys), responses.select(key, *generation, response), key, on_missing,
                 unique_responses=True)
    if not keys:
        a = a.withColumn("_all", F.lit(1))
        keys = ["_all"]
    # an example counts once, whatever its number of generations; scores are means over (example, generation)
    a = a.withColumn("exact_match", F.when(F.col(response) == F.col(reference), F.lit(1.0)).otherwise(F.lit(0.0)))
    a = a.withColumn(response, F.coalesce(F.col(response), F.lit("")))
    also = {"exact_match": F.avg, key: F.countDistinct if generation else F.count}
    wide = M.chrf_family(a, response, reference, key, group_by=keys, also=also)
    wide = wide.withColumn("n_examples", F.col(key).cast("double"))
    tall = wide.unpivot(keys, ["n_examples", "exact_match", "chrf", "chrf_pp"], "metric", "value")
    return tall.drop("_all") if keys == ["_all"] else tall


def write_run_record(scores: DataFrame, telemetry: DataFrame, path: str, address: dict, group_by: list[str],
                     own_address: list[str] | None = None) -> None:
    """The record of a run: its scores per group and its memory and time (``run_summary``), as tall rows
    ``(group..., metric, value, unit)`` under the run's address.

    ``address`` holds what all runs share.  ``own_address`` names columns of ``telemetry`` that tell its runs apart; each run then
    gets a record of its own.  ``scores`` may have these columns, too; scores without them hold for every run.
    """
    own = list(own_address or [])
    use = IO.to_tall(telemetry.select(*own, F.col("peak_mb").alias("peak_memory"), F.col("elapsed_s").alias("elapsed")), own, ["peak_memory", "elapsed"])
    use = use.withColumn("unit", F.when(F.col("metric") == "elapsed", "s").otherwise("MB"))
    if own and not set(own) <= set(scores.columns):  # a handful of scores, given to every run
        listed = scores.agg(F.collect_list(F.struct(*scores.columns))).scalar()
        scores = telemetry.select(*own, F.inline(listed))
    tall = scores.withColumn("unit", F.lit(None).cast("string")).unionByName(
        use.select(*own, *[F.lit(None).cast(scores.schema[g].dataType).alias(g) for g in group_by], "metric", "value", "unit"))
    kinds = {"temperature": "double", "n": "int", "seed": "int"}
    IO.write_run_outputs(tall.select(*[F.lit(v).cast(kinds.get(k, "string")).alias(k) for k, v in address.items()], "*"), path)


def icl_grid_scores(test: DataFrame, train: DataFrame, ns: list[int], seeds: list[int], model, id_col: str, instruction: str,
                    reference: str, prefix: str, stops: list[str] | None = None) -> DataFrame:
    """E2 over the few-shot grid: ``(seed, n, metric, value)`` of the model's cleaned answers to every test prompt of every
    configuration, prompted and scored in one job."""
    grid = FS.icl_grid(test, train, ns, seeds, id_col, instruction, reference, prefix)
    key = F.concat_ws(":", "seed", "n", F.col(id_col).cast("string"))
    grid = grid.select(key.alias("_run_row"), F.col("seed").alias("_seed"), F.col("n").alias("_shots"), F.col(reference).alias("reference"), render_cut("messages").alias("prompt"))
    answers = HK.generate_with(grid.select("_run_row", "prompt"), model).select("_run_row", F.col("response").alias("raw"))
    refs = grid.select("_run_row", "_seed", "_shots", "reference")
    scores = evaluate_responses(clean_responses(answers, stops=stops), refs, ["_seed", "_shots"], key="_run_row")
    return scores.withColumnsRenamed({"_seed": "seed", "_shots": "n"})


# E3 -------------------------------------------------------------------------------------------
def apps_report(outcomes: DataFrame, slices=APPS_SLICES, ks=(1, 10, 100), position: str = "problem_id"):
    """Difficulty from fixed position slices (J6/L5); returns (accuracy table, pass@k table) over all generations.
    Problems outside every slice are reported as ``outside``."""
    label = F.coalesce(OC.range_label(position, slices), F.lit("outside"))
    labelled = outcomes.withColumn("difficulty", label)
    return OC.accuracy(labelled, ["difficulty"]), OC.pass_at_k(labelled, ks=ks, group_by=["difficulty"])


def position_slice(df: DataFrame, lo: int, hi: int, position: str = "example_id") -> DataFrame:
    """Rows at positions ``[lo, hi)`` — a range predicate, pushed to the scan."""
    return df.where((F.col(position) >= lo) & (F.col(position) < hi))
