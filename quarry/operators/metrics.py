"""Text-overlap metrics: exact match (A1), chrF / chrF++ (A2, A3), per-example forms (A4),
EM@k (A9) and corpus n-gram overlap (A10).

Plan shape for the n-gram metrics (chrF, BLEU) at scale: a pair's statistics are computed where its
row is (``mapInArrow`` over whole texts, numpy inside); only a few numbers per pair reach the corpus
aggregate, which is partial-aggregated map-side.  No text is shuffled.
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._check import require_columns

# --- fixed values: Python keywords (the language's reserved words), weight 1.0 in the weighted
# n-gram overlap; any other token weighs 0.2 ---
PYTHON_KEYWORDS = ["False", "None", "True", "and", "as", "assert", "async", "await", "break", "class",
                   "continue", "def", "del", "elif", "else", "except", "finally", "for", "from", "global",
                   "if", "import", "in", "is", "lambda", "nonlocal", "not", "or", "pass", "raise",
                   "return", "try", "while", "with", "yield"]
KEYWORD_WEIGHT, OTHER_WEIGHT = 1.0, 0.2


# A1 -------------------------------------------------------------------------------------------
def exact_match(df: DataFrame, prediction: str, reference: str, group_by: list[str] | None = None,
                out: str = "exact_match") -> DataFrame:
    """Mean of ``prediction == reference`` (case and whitespace sensitive; NULL counts as wrong)."""
    require_columns(df, prediction, reference, *(group_by or []))
    hit = F.when(F.col(prediction) == F.col(reference), F.lit(1.0)).otherwise(F.lit(0.0))
    return df.groupBy(*(group_by or [])).agg(F.avg(hit).alias(out))


# shared n-gram machinery ----------------------------------------------------------------------
_PUNCT = frozenset(string.punctuation)
_SLICE_CHARS = 1 << 17  # characters of pairs handled at once in a task, however large its Arrow batches


def chrf_words(text: str) -> list[str]:
    """chrF++ words: whitespace split; a token longer than one char loses a trailing ASCII
    punctuation mark into its own token, else a leading one."""
    out = []
    for w in text.split():
        if len(w) > 1 and w[-1] in _PUNCT:
            out += (w[:-1], w[-1])
        elif len(w) > 1 and w[0] in _PUNCT:
            out += (w[0], w[1:])
        else:
            out.append(w)
    return out


def _dense(units: np.ndarray) -> np.ndarray:
    return np.unique(units, return_inverse=True)[1].astype(np.int64)


def _orders(unit: np.ndarray, text: np.ndarray, max_order: int):
    """For n = 1 .. ``max_order``: the start of every n-gram that lies in one text and a number that equals another's exactly where
    both are the same n-gram of the same pair.  ``unit`` numbers units per pair, ``text`` numbers texts (two per pair)."""
    at, gram = np.arange(len(unit)), unit
    yield at, gram
    base = int(unit.max(initial=0)) + 1
    for n in range(2, max_order + 1):
        ok = at + n - 1 < len(unit)
        at, gram = at[ok], gram[ok]
        ok = text[at] == text[at + n - 1]
        at, gram = at[ok], gram[ok]
        gram = _dense(gram * base + unit[at + n - 1])  # both below 2^31
        yield at, gram


def _kind_stats(unit: np.ndarray, text: np.ndarray, pairs: int, max_order: int, weight: np.ndarray | None) -> list[np.ndarray]:
    """Per order an array (5, pairs): h, r, m and the unweighted hu, ru.  ``weight`` weighs unigrams."""
    out = []
    for n, (at, gram) in enumerate(_orders(unit, text, max_order), 1):
        kinds = int(gram.max(initial=-1)) + 1
        hyp = text[at] % 2 == 0
        pair = np.zeros(kinds, np.int64)
        pair[gram] = text[at] // 2
        h, r = (np.bincount(gram[x], minlength=kinds) for x in (hyp, ~hyp))
        w = np.ones(kinds)
        if n == 1 and weight is not None:
            w[gram] = weight[at]
        out.append(np.stack([np.bincount(pair, weights=c, minlength=pairs) for c in (h * w, r * w, np.minimum(h, r) * w, h, r)]).astype(np.float64))
    return out


def _unit_arrays(texts: list, kind: str) -> tuple[np.ndarray, np.ndarray, list | None]:
    """Units of all texts numbered per pair, the text of each, and the words themselves."""
    if kind == "c":
        solid = ["".join(t.split()) for t in texts]
        code = "".join(solid).encode("utf-32-le", "surrogatepass")
        cp = np.frombuffer(code, np.uint32).astype(np.int64) if code else np.zeros(0, np.int64)
        text = np.repeat(np.arange(len(texts)), [len(t) for t in solid])
        return _dense((text // 2 << 21) + cp), text, None
    words = [chrf_words(t) if kind == "chrf" else t.split() for t in texts]
    flat = [w for ws in words for w in ws]
    numbers: dict = {}
    word = np.array([numbers.setdefault(w, len(numbers)) for w in flat], np.int64)
    text = np.repeat(np.arange(len(texts)), [len(ws) for ws in words])
    return _dense((text // 2) * (len(numbers) + 1) + word), text, flat


def _pair_stats(keys: list[str], char_order: int, word_order: int, words: str, weights: dict | None, h_needs_ref: bool):
    def slices(b):
        # lengths are counted in Arrow: only a slice's texts become Python's
        h, r = (pc.fill_null(pc.utf8_length(b.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("_h", "_r"))
        size = np.cumsum(h + r)
        i = 0
        while i < b.num_rows:
            j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + _SLICE_CHARS, "right")))
            yield b.slice(i, j - i)
            i = j

    def run(batches):
        for whole in batches:
            for b in slices(whole):
                n = b.num_rows
                texts = [t or "" for pair in zip(b.column("_h").to_pylist(), b.column("_r").to_pylist()) for t in pair]
                for kind, order, how in (("c", char_order, "c"), ("w", word_order, words)):
                    if not order:
                        continue
                    unit, text, flat = _unit_arrays(texts, how)
                    weight = None if weights is None or kind == "c" else np.array([weights.get(w, OTHER_WEIGHT) for w in flat])
                    for o, stats in enumerate(_kind_stats(unit, text, n, order, weight), 1):
                        if h_needs_ref:
                            stats[0] = np.where(stats[1] > 0, stats[0], 0.0)
                        yield pa.RecordBatch.from_arrays(
                            [*[b.column(f"_k{i}") for i in range(len(keys))], pa.array([kind] * n, pa.string()),
                             pa.array(np.full(n, o, np.int32)), *[pa.array(x) for x in stats]],
                            names=[*keys, "kind", "n", "h", "r", "m", "hu", "ru"])
    return run


def ngram_match_stats(df: DataFrame, keys: list[str], hypothesis: str, reference: str,
                      char_order: int = 6, word_order: int = 0, words: str = "chrf",
                      weights: dict[str, float] | None = None, h_needs_ref: bool = False) -> DataFrame:
    """Per row and (kind, order): hypothesis count ``h``, reference count ``r`` and clipped matches
    ``m = sum_g min(h_g, r_g)`` (plus unweighted ``hu``/``ru``).  With ``h_needs_ref`` an order
    whose reference has no n-gram contributes no hypothesis count (chrF's rule, per pair).

    A pair's statistics depend on its own row only, so nothing is shuffled: Arrow batches are turned into arrays of
    units (code points without whitespace, or words), n-grams are numbered order by order (an n-gram is its
    first n-1 units' number and its last unit, so numbers are exact), and counts come from sorted numbers.  Rows hold a few numbers
    per order afterwards and are summed map-side.  ``weights`` (word -> weight, others ``OTHER_WEIGHT``) weigh word
    unigrams; ``words`` is "chrf" or "plain" (whitespace split).
    """
    require_columns(df, hypothesis, reference, *keys)
    rows = df.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(hypothesis).alias("_h"), F.col(reference).alias("_r"))
    numbers = [T.StructField(c, T.DoubleType()) for c in ("h", "r", "m", "hu", "ru")]
    schema = T.StructType([*[T.StructField(k, f.dataType) for k, f in zip(keys, rows.schema.fields)],
                           T.StructField("kind", T.StringType()), T.StructField("n", T.IntegerType()), *numbers])
    return rows.mapInArrow(_pair_stats(keys, char_order, word_order, words, weights, h_needs_ref), schema)


# A2 / A3 / A4 ---------------------------------------------------------------------------------
def _fscore(stats: DataFrame, group_by: list[str], beta: float, out: str) -> DataFrame:
    ok = (F.col("h") > 0) & (F.col("r") > 0)
    b2 = beta * beta
    p = F.avg(F.when(ok, F.col("m") / F.col("h")))
    r = F.avg(F.when(ok, F.col("m") / F.col("r")))
    agg = stats.groupBy(*group_by).agg(p.alias("_p"), r.alias("_r"))
    score = F.when(F.coalesce(F.col("_p") + F.col("_r"), F.lit(0.0)) > 0,
                   100.0 * (1 + b2) * F.col("_p") * F.col("_r") / (b2 * F.col("_p") + F.col("_r"))) \
        .otherwise(F.lit(0.0))
    return agg.select(*group_by, score.alias(out))


def _chrf_stats(df, keys, prediction, reference, char_order, word_order):
    return ngram_match_stats(df, keys, prediction, reference, char_order, word_order, h_needs_ref=True)


def chrf(df: DataFrame, prediction: str, reference: str, example_id: str = "example_id",
         group_by: list[str] | None = None, char_order: int = 6, word_order: int = 0,
         beta: float = 2.0, out: str = "chrf") -> DataFrame:
    """Corpus chrF (word_order=0) or chrF++ (word_order=2): statistics summed over the corpus
    (per ``group_by``) before precision/recall are averaged over the orders."""
    group_by = list(group_by or [])
    stats = _chrf_stats(df, group_by, prediction, reference, char_order, word_order)
    corpus = stats.groupBy(*group_by, "kind", "n").agg(F.sum("h").alias("h"), F.sum("r").alias("r"),
                                                        F.sum("m").alias("m"))
    return _fscore(corpus, group_by, beta, out)


def chrf_family(df: DataFrame, prediction: str, reference: str, example_id: str = "example_id",
                group_by: list[str] | None = None, beta: float = 2.0, also: dict | None = None) -> DataFrame:
    """chrF and chrF++ from ONE n-gram pass: chrF++'s statistics contain chrF's (the character
    orders), so both scores come out of the same corpus table in one aggregate.  ``also`` maps further
    columns to aggregate functions over the examples, computed in the same pass."""
    group_by = list(group_by or [])
    keys = [*group_by, *(also or {})]
    stats = _chrf_stats(df, keys, prediction, reference, 6, 2)
    once = (F.col("kind") == "c") & (F.col("n") == 1)  # one row of each example
    more = [f(F.when(once, F.col(c))).alias(f"_{c}") for c, f in (also or {}).items()]
    corpus = stats.groupBy(*group_by, "kind", "n").agg(F.sum("h").alias("h"), F.sum("r").alias("r"),
                                                        F.sum("m").alias("m"), *more)
    ok = (F.col("h") > 0) & (F.col("r") > 0)
    chars = F.col("kind") == "c"
    agg = corpus.groupBy(*group_by).agg(
        F.avg(F.when(ok & chars, F.col("m") / F.col("h"))).alias("_pc"),
        F.avg(F.when(ok & chars, F.col("m") / F.col("r"))).alias("_rc"),
        F.avg(F.when(ok, F.col("m") / F.col("h"))).alias("_pa"),
        F.avg(F.when(ok, F.col("m") / F.col("r"))).alias("_ra"),
        *[F.max(f"_{c}").alias(c) for c in (also or {})])
    b2 = beta * beta

    def score(p, r):
        return F.when(F.coalesce(F.col(p) + F.col(r), F.lit(0.0)) > 0,
                      100.0 * (1 + b2) * F.col(p) * F.col(r) / (b2 * F.col(p) + F.col(r))).otherwise(F.lit(0.0))

    return agg.select(*group_by, *(also or {}), score("_pc", "_rc").alias("chrf"), score("_pa", "_ra").alias("chrf_pp"))


def chrf_per_example(df: DataFrame, prediction: str, reference: str, example_id: str = "example_id",
                     char_order: int = 6, word_order: int = 0, beta: float = 2.0,
                     out: str = "chrf") -> DataFrame:
    """Sentence-level chrF for every example (examples without any n-gram score 0)."""
    stats = _chrf_stats(df, [example_id], prediction, reference, char_order, word_order)
    per_key = stats.groupBy(example_id, "kind", "n").agg(*[F.sum(c).alias(c) for c in ("h", "r", "m")])
    return _fscore(per_key, [example_id], beta, out)


# A10 ------------------------------------------------------------------------------------------
def ngram_overlap(df: DataFrame, prediction: str, reference: str, example_id: str = "example_id",
                  group_by: list[str] | None = None, max_order: int = 4,
                  keyword_weights: dict[str, float] | None = None, out: str = "bleu") -> DataFrame:
    """Corpus BLEU over whitespace tokens: clipped n-gram precisions (orders 1..max_order) summed
    over the corpus, geometric mean, brevity penalty ``exp(1 - ref_len / hyp_len)`` when the
    hypotheses are shorter; 0 when any order has no match.

    With ``keyword_weights`` (token -> weight, others ``OTHER_WEIGHT``) unigram counts and matches
    are weighted — the keyword-weighted overlap.  This is n-gram overlap only; it is not CodeBLEU.
    """
    group_by = list(group_by or [])
    stats = ngram_match_stats(df, group_by, prediction, reference, char_order=0, word_order=max_order,
                              words="plain", weights=keyword_weights)
    orders = range(1, max_order + 1)
    corpus = stats.groupBy(*group_by).agg(
        *[F.sum(F.when(F.col("n") == n, F.col("m"))).alias(f"m{n}") for n in orders],
        *[F.sum(F.when(F.col("n") == n, F.col("h"))).alias(f"h{n}") for n in orders],
        F.sum(F.when(F.col("n") == 1, F.col("hu"))).alias("hyp_len"),
        F.sum(F.when(F.col("n") == 1, F.col("ru"))).alias("ref_len"))
    logp = sum(F.log(F.col(f"m{n}") / F.col(f"h{n}")) for n in orders) / max_order
    any_zero = F.lit(False)
    for n in orders:
        any_zero = any_zero | (F.coalesce(F.col(f"m{n}"), F.lit(0.0)) <= 0)
    bp = F.when(F.col("hyp_len") >= F.col("ref_len"), F.lit(1.0)) \
        .otherwise(F.exp(1 - F.col("ref_len") / F.col("hyp_len")))
    score = F.when(any_zero | (F.coalesce(F.col("hyp_len"), F.lit(0)) == 0), F.lit(0.0)).otherwise(bp * F.exp(logp))
    return corpus.select(*group_by, score.alias(out))


def keyword_weighted_overlap(df: DataFrame, prediction: str, reference: str, **kw) -> DataFrame:
    weights = {k: KEYWORD_WEIGHT for k in PYTHON_KEYWORDS}
    kw.setdefault("out", "weighted_bleu")
    return ngram_overlap(df, prediction, reference, keyword_weights=weights, **kw)


# A9 -------------------------------------------------------------------------------------------
def em_at_k(df: DataFrame, ks=(1, 5, 10), example_id: str = "example_id", rank: str = "rank",
            candidate: str = "candidate", reference: str = "reference") -> DataFrame:
    """Fraction of examples where a candidate ranked ``<= k`` equals the reference, per k.

    Two partial-aggregated group-bys (per example, then global): hot examples are pre-aggregated
    map-side and never gathered into one task.
    """
    require_columns(df, example_id, rank, candidate, reference)
    eq = F.col(candidate) == F.col(reference)
    per_ex = df.groupBy(example_id).agg(
        *[F.max(F.when((F.col(rank) <= k) & eq, F.lit(1.0)).otherwise(F.lit(0.0))).alias(f"em_at_{k}")
          for k in ks])
    return per_ex.agg(*[F.avg(f"em_at_{k}").alias(f"em_at_{k}") for k in ks])
