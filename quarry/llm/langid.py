"""Language identification by Bayesian evidence fusion.

Text likelihoods come from hashed byte trigrams (multinomial, smoothed), fitted on a bounded sample of each label's texts.  They
are fused with three other pieces of evidence, each a smoothed table computed by grouped aggregation over all rows:
the language declared in the markup, the address suffix, and the host's prior, which is smoothed towards its domain's
and that towards the whole collection's.  One pass over the texts, no shuffle of texts; the tables are joined.

A text for which evenly spread trigrams are clearly likelier than every language is rejected, as is one without any letter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bucket, materialise, named, row_chunks, string_buffers

#: the model is fitted on about this many different texts of each label at most (chosen by hash), whatever the table's size
TRAIN_ROWS = 5_000
#: which labels are languages is counted over the whole table
MIN_LABELLED = 4
BITS = 14
#: a text's evidence counts for at most this many independent trigrams
EFFECTIVE = 60.0
#: how much likelier (in nats) evenly spread trigrams must be than every language for a text to be rejected: a few rare trigrams
#: of a short text are not enough
REJECT = 20.0
#: strength (in rows) of the smoothing of host towards domain, domain towards all, and of the evidence tables
STRENGTH = 10.0

_CLASS = np.full(256, 32, np.uint8)
_CLASS[97:123] = np.arange(97, 123)
_CLASS[65:91] = np.arange(97, 123)
_CLASS[128:] = np.arange(128, 256)


def trigrams(col: pa.Array):
    """For ranges of rows: first row, one past the last, and row and hashed trigram of every position, three blanks left out.
    Texts of less than three bytes get a blank before and after them, so any text with a letter has a trigram."""
    offsets, data = string_buffers(col)
    for i, j in row_chunks(offsets):
        o = offsets[i:j + 1] - offsets[i]
        b = _CLASS[data[offsets[i]:offsets[j]]].astype(np.uint32)
        short = np.diff(o) < 3
        if short.any():
            shift = np.r_[0, np.cumsum(2 * short)]
            padded = np.full(len(b) + shift[-1], 32, np.uint32)
            padded[np.arange(len(b)) + np.repeat(shift[:-1] + short, np.diff(o))] = b
            o, b = o + shift, padded
        if len(b) < 3:
            yield i, j, np.zeros(0, np.int64), np.zeros(0, np.int64)
            continue
        code = b[:-2] * np.uint32(65536) + b[1:-1] * np.uint32(256) + b[2:]
        ok = code != 0x202020
        for cut in (1, 2):  # not across the end of a text
            last = o - cut
            ok[last[(last >= 0) & (last < len(ok))]] = False
        at = np.flatnonzero(ok)
        code = (code[at] * np.uint32(2654435761)) >> np.uint32(32 - BITS)
        yield i, j, np.searchsorted(o, at, "right") - 1, code.astype(np.int64)


class Model:
    """``languages`` and their log probabilities per trigram (one row per trigram bucket)."""

    def __init__(self, languages: list[str], prior: list[float], table: np.ndarray):
        self.languages, self.prior, self.table = languages, prior, table

    def likelihoods(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Sum of log probabilities per row and language, and the number of trigrams."""
        total, n = np.zeros((len(col), len(self.languages))), np.zeros(len(col), np.int64)
        for i, j, row, code in trigrams(col):
            n[i:j] = np.bincount(row, minlength=j - i)
            for x in range(len(self.languages)):
                total[i:j, x] = np.bincount(row, weights=self.table[x, code], minlength=j - i)
        return total, n


def _count(batches):
    for b in batches:
        label = np.array(["" if x is None else x for x in b.column("label").to_pylist()], object)
        for x in set(label.tolist()):
            counts = np.zeros(1 << BITS, np.int64)
            for _, _, _, code in trigrams(b.column("text").filter(pa.array(label == x))):
                counts += np.bincount(code, minlength=1 << BITS)
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(at), pa.string()), pa.array(at), pa.array(counts[at])],
                                             names=["label", "gram", "n"])


def train(labelled: DataFrame, *, label: str = "lang", text: str = "text", rows: int = TRAIN_ROWS, least: int = MIN_LABELLED) -> Model:
    """Fits on about ``rows`` different texts of every label at most; labels with fewer than ``least`` in the whole table, whatever its
    size, are not languages.  Without any, the model knows no language and rejects every text."""
    some = labelled.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.lower(label).alias("label"), F.col(text).alias("text"))
    # copies of a text count once, so that a text with very many copies makes no language and cannot fill a sample
    sizes = some.select("label", F.xxhash64("text").alias("h")).distinct().groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    sizes = materialise(sizes, "labels")
    sizes = sizes.where(F.col("n") >= least).select("label", "n")
    size = {r["label"]: r["n"] for r in sizes.collect()}  # one row per language, as the model has
    share = F.lit(float(rows)) / F.col("n")
    some = some.join(F.broadcast(sizes), "label").where(bucket(1 << 30, F.lit(6), "text") < share * F.lit(1 << 30))
    some = some.groupBy("label", F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"))
    some = materialise(some, "labelled", "zstd")
    names = sorted(size)
    grams = some.mapInArrow(_count, "label string, gram long, n long") \
        .groupBy("label", "gram").agg(F.sum("n").alias("n")).toPandas()  # at most languages x 2^BITS rows
    table = np.full((len(names), 1 << BITS), 0.5)
    for x, name in enumerate(names):
        g = grams[grams["label"] == name]
        table[x, g["gram"].to_numpy(np.int64)] += g["n"].to_numpy(np.float64)
    table = np.log(table / table.sum(axis=1, keepdims=True)) if names else table
    total = sum(size.values())
    return Model(names, [size[x] / total for x in names], table)


def _likelihood(model: Model, text: str):
    def run(batches):
        for b in batches:
            total, n = model.likelihoods(b.column(text))
            total *= np.minimum(1.0, EFFECTIVE / np.maximum(n, 1))[:, None]
            even = -BITS * np.log(2) * np.minimum(n, EFFECTIVE)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(list(total), pa.list_(pa.float64())), pa.array(even), pa.array(n)],
                names=[*b.schema.names, "__ll", "__even", "__grams"])
    return run


def _softmax(log: Column) -> Column:
    top = F.array_max(log)
    e = F.transform(log, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / total)


def _sums(k: int) -> Column:
    return F.array(*[F.sum(F.col("__soft")[i]) for i in range(k)])


def _smoothed(n: Column, towards: Column) -> Column:
    """(counts + STRENGTH * distribution), normalised."""
    total = F.aggregate(n, F.lit(0.0), lambda a, x: a + x)
    return F.zip_with(n, towards, lambda x, p: (x + STRENGTH * p) / (total + STRENGTH))


def identify(docs: DataFrame, model: Model, *, text: str = "text", declared: Column | None = None, suffix: Column | None = None,
             host: Column | None = None, domain: Column | None = None) -> DataFrame:
    """All columns of ``docs`` and ``__language`` (NULL: rejected), ``__probability`` (of the language), ``__text_language``
    (by the text alone) and ``__kept``.

    ``declared``, ``suffix``, ``host`` and ``domain`` are string expressions over ``docs``; NULL or absent ones are no evidence.
    A NULL, empty or letterless text is rejected, whatever its other evidence.  Texts are read whole, whatever their
    length.  Ties go to the language that sorts first.  Repeated rows are rows like any others.  An empty table gives an
    empty result; a model without languages rejects every row.  Further columns pass through, whatever their names.
    """
    k = len(model.languages)
    none = F.lit(None).cast("string")
    cols = docs.columns
    plain = [f"c{i}" for i in range(len(cols))]
    own = [F.col(p).alias(c) for p, c in zip(plain, cols)]
    evidence = (("__declared", declared), ("__suffix", suffix), ("__host", host), ("__domain", domain))
    base = docs.select(*[x.alias(p) for x, p in zip(named(cols), plain)], *[(F.lower(c) if c is not None else none).alias(x) for x, c in evidence])
    base = base.withColumn("__domain", F.coalesce("__domain", "__host"))
    fields = [T.StructField("__ll", T.ArrayType(T.DoubleType())), T.StructField("__even", T.DoubleType()), T.StructField("__grams", T.LongType())]
    base = materialise(base.mapInArrow(_likelihood(model, plain[cols.index(text)]), T.StructType(base.schema.fields + fields)), "likelihoods", "zstd")
    if not k:
        return base.select(*own, none.alias("__language"), F.lit(None).cast("double").alias("__probability"),
                           none.alias("__text_language"), F.lit(False).alias("__kept"))
    names = F.array(*[F.lit(x) for x in model.languages])
    prior = F.array(*[F.lit(x) for x in model.prior])
    log = lambda a: F.transform(a, lambda x: F.log(x))
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    seen = base.select("__declared", "__suffix", "__host", "__domain", _softmax(add(F.col("__ll"), log(prior))).alias("__soft")) \
        .where("__grams > 0")
    total = seen.agg(_sums(k).alias("n")).first()["n"]
    whole = F.array(*[F.lit(((x or 0.0) + STRENGTH * p)) for x, p in zip(total, model.prior)])
    mass = F.aggregate(whole, F.lit(0.0), lambda a, x: a + x)
    everywhere = F.transform(whole, lambda x: x / mass)
    # P(value | language) up to a factor that all languages share: P(language | value) / P(language)
    out = base
    score = add(F.col("__ll"), log(everywhere))
    for name in ("__declared", "__suffix"):
        t = seen.where(F.col(name).isNotNull()).groupBy(name).agg(_sums(k).alias("n")).select(
            F.col(name).alias("__v"), F.zip_with(_smoothed(F.col("n"), everywhere), everywhere, lambda a, b: F.log(a / b)).alias(name + "_e"))
        t = materialise(t, "evidence")
        out = out.join(t, out[name] == t["__v"], "left").drop("__v")
        score = F.when(F.col(name + "_e").isNotNull(), add(score, F.col(name + "_e"))).otherwise(score)
    hosts = seen.where(F.col("__host").isNotNull()).groupBy("__host", "__domain").agg(_sums(k).alias("n"))
    hosts = materialise(hosts, "hosts")
    domains = hosts.groupBy("__domain").agg(F.array(*[F.sum(F.col("n")[i]) for i in range(k)]).alias("m")).select(
        F.col("__domain").alias("__d"), _smoothed(F.col("m"), everywhere).alias("q"))
    t = hosts.join(domains, hosts["__domain"] == domains["__d"]).select(
        F.col("__host").alias("__v"), F.col("__domain").alias("__d"),
        F.zip_with(_smoothed(F.col("n"), F.col("q")), everywhere, lambda a, b: F.log(a / b)).alias("__host_e"))
    t = materialise(t, "host-priors")
    out = out.join(t, (out["__host"] == t["__v"]) & (out["__domain"] == t["__d"]), "left").drop("__v", "__d")
    score = F.when(F.col("__host_e").isNotNull(), add(score, F.col("__host_e"))).otherwise(score)
    out = out.withColumn("__score", score).withColumn("__best", F.array_max("__score"))
    best = F.array_position("__score", F.col("__best")).cast("int")
    by_text = F.array_position("__ll", F.array_max("__ll")).cast("int")
    kept = (F.col("__grams") > 0) & (F.array_max("__ll") + REJECT > F.col("__even"))
    return out.select(*own, F.when(kept, F.element_at(names, best)).alias("__language"),
                      F.when(kept, F.array_max(_softmax(F.col("__score")))).alias("__probability"),
                      F.when(F.col("__grams") > 0, F.element_at(names, by_text)).alias("__text_language"), kept.alias("__kept"))


def page_evidence(pages: DataFrame, *, html: str = "html", url: str = "url") -> dict[str, Column]:
    """Evidence of web pages: visible text, ``lang`` of the html element (main part), last label of the host, host
    and its last two labels.  An address that cannot be parsed gives no evidence."""
    body = F.regexp_replace(F.coalesce(F.col(html), F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    lang = F.regexp_extract(F.coalesce(F.col(html), F.lit("")), r"(?i)<html[^>]*?\slang\s*=\s*[\"']?([a-z]{2,3})", 1)
    host = F.try_parse_url(F.col(url), F.lit("HOST"))
    labels = F.split(host, r"\.")
    return {"text": body, "declared": F.when(lang != "", lang), "host": host, "suffix": F.try_element_at(labels, F.lit(-1)),
            "domain": F.concat_ws(".", F.slice(labels, F.greatest(F.lit(1), F.size(labels) - 1), F.lit(2)))}
