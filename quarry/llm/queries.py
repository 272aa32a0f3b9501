"""Registered queries ``opN_<name>`` of this subpackage: thin forms of the operators on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import inner_product_neighbours
from .common import n_words
from .hamming import hamming_top_k
from .langid import identify, page_evidence, train
from .licence import KEYWORD, LINE_END, RULES, SENTENCE_END, SENTENCES, scan_licences
from .lm import score_texts
from .mix import mix
from .neardup import near_duplicates
from .negatives import hard_negatives
from .pack import pack
from .shard import shard
from .tokens import token_counts
from .variants import spelling_variants
from .warc import archive


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_hamming_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest sign codes of every 100th vector, exactly."""
    return hamming_top_k(table(spark, sf_dir, "embeddings"), k=10)


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to source targets; documents labelled good weigh twice, bad ones half."""
    docs = with_mix_columns(spark, table(spark, sf_dir, "documents"), sf_dir)
    out = mix(docs.select("doc_id", "source", "__size", "__weight", "__draw"), draw=["doc_id", "__draw"])
    return out.select("doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"),
                      F.col("__target").alias("target"), F.col("__taken").alias("taken"))


def with_mix_columns(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` with ``__size`` (words), ``__weight`` (from the labels' quality) and ``__draw`` (hash of the text)."""
    labels = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("__id")).agg(F.max("quality").alias("__q"))
    weight = F.when(F.col("__q") == 1, 2.0).when(F.col("__q") == 0, 0.5).otherwise(1.0)
    out = docs.withColumn("__size", n_words(F.col("text"))).withColumn("__draw", F.xxhash64("text"))
    return out.join(labels, out["doc_id"] == labels["__id"], "left").withColumn("__weight", weight).drop("__id", "__q")


def op3_collision_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 largest inner products found for every 20th vector."""
    return inner_product_neighbours(table(spark, sf_dir, "embeddings"), k=20)


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's near-duplicate class (4-word shingles, Jaccard of 0.8 or more)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = near_duplicates(docs, shingle=4, percent=80)
    return out.select("doc_id", F.col("__n").alias("n_shingles"), F.col("__component").alias("component_id"),
                      F.col("doc_id").eqNullSafe(F.col("__component")).alias("kept"))


def op5_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known licence sentences and licences of every document."""
    out = scan_licences(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.size("__sentences").cast("long").alias("n_known_sentences"),
                      F.array_join("__sentences", ",").alias("sentence_ids"), F.array_join("__licences", ",").alias("licences"))


def language_of_documents(docs: DataFrame, model) -> DataFrame:
    """Documents declare their language in ``lang``; their ``source`` stands for the host."""
    return identify(docs, model, declared=F.col("lang"), host=F.col("source"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document and every page, from one model; ``kept`` is false where it is rejected."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs.select("lang", "text"))
    found = language_of_documents(docs.select("doc_id", "text", "lang", "source"), model)
    none = F.lit(None).cast("long")
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    evidence = page_evidence(pages)
    pages = pages.select("page_id", *[c.alias(k) for k, c in evidence.items()])
    on_web = identify(pages, model, **{k: F.col(k) for k in evidence if k != "text"})
    cols = [F.col("__language").alias("language"), F.col("__probability").alias("probability"),
            F.col("__text_language").alias("text_language"), F.col("__kept").alias("kept")]
    return found.select("doc_id", none.alias("page_id"), *cols).unionByName(on_web.select(none.alias("doc_id"), "page_id", *cols))


def op7_warc_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures of the archives written for all pages, in index order; a page's id gives its capture time."""
    out = archive(table(spark, sf_dir, "pages").select("page_id", "url", "html"),
                  captured=F.timestamp_seconds(F.lit(1_700_000_000) + F.col("page_id")))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured", "position")


def op8_backoff_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by the automaton learnt from six sevenths of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_texts(docs, held_out=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2)


def op9_lpt_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of nearly equal bytes, equal texts together."""
    out = shard(table(spark, sf_dir, "documents").select("doc_id", "text"), 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 words; byte-equal copies of a text never share one.  Near copies may, as
    the cluster is the text's hash: only exact copies are kept apart here."""
    docs = table(spark, sf_dir, "documents")
    docs = docs.select("doc_id", "source", n_words(F.col("text")).alias("__size"), F.xxhash64("text").alias("__cluster"))
    return pack(docs, capacity=2048)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with their near words' number, the commoner spelling next to them and the one its forms lead to."""
    out = spelling_variants(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("word", "form", "root", "n", "n_near", "form_n")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every 100th vector for each of its 5 positives; every 7th vector's label is shifted first."""
    vectors = table(spark, sf_dir, "embeddings")
    label = F.col("label").cast("long")
    label = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives(vectors, label=label)


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, and whether they pass 1024."""
    return token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), limit=1024)


QUERIES = {
    "op1_exact_hamming_search": op1_exact_hamming_search,
    "op2_mix_sources": op2_mix_sources,
    "op3_collision_neighbours": op3_collision_neighbours,
    "op4_minhash_near_dedup": op4_minhash_near_dedup,
    "op5_licence_scan": op5_licence_scan,
    "op6_language_id": op6_language_id,
    "op7_warc_merge": op7_warc_merge,
    "op8_backoff_scoring": op8_backoff_scoring,
    "op9_lpt_sharding": op9_lpt_sharding,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_token_counts": op13_token_counts,
}


# ----------------------------------------------------------------------------------------------
# DuckDB oracles
# ----------------------------------------------------------------------------------------------
#: brute force over sign codes written as strings of 64 signs
_HAMMING = """
WITH v AS (
  SELECT vec_id, min(embedding) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) = 64
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
  GROUP BY vec_id),
c AS (SELECT vec_id, list_transform(e, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS b FROM v),
d AS (
  SELECT q.vec_id AS query_id, r.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.b, r.b), lambda p: CASE WHEN p[1] <> p[2] THEN 1 ELSE 0 END)) AS INTEGER) AS distance
  FROM c q JOIN c r ON q.vec_id % 100 = 0 AND q.vec_id <> r.vec_id),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank FROM d)
SELECT query_id, rank, vec_id, distance FROM k WHERE rank <= 10
"""


def _licence_sql() -> str:
    values = ", ".join(f"('{s}', '{i}')" for s, i in SENTENCES.items())
    word = lambda x: f"trim(regexp_replace(lower({x}), '[^a-z0-9.]+', ' ', 'g'))"
    keyword = KEYWORD.replace("(?i)", "")
    left, found = "'|' || array_to_string(ids, '||') || '|'", "[]::VARCHAR[]"
    steps = []
    for i, (name, run) in enumerate(RULES):
        needle = "|" + "||".join(run) + "|"
        steps.append(f"r{i + 1} AS (SELECT doc_id, ids, rid, replace(l, '{needle}', '#') AS l, "
                     f"CASE WHEN contains(l, '{needle}') AND NOT list_contains(f, '{name}') THEN list_append(f, '{name}') ELSE f END AS f FROM r{i})")
    return f"""
WITH known(s, name) AS (VALUES {values}),
docs AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
cut AS (SELECT rid, string_split(regexp_replace(text, '{SENTENCE_END}', chr(1), 'g'), chr(1)) AS parts FROM docs),
sent AS (SELECT rid, unnest(parts) AS s, generate_subscripts(parts, 1) AS i FROM cut),
named AS (SELECT rid, i, sent.s, known.name FROM sent LEFT JOIN known ON {word('sent.s')} = known.s
          WHERE regexp_matches(sent.s, '{keyword}', 'i')),
line AS (SELECT rid, i, unnest(string_split_regex(s, '{LINE_END}')) AS s,
                generate_subscripts(string_split_regex(s, '{LINE_END}'), 1) AS j FROM named WHERE name IS NULL),
hit AS (SELECT rid, i, 0 AS j, name FROM named WHERE name IS NOT NULL
        UNION ALL SELECT rid, i, j, known.name FROM line JOIN known ON {word('line.s')} = known.s),
seq AS (SELECT rid, list(name ORDER BY i, j) AS ids FROM hit GROUP BY rid),
r0 AS (SELECT doc_id, rid, ids, {left} AS l, {found} AS f FROM seq JOIN docs USING (rid)),
{", ".join(steps)}
SELECT d.doc_id, CAST(coalesce(len(r.ids), 0) AS BIGINT) AS n_known_sentences,
       coalesce(array_to_string(r.ids, ','), '') AS sentence_ids, coalesce(array_to_string(r.f, ','), '') AS licences
FROM docs d LEFT JOIN r{len(RULES)} r USING (rid)
"""


_WARC_SQL = r"""
WITH p AS (SELECT page_id, url, octet_length(encode(coalesce(html, ''))) AS n, sha256(encode(coalesce(html, ''))) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d),
k AS (
  SELECT p.*, f.first,
         regexp_replace(regexp_extract(lower(url), '^[a-z]+://([^/:?#]+)', 1), '^www[0-9]*\.', '') AS host,
         regexp_extract(lower(url), '^[a-z]+://[^/?#]*([^#]*)', 1) AS rest
  FROM p LEFT JOIN f ON p.d = f.d AND p.n >= 100),
u AS (
  SELECT *, array_to_string(list_reverse(string_split(host, '.')), ',') || ')' ||
            CASE WHEN rest = '' OR rest[1] = '?' THEN '/' || rest ELSE rest END AS url_key,
         strftime(TIMESTAMP '1970-01-01 00:00:00' + to_seconds(1700000000 + page_id), '%Y-%m-%dT%H:%M:%SZ') AS captured
  FROM k)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
       CASE WHEN first IS NOT NULL AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to, url_key, captured,
       row_number() OVER (ORDER BY url_key, captured, page_id) - 1 AS position
FROM u
"""

#: crc32 byte by byte over the table of its polynomial; near words are those that share a rest with one letter deleted, verified
#: letter by letter (one letter replaced) or by being such a rest (one deleted or inserted)
_VARIANTS = r"""
WITH RECURSIVE t AS (
  SELECT list(v ORDER BY b) AS t FROM (
    SELECT b, list_reduce(range(8), lambda v, i: CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, b) AS v FROM range(256) r(b))),
run AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run
  FROM documents),
kind AS (SELECT doc_id, run, count(*) AS n FROM run GROUP BY ALL),
bytes AS (
  SELECT doc_id, run, n, list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''), lambda c: unicode(c)) AS u FROM kind),
utf8 AS (
  SELECT doc_id, run, n, flatten(list_transform(u, lambda x: CASE WHEN x < 128 THEN [x] ELSE [192 + (x >> 6), 128 + (x & 63)] END)) AS b FROM bytes),
hashed AS (
  SELECT run, n, xor(list_reduce(b, lambda v, x: xor(v >> 8, t[1 + (xor(v, CAST(x AS BIGINT)) & 255)]), 4294967295::BIGINT), 4294967295) AS h FROM utf8, t),
word AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % len(run) AS INTEGER)) || substr(run, CAST(h % len(run) AS INTEGER) + 2) ELSE run END AS word, n FROM hashed),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM word GROUP BY word HAVING len(word) >= 5 AND sum(n) >= 3),
rest AS (SELECT DISTINCT word, n, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, len(word) + 1)) AS i FROM w)),
pair AS (
  SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM rest a JOIN rest b USING (rest)
  WHERE len(list_filter(list_zip(string_split(a.word, ''), string_split(b.word, '')), lambda p: p[1] <> p[2])) = 1
  UNION SELECT a.word, a.n, w.word, w.n FROM rest a JOIN w ON a.rest = w.word
  UNION SELECT w.word, w.n, a.word, a.n FROM rest a JOIN w ON a.rest = w.word),
best AS (
  SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS r FROM pair),
form AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.near_n >= 2 * w.n THEN b.near END AS form, CASE WHEN b.near_n >= 2 * w.n THEN b.near_n END AS form_n
  FROM w LEFT JOIN best b ON w.word = b.word AND b.r = 1),
way AS (
  SELECT word, word AS at FROM form
  UNION ALL SELECT way.word, form.form FROM way JOIN form ON way.at = form.word WHERE form.form IS NOT NULL)
SELECT form.word, form.form, way.at AS root, form.n, form.n_near, form.form_n
FROM form JOIN way ON form.word = way.word JOIN form f ON f.word = way.at AND f.form IS NULL
"""

#: brute force over integer vectors
_NEGATIVES = """
WITH r AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) = 64
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.id AS anchor_id, a.label AS own, b.id, b.label, CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM r a JOIN r b ON a.id % 100 = 0 AND a.id <> b.id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE own = label
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (
  SELECT p.*, s.id AS negative_id, s.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND s.own <> s.label AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""

ORACLE_SQL: dict[str, str] = {
    "op1_exact_hamming_search": _HAMMING,
    "op5_licence_scan": _licence_sql(),
    "op7_warc_merge": _WARC_SQL,
    "op11_spelling_variants": _VARIANTS,
    "op12_hard_negatives": _NEGATIVES,
}
