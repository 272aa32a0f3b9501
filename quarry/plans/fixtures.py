"""Derived views over the driver tables (FIXTURES.md section 3), in Spark and in DuckDB SQL.

Each Spark builder reads the parquet tables under ``sf_dir`` lazily (column pruning and filter
pushdown reach the scan); the DuckDB text is the oracle's CTE with the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(example_id, nl, reference, split, prediction): an assistant turn and the user turn before it."""
    conv = table(spark, sf_dir, "conversations")
    a = conv.where(F.col("role") == "assistant").select("conv_id", "turn", F.col("text").alias("reference"))
    u = conv.where(F.col("role") == "user").select("conv_id", (F.col("turn") + 1).alias("turn"),
                                                   F.col("text").alias("nl"))
    j = a.join(u, ["conv_id", "turn"])
    m10, m3 = F.col("conv_id") % 10, F.col("conv_id") % 3
    half = F.substring(F.col("reference"), F.lit(1),
                       F.floor(F.length("reference") / 2).cast("int"))
    return j.select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("example_id"),
        "nl", "reference",
        F.when(m10 == 0, "test").when(m10 == 1, "validation").otherwise("train").alias("split"),
        F.when(m3 == 0, F.col("reference")).when(m3 == 1, half).otherwise(F.col("nl")).alias("prediction"),
    )


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw model output with fences, padding and stop strings; every 17th example is missing."""
    p = pairs(spark, sf_dir)
    m4 = F.col("example_id") % 4
    raw = (F.when(m4 == 0, F.concat("prediction", F.lit("\n```\n"), "nl"))
           .when(m4 == 1, F.concat(F.lit("  \n"), "prediction", F.lit(" \t")))
           .when(m4 == 2, F.concat("prediction", F.lit("<|end|>"), "nl"))
           .otherwise(F.col("prediction")))
    return p.where(F.col("example_id") % 17 != 0).select(
        "example_id", (F.col("example_id") % 5 == 0).alias("api_model"), raw.alias("raw"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten ranked predictions per example; rank 1 + id % 15 is the reference (ranks > 10: none)."""
    p = pairs(spark, sf_dir)
    ranked = p.select("example_id", "reference", "prediction",
                      F.explode(F.sequence(F.lit(1), F.lit(10))).alias("rank"))
    return ranked.select(
        "example_id", "reference", "rank",
        F.when(F.col("rank") == 1 + F.col("example_id") % 15, F.col("reference"))
        .otherwise(F.concat("prediction", F.lit("#"), F.col("rank").cast("string"))).alias("candidate"))


def mbpp_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text, test_list, code): a document's first line is the problem, every further line a
    test (the whole text is used; one-line documents have no tests)."""
    d = table(spark, sf_dir, "documents")
    lines = F.split("text", "\n")
    return d.select("doc_id", F.get(lines, 0).alias("text"),
                    F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))).alias("test_list"),
                    F.col("source").alias("code"))


def apps_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    m5, m4 = F.col("doc_id") % 5, F.col("doc_id") % 4
    return d.select(
        "doc_id",
        F.when(F.col("doc_id") % 10 == 0, "test").otherwise("train").alias("split"),
        F.col("text").alias("question"),
        F.when(F.col("doc_id") % 3 == 0, "def f(x):").otherwise("").alias("starter_code"),
        F.when(m5 == 0, '{"fn_name":"f","inputs":[]}').when(m5 == 1, '{"inputs":[]}')
        .when(m5 == 2, "").when(m5 == 3, "{bad").otherwise('{"fn_name":""}').alias("input_output"),
        F.when(m4 == 0, '["s1","s2"]').when(m4 == 1, '["only"]').when(m4 == 2, "")
        .otherwise("bad[").alias("solutions"),
    )


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(problem_id, gen_id, test_id, status): -2 compile error, -1 runtime error, 0 fail, 1 pass."""
    e = table(spark, sf_dir, "events")
    g = F.col("event_id") % 3
    return e.select(
        F.col("user_id").alias("problem_id"), g.cast("int").alias("gen_id"), F.col("event_id").alias("test_id"),
        F.when((F.col("user_id") + g) % 4 == 0, 1).when(F.col("event_type") == "error", -2)
        .when(F.col("event_type") == "signup", -1).when(F.col("event_type") == "click", 0)
        .otherwise(1).alias("status"))


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, ts, poll_ts, device, used_mb); -1.0 marks a failed read."""
    e = table(spark, sf_dir, "events")
    return e.select(
        (F.col("user_id") % 20).alias("run_id"), "ts",
        F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz").alias("poll_ts"),
        (F.col("event_id") % 4).cast("int").alias("device"),
        F.when(F.col("event_id") % 97 == 0, F.lit(-1.0)).otherwise(F.col("value")).alias("used_mb"))


def sweep_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(lora_r, lora_alpha, seed, eval_loss); the run of one grid cell (r 64, alpha 32) is missing, for the queries that
    look for such cells."""
    return all_sweep_runs(spark, sf_dir).where("not (lora_r = 64 and lora_alpha = 32)")


def all_sweep_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(lora_r, lora_alpha, seed, eval_loss) from all events."""
    e = table(spark, sf_dir, "events")
    q = F.floor((F.col("user_id") % 16) / 4)
    r = F.when(q == 0, 8).when(q == 1, 16).when(q == 2, 32).otherwise(64)
    a4 = F.col("user_id") % 4
    alpha = F.when(a4 == 0, 16).when(a4 == 1, 32).when(a4 == 2, 64).otherwise(128)
    s5 = F.col("event_id") % 5
    seed = F.when(s5 == 0, 42).when(s5 == 1, 777).when(s5 == 2, 5432).when(s5 == 3, 55555).otherwise(97)
    return (e.groupBy(r.alias("lora_r"), alpha.alias("lora_alpha"), seed.alias("seed"))
            .agg(F.round(F.avg("value"), 6).alias("eval_loss")))


def retrieval_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where(F.col("vec_id") % 50 == 0) \
        .select(F.col("vec_id").alias("query_id"), "embedding")


def document_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, embedding) of every document that is no query's: documents share the vectors in turn."""
    e = table(spark, sf_dir, "embeddings")
    n = e.select(F.count(F.lit(1))).scalar()
    docs = table(spark, sf_dir, "documents").select("doc_id").withColumn("vec_id", F.col("doc_id") % n)
    queries = retrieval_queries(spark, sf_dir).select(F.col("query_id").alias("doc_id"))
    return docs.join(e, "vec_id").select("doc_id", "embedding").join(queries, "doc_id", "left_anti")


def knowledge_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where(F.col("vec_id") % 50 != 0) \
        .select(F.col("vec_id").alias("doc_id"), "embedding")


#: (JSON text, its truthy ``fn_name`` as text, first element of a list or '' for anything else)
JSON_CASES = [
    ('{"fn_name":"f"}', "f", ""), ('{"fn_name":"f"} junk', None, ""), ('{"fn_name":false}', None, ""), ('{"fn_name":true}', "true", ""),
    ('{"fn_name":0}', None, ""), ('{"fn_name":2}', "2", ""), ('{"fn_name":[]}', None, ""), ('{"fn_name":{}}', None, ""),
    ('{"fn_name":null}', None, ""), ('{"fn_name":""}', None, ""), ('{"other":1}', None, ""), ('["a","b"]', None, "a"),
    ('["a"] junk', None, ""), ('["a"], ["b"]', None, ""), ("[]", None, None), ("", None, ""), ("{bad", None, ""), ('"text"', None, ""),
    (' ["a"] ', None, "a"), ('{"fn_name":"false"}', "false", ""),
]


# ---------------------------------------------------------------------------------------------
# The same views for DuckDB (oracle side).  Only the tables are pre-registered there.
DUCK_VIEWS = {
    "pairs": """
select a.conv_id * 100 + a.turn as example_id, u.text as nl, a.text as reference,
  case when a.conv_id % 10 = 0 then 'test' when a.conv_id % 10 = 1 then 'validation' else 'train' end as split,
  case a.conv_id % 3 when 0 then a.text
    when 1 then substring(a.text, 1, cast(floor(length(a.text) / 2) as int)) else u.text end as prediction
from conversations a join conversations u on a.conv_id = u.conv_id and u.turn = a.turn - 1
where a.role = 'assistant' and u.role = 'user'""",
    "responses": """
select example_id, example_id % 5 = 0 as api_model,
  case example_id % 4 when 0 then concat(prediction, chr(10), '```', chr(10), nl)
    when 1 then concat('  ', chr(10), prediction, ' ', chr(9))
    when 2 then concat(prediction, '<|end|>', nl) else prediction end as raw
from pairs where example_id % 17 <> 0""",
    "candidates": """
select example_id, reference, rank,
  case when rank = 1 + example_id % 15 then reference else concat(prediction, '#', rank) end as candidate
from pairs cross join (values (1),(2),(3),(4),(5),(6),(7),(8),(9),(10)) t(rank)""",
    "mbpp_raw": """
select doc_id, string_split(text, chr(10))[1] as text,
  list_slice(string_split(text, chr(10)), 2, len(string_split(text, chr(10)))) as test_list, source as code from documents""",
    "apps_raw": """
select doc_id, case when doc_id % 10 = 0 then 'test' else 'train' end as split,
  text as question,
  case when doc_id % 3 = 0 then 'def f(x):' else '' end as starter_code,
  case doc_id % 5 when 0 then '{"fn_name":"f","inputs":[]}' when 1 then '{"inputs":[]}'
    when 2 then '' when 3 then '{bad' else '{"fn_name":""}' end as input_output,
  case doc_id % 4 when 0 then '["s1","s2"]' when 1 then '["only"]' when 2 then '' else 'bad[' end as solutions
from documents""",
    "outcomes": """
select user_id as problem_id, cast(event_id % 3 as int) as gen_id, event_id as test_id,
  case when (user_id + event_id % 3) % 4 = 0 then 1 when event_type = 'error' then -2
    when event_type = 'signup' then -1 when event_type = 'click' then 0 else 1 end as status
from events""",
    "telemetry": """
select user_id % 20 as run_id, ts, date_trunc('hour', ts) as poll_ts, cast(event_id % 4 as int) as device,
  case when event_id % 97 = 0 then -1.0 else value end as used_mb
from events""",
    "all_runs": """
select case floor((user_id % 16) / 4) when 0 then 8 when 1 then 16 when 2 then 32 else 64 end as lora_r,
  case user_id % 4 when 0 then 16 when 1 then 32 when 2 then 64 else 128 end as lora_alpha,
  case event_id % 5 when 0 then 42 when 1 then 777 when 2 then 5432 when 3 then 55555 else 97 end as seed,
  round(avg(value), 6) as eval_loss
from events group by 1, 2, 3""",
    "sweep_runs": "select * from all_runs where not (lora_r = 64 and lora_alpha = 32)",
    "kb_docs": """
select d.doc_id, e.embedding from documents d join embeddings e on e.vec_id = d.doc_id % (select count(*) from embeddings)
where d.doc_id not in (select query_id from rq)""",
    "rq": "select vec_id as query_id, embedding from embeddings where vec_id % 50 = 0",
    "kb": "select vec_id as doc_id, embedding from embeddings where vec_id % 50 <> 0",
}

_ORDER = ["pairs", "responses", "candidates", "mbpp_raw", "apps_raw", "outcomes", "telemetry",
          "all_runs", "sweep_runs", "rq", "kb", "kb_docs"]


def duck_with(*views: str) -> str:
    """A ``WITH`` clause defining the named views (and the views they depend on)."""
    need = set(views)
    if need & {"responses", "candidates"}:
        need.add("pairs")
    if "sweep_runs" in need:
        need.add("all_runs")
    parts = [f"{v} as ({DUCK_VIEWS[v].strip()})" for v in _ORDER if v in need]
    return "with " + ",\n".join(parts) + "\n"
