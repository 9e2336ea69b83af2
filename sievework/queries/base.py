"""What the registered queries share: tables, sample texts by row, derived tables and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import shared_folder as shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def sample(texts: list[str], id_: Column) -> Column:
    """A text by row; # stands for the row's number."""
    return F.replace(F.get(F.array(*map(F.lit, texts)), (id_ % len(texts)).cast("int")), F.lit("#"), id_.cast("string"))


def sql_text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def sample_sql(texts: list[str], id_: str) -> str:
    return f"replace(([{', '.join(map(sql_text, texts))}])[{id_} % {len(texts)} + 1], '#', {id_}::VARCHAR)"


def scalar(name: str, texts: list[str], function: Callable[[Column], Column], sql: str, source: str = "events", key: str = "event_id") -> None:
    """Registers function over sample texts of every row of a table; sql is the same with {x} for the text."""
    query(name, f"SELECT {key}, x, {sql.format(x='x')} AS y FROM (SELECT {key}, {sample_sql(texts, key)} AS x FROM {source})")(
        lambda spark, d: table(spark, d, source).select(key, sample(texts, F.col(key)).alias("x")).select(key, "x", function(F.col("x")).alias("y"))
    )


def usage_events(spark: SparkSession, d: str) -> DataFrame:
    """Jobs from orders and their steps from lineitem as usage events."""
    orders, lines = table(spark, d, "orders"), table(spark, d, "lineitem")
    job = lambda c: F.col(c).cast("string")
    common = [
        F.col("o_orderdate").alias("ts"), job("o_orderkey").alias("job_id"), F.concat(F.lit("p"), (F.col("o_custkey") % 7).cast("string")).alias("project_id"),
        F.concat(F.lit("pipe"), F.substring("o_orderpriority", 1, 1)).alias("pipeline_uid"),
    ]
    numbers = lambda **k: [k.get(c, F.lit(0)).cast("double" if c == "audio_seconds" else "long").alias(c) for c in _NUMBERS]
    status = F.when(F.col("o_orderstatus") == "F", F.lit("succeeded")).when(F.col("o_orderstatus") == "O", F.lit("failed")).otherwise(F.lit("cancelled"))
    steps = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).select(
        F.concat_ws(":", job("o_orderkey"), job("l_linenumber"), F.lit("1")).alias("event_id"), F.lit("step").alias("kind"), *common, F.concat(F.lit("plug"), job("l_linenumber")).alias("plugin"), status.alias("status"), (F.col("l_partkey") * 10**7 + F.col("l_suppkey") * 1000 + F.col("l_quantity").cast("long")).alias("seq"),
        *numbers(documents_out=F.col("l_quantity"), input_bytes=F.col("l_partkey") * 100, duration_ms=F.floor("l_extendedprice"), llm_input_tokens=F.col("l_partkey"), llm_output_tokens=F.col("l_suppkey"), llm_requests=F.col("l_linenumber"), audio_seconds=F.col("l_quantity"), pages=F.col("l_linenumber"), images=F.lit(1), external_requests=F.lit(2)),
    )
    jobs = orders.select(F.concat(job("o_orderkey"), F.lit(":job")).alias("event_id"), F.lit("job").alias("kind"), *common, F.lit("").alias("plugin"), status.alias("status"), F.lit(0).cast("long").alias("seq"), *numbers(documents_out=F.col("o_custkey"), duration_ms=F.floor("o_totalprice")))
    return steps.unionByName(jobs)


_NUMBERS = ["documents_out", "input_bytes", "duration_ms", "llm_input_tokens", "llm_output_tokens", "llm_requests", "audio_seconds", "pages", "images", "external_requests"]

_STATUS = "CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'O' THEN 'failed' ELSE 'cancelled' END AS status"
_COMMON = "o_orderdate AS ts, o_orderkey::VARCHAR AS job_id, 'p' || (o_custkey % 7)::VARCHAR AS project_id, 'pipe' || substr(o_orderpriority, 1, 1) AS pipeline_uid"
USAGE_SQL = f"""events_u AS (
  SELECT o_orderkey || ':' || l_linenumber || ':1' AS event_id, 'step' AS kind, {_COMMON}, 'plug' || l_linenumber AS plugin, {_STATUS}, l_partkey::BIGINT * 10000000 + l_suppkey * 1000 + l_quantity::BIGINT AS seq, l_quantity::BIGINT AS documents_out, (l_partkey * 100)::BIGINT AS input_bytes,
    floor(l_extendedprice)::BIGINT AS duration_ms, l_partkey::BIGINT AS llm_input_tokens, l_suppkey::BIGINT AS llm_output_tokens, l_linenumber::BIGINT AS llm_requests, l_quantity::DOUBLE AS audio_seconds, l_linenumber::BIGINT AS pages, 1::BIGINT AS images, 2::BIGINT AS external_requests
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  UNION ALL
  SELECT o_orderkey || ':job', 'job', {_COMMON}, '', {_STATUS}, 0, o_custkey::BIGINT, 0, floor(o_totalprice)::BIGINT, 0, 0, 0, 0::DOUBLE, 0, 0, 0 FROM orders)"""

_STEP = "coalesce(sum({0}) FILTER (kind = 'step'), 0)"
MEASURES_SQL = (
    "count(*) FILTER (kind = 'step') AS steps, count(*) FILTER (kind = 'job') AS jobs, count(*) FILTER (kind = 'job' AND status = 'succeeded') AS jobs_succeeded, count(*) FILTER (kind = 'job' AND status = 'failed') AS jobs_failed, "
    "coalesce(sum(documents_out) FILTER (kind = 'job'), 0)::BIGINT AS documents_indexed, " + ", ".join(f"{_STEP.format(c)}::{'DOUBLE' if c == 'audio_seconds' else 'BIGINT'} AS {c}" for c in _NUMBERS)
)


def jobs_table(spark: SparkSession, d: str) -> DataFrame:
    """orders as jobs; every third names the job before it as its parent."""
    o = table(spark, d, "orders")
    status = F.get(F.array(*map(F.lit, ["queued", "running", "succeeded", "failed", "cancelled"])), (F.col("o_orderkey") % 5).cast("int"))
    return o.select(
        F.col("o_orderkey").alias("job_id"), F.concat(F.lit("t"), (F.col("o_custkey") % 5).cast("string")).alias("tenant_id"), status.alias("status"), F.col("o_orderpriority").alias("pipeline_uid"), F.col("o_orderdate").alias("started_at"),
        (F.col("o_orderdate") + F.expr("INTERVAL 2 DAYS")).alias("updated_at"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey") - 1).alias("parent_job_id"),
        F.when(F.col("o_orderkey") % 7 == 0, F.col("o_orderdate")).alias("blobs_deleted_at"), F.when(F.col("o_orderkey") % 11 == 0, F.expr("TIMESTAMP_NTZ '1998-07-01 00:00:00'")).alias("blobs_claimed_at"),
        F.concat(F.lit("step"), (F.col("o_orderkey") % 4).cast("string")).alias("current_step"), F.when(F.col("o_orderkey") % 5 == 3, F.lit("boom")).alias("error"), F.lit("documents").alias("index_name"),
    )


JOBS_SQL = """jobs AS (SELECT o_orderkey AS job_id, 't' || (o_custkey % 5) AS tenant_id, (['queued', 'running', 'succeeded', 'failed', 'cancelled'])[o_orderkey % 5 + 1] AS status, o_orderpriority AS pipeline_uid,
  o_orderdate AS started_at, o_orderdate + INTERVAL 2 DAYS AS updated_at, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey - 1 END AS parent_job_id, CASE WHEN o_orderkey % 7 = 0 THEN o_orderdate END AS blobs_deleted_at,
  CASE WHEN o_orderkey % 11 = 0 THEN TIMESTAMP '1998-07-01' END AS blobs_claimed_at, 'step' || (o_orderkey % 4) AS current_step, CASE WHEN o_orderkey % 5 = 3 THEN 'boom' END AS error, 'documents' AS index_name FROM orders)"""


def runs_table(spark: SparkSession, d: str) -> DataFrame:
    """events as runs of sources, one source a user."""
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("run_id"), F.col("user_id").alias("source_id"), F.col("ts").alias("started_at"), F.when(F.col("event_type").isin("error", "view"), F.lit("failed")).otherwise(F.lit("ingested")).alias("outcome"))


RUNS_SQL = "runs AS (SELECT event_id AS run_id, user_id AS source_id, ts AS started_at, CASE WHEN event_type IN ('error', 'view') THEN 'failed' ELSE 'ingested' END AS outcome FROM events)"
