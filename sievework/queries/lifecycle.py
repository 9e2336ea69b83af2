"""Queries of lifecycle events, vendors, templates and the smaller operators."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from ..functions import mime, text, vendor
from ..operators import json_records, lifecycle, usage
from ..sources import url
from ..streaming import rollups, usage_stream
from .base import MEASURES_SQL, USAGE_SQL, query, scalar, shared_folder, sql_text, table, usage_events

_URLS = ["https://api.openai.com/v1", "http://u:p@API.GROQ.com:443/x?y", "https://my.proxy/v1", "api.mistral.ai", "https://api.together.xyz#f", ""]
_HOST = r"lower(regexp_extract(trim({x}), '^(?:[^/?#]*?://)?(?:[^/?#]*@)?([^/?#:@]*)', 1))"
_VENDOR = "(MAP {{" + ", ".join(f"{sql_text(k)}: {sql_text(v)}" for k, v in vendor.VENDORS.items()) + "}})[" + _HOST + "]"
scalar("vendor_of_url", _URLS, vendor.vendor_of_url, _VENDOR)
_MODELS = ["openai/gpt-4o-mini", "gpt-4o", "OpenAI/gpt", "meta/llama", "openai/"]
scalar("direct_model", _MODELS, lambda x: vendor.direct_model(F.lit("https://api.openai.com/v1"), x), "CASE WHEN lower({x}) LIKE 'openai/_%' THEN substr({x}, 8) ELSE {x} END")
_STATES = ["completed", "failed", "timed_out", "canceled", "terminated", "running", "paused"]
scalar("execution_status", _STATES, lambda x: lifecycle.execution_status(x, F.when(F.col("event_id") % 2 == 0, F.lit("queued"))), "CASE WHEN {x} = 'completed' THEN 'succeeded' WHEN {x} IN ('failed', 'timed_out') THEN 'failed' WHEN {x} IN ('canceled', 'terminated') THEN 'cancelled' WHEN event_id % 2 = 0 THEN 'queued' ELSE 'running' END")
scalar("string_leaves", ['{"b": ["x#", 1, "y"], "a": "z", "c": 3}', '{"a": ""}', "{}"], lambda x: F.udf(lambda t: " ".join(json_records.string_leaves(__import__("json").loads(t))), "string", useArrow=True)(x), "CASE event_id % 3 WHEN 0 THEN 'z x' || event_id || ' y' ELSE '' END")
query("format_scaled", "SELECT event_id, ((event_id - 500)::DECIMAL(18,2) / 100)::DECIMAL(18,2)::VARCHAR AS y FROM events")(lambda spark, d: table(spark, d, "events").select("event_id", text.format_scaled(F.col("event_id") - 500, 2).alias("y")))
query("url_template", "SELECT event_id, 'https://x/' || strftime(ts - INTERVAL 1 DAY, '%Y-%m-%d') || '/' || strftime(ts, '%H') AS y FROM events")(
    lambda spark, d: table(spark, d, "events").select("event_id", F.udf(lambda t: url.render("https://x/{{ date-1d:%Y-%m-%d }}/{{ date:%H }}", t.replace(tzinfo=timezone.utc) if isinstance(t, datetime) else t), "string", useArrow=True)("ts").alias("y"))
)
query("source_resolve_index", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'own' ELSE 'datasets' END AS y FROM events")(lambda spark, d: table(spark, d, "events").select("event_id", mime.resolve_index(F.lit(None).cast("string"), F.when(F.col("event_id") % 2 == 0, F.lit("own")), F.lit(mime.CSV), F.lit("x")).alias("y")))
_ERRORS = ["invalid input: x", "boom", "", "no lab credits"]


def _jobs(spark, d):
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("job_id"), F.get(F.array(*map(F.lit, ["succeeded", "failed", "cancelled"])), (F.col("o_orderkey") % 3).cast("int")).alias("status"), F.get(F.array(*map(F.lit, _ERRORS)), (F.col("o_orderkey") % 4).cast("int")).alias("error"), F.col("o_orderdate").alias("started_at"), (F.col("o_orderdate") + F.expr("INTERVAL 1 SECOND") * ((F.col("o_custkey") % 9 - 2).cast("int"))).alias("finished_at"))


def _steps(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("flag"))
    return rows.select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("step_no"), F.concat(F.lit("s"), F.col("l_linenumber").cast("string")).alias("step_id"), F.lit("chunker").alias("plugin"), F.when(F.col("flag") == "A", F.lit("failed")).otherwise(F.lit("succeeded")).alias("status"), F.concat(F.lit("invalid config: "), F.col("l_linenumber").cast("string")).alias("error"))


query("lifecycle_event", """WITH j AS (SELECT o_orderkey AS job_id, (['succeeded', 'failed', 'cancelled'])[o_orderkey % 3 + 1] AS status, (['invalid input: x', 'boom', '', 'no lab credits'])[o_orderkey % 4 + 1] AS error, o_custkey % 9 - 2 AS secs FROM orders),
 f AS (SELECT l_orderkey AS job_id, min(l_linenumber) AS n FROM (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS flag FROM lineitem GROUP BY 1, 2) WHERE flag = 'A' GROUP BY 1)
 SELECT job_id, CASE status WHEN 'succeeded' THEN 'job.completed' WHEN 'cancelled' THEN 'job.cancelled' ELSE 'job.failed' END AS type, CASE WHEN status = 'succeeded' THEN greatest(0, secs) END::BIGINT AS duration_secs, CASE WHEN status = 'failed' AND n IS NOT NULL THEN 's' || n END AS step,
 CASE WHEN status = 'failed' THEN CASE WHEN n IS NOT NULL THEN 'invalid_config' WHEN error = 'invalid input: x' THEN 'invalid_input' WHEN error = 'no lab credits' THEN 'insufficient_credits' ELSE 'internal' END END AS reason, CASE WHEN status = 'failed' THEN coalesce(nullif(error, ''), status) END AS error_message FROM j LEFT JOIN f USING (job_id)""")(
    lambda spark, d: lifecycle.lifecycle_events(_jobs(spark, d), _steps(spark, d))
)
query("usage_event_v2", "SELECT l_orderkey AS job_id, sum(l_partkey)::BIGINT AS cost_micro_usd, sum(l_linenumber) || ' pages, ' || count(*) || ' images' || CASE WHEN count(*) FILTER (l_returnflag = 'R') > 0 THEN ' (provider cost incomplete)' ELSE '' END AS description FROM lineitem GROUP BY 1")(
    lambda spark, d: lifecycle.usage_recorded(table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("job_id")).agg(F.sum(F.col("l_linenumber").cast("long")).alias("pages"), F.count("*").alias("images"), F.sum("l_partkey").cast("decimal(38,0)").alias("cost_micro_usd"), F.count_if(F.col("l_returnflag") == "R").alias("unpriced_calls")))
)
query("json_migrate", """SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN '{"a":' || (event_id + 1) || ',"b":0}' WHEN 1 THEN '{"p":0}' ELSE '{}' END AS units FROM events""")(
    lambda spark, d: lifecycle.migrate_units(table(spark, d, "events").select(F.col("event_id").alias("id"), F.replace(F.get(F.array(F.lit('{"units": {"b": "x", "a": #.2}}'), F.lit('{"units": {"p": -4}}'), F.lit('{"units": 3}')), (F.col("event_id") % 3).cast("int")), F.lit("#"), F.col("event_id").cast("string")).alias("body")))
)


def _replace_partitions(spark, d):
    """The billing table written twice: the second run replaces only the months that it has."""
    path = shared_folder(spark, "billing") + "/t"
    rollup = usage.daily(usage_events(spark, d)).withColumn("month", F.trunc("day", "MM").cast("string"))
    rollup.withColumn("steps", F.lit(-1).cast("long")).write.partitionBy("month").parquet(path)
    rollup.where("day >= DATE'1997-01-01'").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)
    return spark.read.parquet(path).groupBy(F.year("day").alias("year")).agg(F.sum("steps").alias("steps"), F.count("*").alias("n"))


_YEARS = f"WITH {USAGE_SQL}, r AS (SELECT project_id, ts::DATE AS day, pipeline_uid, plugin, {MEASURES_SQL} FROM events_u GROUP BY ALL)"
query("partition_replace", f"{_YEARS} SELECT year(day)::INT AS year, sum(CASE WHEN day >= DATE '1997-01-01' THEN steps ELSE -1 END)::BIGINT AS steps, count(*) AS n FROM r GROUP BY 1")(_replace_partitions)


def _stream_billing(spark, d):
    """Events delivered as a stream of files, some twice; the billing table kept by batches."""
    folder = shared_folder(spark, "stream")
    events = usage_events(spark, d)
    events.unionByName(events.where("kind = 'step'")).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{folder}/in")
    usage_stream.maintain_billing(stream, f"{folder}/raw", f"{folder}/out", f"{folder}/check", "1997-06-01").awaitTermination()
    return spark.read.parquet(f"{folder}/out").groupBy("project_id").agg(F.sum("steps").alias("steps"), F.sum("jobs").alias("jobs"))


query("stream_billing", f"{_YEARS.replace('FROM events_u', 'FROM (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY project_id, ts, event_id ORDER BY seq DESC) AS k FROM events_u) WHERE k = 1)')} SELECT project_id, sum(steps)::BIGINT AS steps, sum(jobs)::BIGINT AS jobs FROM r WHERE day >= DATE '1997-05-01' GROUP BY 1")(_stream_billing)


def _stream_rollup(spark, d):
    """Events in four deliveries, of which later ones bring other figures or come too late; the rollup kept by batches."""
    folder = shared_folder(spark, "rollup")
    events = usage_events(spark, d)
    steps = spark.read.schema(events.schema).parquet
    first = [f"{folder}/in/{n}" for n in range(2)]
    deliveries = (
        lambda: events.where("year(ts) < 1997"), lambda: events.where("year(ts) >= 1997"),
        lambda: steps(*first).where("kind = 'step' AND llm_requests % 2 = 0").withColumns({"seq": F.col("seq") + 10**15, "duration_ms": F.col("duration_ms") + 5, "documents_out": F.col("documents_out") * 2}),
        lambda: steps(*first).where("kind = 'step' AND llm_requests % 3 = 0").withColumns({"seq": F.col("seq") - 10**15, "duration_ms": F.lit(0).cast("long")}),
    )
    for n, part in enumerate(deliveries):  # a delivery is a batch
        part().write.parquet(f"{folder}/in/{n}")
        stream = spark.readStream.schema(events.schema).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
        rollups.maintain(stream, f"{folder}/out", f"{folder}/check").awaitTermination()
    return rollups.read_rollup(spark, f"{folder}/out")


_REDELIVERED = """now_u AS (SELECT * REPLACE (CASE WHEN kind = 'step' AND llm_requests % 2 = 0 THEN duration_ms + 5 ELSE duration_ms END AS duration_ms, CASE WHEN kind = 'step' AND llm_requests % 2 = 0 THEN documents_out * 2 ELSE documents_out END AS documents_out) FROM
 (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY project_id, ts, event_id ORDER BY seq DESC) AS k FROM events_u) WHERE k = 1))"""
query("stream_rollup", f"WITH {USAGE_SQL}, {_REDELIVERED} SELECT project_id, ts::DATE AS day, pipeline_uid, plugin, count(*) AS rows_count, {MEASURES_SQL} FROM now_u GROUP BY ALL")(_stream_rollup)
