"""Queries of usage metering and the control plane."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import control, enrich, json_records, parquet_scan, sink, usage
from ..sources import url
from ..operators.index import read_index
from ..plans.catalog import OPERATORS
from ..plans.pipeline import Pipeline, build
from .base import JOBS_SQL, MEASURES_SQL, RUNS_SQL, USAGE_SQL, jobs_table, query, shared_folder, runs_table, table, usage_events

_DAILY = "SELECT project_id, ts::DATE AS day, pipeline_uid, plugin, count(*) AS rows_count, {m} FROM {t} GROUP BY ALL"
# steps delivered again later, with other figures; the last delivery of an event counts
_TWICE = "twice AS (SELECT * FROM events_u UNION ALL SELECT * REPLACE (seq + 1000000000000000 AS seq, duration_ms + 5 AS duration_ms) FROM events_u WHERE kind = 'step')"
_ONCE = "once AS (SELECT * EXCLUDE (seq, k) FROM (SELECT *, row_number() OVER (PARTITION BY project_id, ts, event_id ORDER BY seq DESC) AS k FROM twice) WHERE k = 1)"
NOW = "TIMESTAMP '1998-08-02 00:00:00'"


def _twice(spark, d):
    e = usage_events(spark, d)
    again = e.where("kind = 'step'").withColumns({"seq": F.col("seq") + 10**15, "duration_ms": F.col("duration_ms") + 5})
    return e.unionByName(again)


query("usage_dedup", f"WITH {USAGE_SQL}, {_TWICE}, {_ONCE} SELECT * FROM once")(lambda spark, d: usage.dedup(_twice(spark, d)))
query("usage_daily", f"WITH {USAGE_SQL} {_DAILY.format(m=MEASURES_SQL, t='events_u')}")(lambda spark, d: usage.daily(usage_events(spark, d)))
query("usage_daily_partial_final", f"WITH {USAGE_SQL} {_DAILY.format(m=MEASURES_SQL, t='events_u')}")(lambda spark, d: usage.merge(usage.partials(usage_events(spark, d), F.pmod(F.xxhash64("event_id"), F.lit(8)))))
query("usage_daily_duplicates", f"WITH {USAGE_SQL}, {_TWICE} {_DAILY.format(m=MEASURES_SQL, t='twice')}")(lambda spark, d: usage.daily(_twice(spark, d)))
query("usage_billing", f"WITH {USAGE_SQL}, {_TWICE}, {_ONCE} SELECT * EXCLUDE (rows_count) FROM ({_DAILY.format(m=MEASURES_SQL, t='once')}) WHERE day >= date_trunc('month', DATE '1997-06-01' - INTERVAL 2 DAYS)")(
    lambda spark, d: usage.billing(_twice(spark, d), F.lit("1997-06-01").cast("date"))
)
_REPORT = f"""WITH {USAGE_SQL}, {_TWICE}, {_ONCE} SELECT ts::DATE AS day, pipeline_uid, plugin, {MEASURES_SQL} FROM once WHERE project_id = 'p3' AND ts::DATE BETWEEN DATE '1995-01-01' AND DATE '1996-12-31' GROUP BY ALL"""
query("tenant_usage", _REPORT)(lambda spark, d: usage.tenant_usage(usage.daily(usage.dedup(_twice(spark, d))), "p3", "1995-01-01", "1996-12-31"))
query("usage_api_query", _REPORT)(lambda spark, d: usage.usage_report(_twice(spark, d), "p3", "1995-01-01", "1996-12-31"))
query("ttl", f"WITH {USAGE_SQL} SELECT event_id FROM events_u WHERE ts >= {NOW} - INTERVAL 180 DAYS")(lambda spark, d: usage.expired(usage_events(spark, d), F.expr("TIMESTAMP_NTZ '1998-08-02 00:00:00'")).select("event_id"))


def _steps(spark, d):
    status = F.when(F.col("l_linestatus") == "F", F.lit("succeeded")).otherwise(F.lit("failed"))
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("job_id"), F.concat(F.lit("s"), F.col("l_linenumber").cast("string"), F.lit("_"), F.col("l_partkey").cast("string"), F.lit("_"), F.col("l_suppkey").cast("string")).alias("step_id"), F.lit(1).alias("attempt"),
        (F.col("l_linenumber").cast("long") * 10**13 + F.col("l_partkey") * 10**7 + F.col("l_suppkey") * 1000 + F.col("l_quantity").cast("long") * 2 + (F.col("l_linestatus") == "F").cast("int")).alias("step_no"), F.when(F.col("l_linenumber") % 3 == 0, F.lit("index_sink")).when(F.col("l_linenumber") == 4, F.lit("ocr")).otherwise(F.lit("chunker")).alias("plugin"), status.alias("status"),
        F.col("l_quantity").cast("long").alias("documents_out"), F.floor("l_extendedprice").alias("duration_ms"), F.col("l_partkey").alias("llm_input_tokens"),
        (F.col("l_suppkey") * 2).alias("llm_output_tokens"), F.col("l_linenumber").cast("long").alias("llm_requests"), (F.col("l_quantity") / 4).alias("audio_seconds"), (F.col("l_linenumber") % 3).cast("long").alias("pages"), F.lit(1).cast("long").alias("images"),
        F.lit(2).cast("long").alias("external_requests"), (F.col("l_linenumber") + 1).alias("branches"), (F.col("l_partkey") * 10).alias("input_bytes"), F.when(F.col("l_linestatus") != "F", F.concat(F.lit(" HTTP 503 from upstream "), F.repeat(F.lit("e"), F.lit(600)))).alias("error"), (F.col("l_linenumber") % 2).cast("long").alias("unpriced_calls"),
    )


def _jobs(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("job_id"), F.when(F.col("o_orderstatus") == "F", F.lit("succeeded")).when(F.col("o_orderstatus") == "O", F.lit("failed")).otherwise(F.lit("cancelled")).alias("status"), F.col("o_orderdate").alias("started_at"), (F.col("o_orderdate") + F.expr("INTERVAL 90 SECONDS")).alias("finished_at"),
        F.concat(F.lit("w"), F.col("o_orderkey").cast("string")).alias("workflow_id"), F.concat(F.lit("p"), (F.col("o_custkey") % 7).cast("string")).alias("project_id"), F.lit("eu").alias("region"), F.lit("builtin.csv").alias("pipeline_uid"), F.lit(1).alias("pipeline_builtin"),
        F.lit("documents").alias("index_name"), F.lit("ingest").alias("task_queue"), F.lit("text/csv").alias("input_mime"), (F.col("o_custkey") * 100).alias("input_bytes"), F.when(F.col("o_orderstatus") == "O", F.lit("\u00a0\n")).when(F.col("o_orderstatus") == "P", F.lit("Deadline Exceeded")).alias("error"))


_STEPS = """steps AS (SELECT l_orderkey::VARCHAR AS job_id, 's' || l_linenumber || '_' || l_partkey || '_' || l_suppkey AS step_id, l_linenumber::BIGINT * 10000000000000 + l_partkey * 10000000 + l_suppkey * 1000 + l_quantity::BIGINT * 2 + (l_linestatus = 'F')::INT AS step_no, CASE WHEN l_linenumber % 3 = 0 THEN 'index_sink' WHEN l_linenumber = 4 THEN 'ocr' ELSE 'chunker' END AS plugin,
 l_suppkey * 2 AS llm_output_tokens, l_linenumber::BIGINT AS llm_requests, l_quantity / 4 AS audio_seconds, (l_linenumber % 3)::BIGINT AS pages, 1::BIGINT AS images, 2::BIGINT AS external_requests, (l_linenumber + 1)::INT AS branches, l_partkey * 10 AS input_bytes, CASE WHEN l_linestatus <> 'F' THEN ' HTTP 503 from upstream ' || repeat('e', 600) ELSE '' END AS error, (l_linenumber % 2)::BIGINT AS unpriced_calls,
 CASE l_linestatus WHEN 'F' THEN 'succeeded' ELSE 'failed' END AS status, l_quantity::BIGINT AS documents_out, floor(l_extendedprice)::BIGINT AS duration_ms, l_partkey AS llm_input_tokens FROM lineitem),
jobs AS (SELECT o_orderkey::VARCHAR AS job_id, CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'O' THEN 'failed' ELSE 'cancelled' END AS status, o_orderdate + INTERVAL 90 SECONDS AS ts, 'w' || o_orderkey AS workflow_id, 'p' || (o_custkey % 7) AS project_id, 'eu' AS region, 'builtin.csv' AS pipeline_uid, 1 AS pipeline_builtin, 'documents' AS index_name,
 'ingest' AS task_queue, 'text/csv' AS input_mime, o_custkey * 100 AS input_bytes, CASE o_orderstatus WHEN 'O' THEN chr(160) || chr(10) WHEN 'P' THEN 'Deadline Exceeded' ELSE '' END AS error FROM orders),
sums AS (SELECT job_id, sum(duration_ms) AS ms, sum(llm_input_tokens)::BIGINT AS llm_input_tokens, sum(llm_output_tokens)::BIGINT AS llm_output_tokens, sum(llm_requests)::BIGINT AS llm_requests, sum(audio_seconds) AS audio_seconds, sum(pages)::BIGINT AS pages, sum(images)::BIGINT AS images, sum(external_requests)::BIGINT AS external_requests, sum(unpriced_calls)::BIGINT AS unpriced, sum(CASE WHEN plugin = 'ocr' THEN CASE WHEN pages > 0 THEN pages ELSE documents_out END END)::BIGINT AS ocr,
 count(*) FILTER (plugin = 'index_sink') > 0 AS sink, coalesce(sum(documents_out) FILTER (plugin = 'index_sink' AND status = 'succeeded'), 0)::BIGINT AS sunk, arg_max(documents_out, step_no) AS last FROM steps GROUP BY 1),
totals AS (SELECT j.*, s.* EXCLUDE (job_id), coalesce(CASE WHEN sink THEN sunk WHEN j.status = 'succeeded' THEN last END, 0)::BIGINT AS docs FROM jobs j LEFT JOIN sums s USING (job_id))"""
query("documents_indexed", f"WITH {_STEPS} SELECT job_id, docs AS documents FROM totals")(
    lambda spark, d: _jobs(spark, d).join(_steps(spark, d).groupBy("job_id").agg(usage.indexed(F.col("step_no"), F.col("plugin"), F.col("status"), F.col("documents_out")).alias("r")), "job_id", "left").select("job_id", usage.documents_reached(F.col("status"), F.col("r")).alias("documents"))
)
_KIND = "CASE WHEN status = 'cancelled' THEN 'cancelled' WHEN contains(lower(error), 'http 5') THEN 'upstream' WHEN contains(lower(error), 'deadline exceeded') THEN 'timeout' ELSE '' END AS error_kind, left(error, 512) AS error"
query("events_for_job", f"""WITH {_STEPS} SELECT job_id || ':' || step_id || ':1' AS event_id, 'step' AS kind, 1 AS attempt, ts, job_id, workflow_id, project_id, region, pipeline_uid, pipeline_builtin, index_name, task_queue, input_mime, step_id, plugin, status, branches, duration_ms, input_bytes, documents_out, llm_input_tokens, llm_output_tokens, llm_requests, audio_seconds, pages, images, external_requests, {_KIND}
 FROM (SELECT s.*, j.* EXCLUDE (job_id, status, input_bytes, error) FROM steps s JOIN jobs j USING (job_id))
 UNION ALL SELECT job_id || ':job', 'job', 1, ts, job_id, workflow_id, project_id, region, pipeline_uid, pipeline_builtin, index_name, task_queue, input_mime, '', '', status, 0, 90000, input_bytes, docs, coalesce(llm_input_tokens, 0)::BIGINT AS llm_input_tokens, coalesce(llm_output_tokens, 0)::BIGINT AS llm_output_tokens, coalesce(llm_requests, 0)::BIGINT AS llm_requests, coalesce(audio_seconds, 0)::DOUBLE AS audio_seconds, coalesce(pages, 0)::BIGINT AS pages, coalesce(images, 0)::BIGINT AS images, coalesce(external_requests, 0)::BIGINT AS external_requests, {_KIND} FROM totals""")(lambda spark, d: usage.events_for_jobs(_steps(spark, d), _jobs(spark, d)))
query("wall_clock_ms", "SELECT event_id, greatest(0, (event_id % 5 - 2) * 1500)::BIGINT AS y FROM events")(
    lambda spark, d: table(spark, d, "events").select("event_id", usage.wall_clock_ms(F.col("ts").cast("timestamp"), F.timestamp_millis(F.unix_millis(F.col("ts").cast("timestamp")) + (F.col("event_id") % 5 - 2) * 1500)).alias("y"))
)
query("billing_units", f"""WITH {_STEPS} SELECT job_id, docs AS documents, input_bytes AS bytes_in, coalesce((ms + 999) // 1000, 0)::BIGINT AS step_seconds, coalesce(CASE WHEN audio_seconds > 0 THEN ceil(audio_seconds) END, 0)::BIGINT AS audio_seconds, coalesce(llm_input_tokens, 0) AS llm_tokens_in, coalesce(llm_output_tokens, 0) AS llm_tokens_out,
 coalesce(ocr, 0) AS ocr_pages, coalesce(pages, 0) AS pages, coalesce(images, 0) AS images, coalesce(llm_requests, 0) AS llm_requests, coalesce(external_requests, 0) AS external_requests, coalesce(unpriced, 0) AS unpriced_provider_calls FROM totals""")(lambda spark, d: usage.billing_units(_jobs(spark, d), _steps(spark, d)))
query("billing_units_nonfinite", "SELECT event_id::VARCHAR AS job_id, CASE WHEN event_id % 4 = 3 THEN 3 ELSE 0 END::BIGINT AS audio_seconds FROM events")(
    lambda spark, d: usage.billing_units(
        table(spark, d, "events").select(F.col("event_id").cast("string").alias("job_id"), F.lit("succeeded").alias("status"), F.lit(0).cast("long").alias("input_bytes")),
        table(spark, d, "events").select(F.col("event_id").cast("string").alias("job_id"), F.lit(1).alias("step_no"), F.lit("chunker").alias("plugin"), F.lit("succeeded").alias("status"), *(F.lit(0).cast("long").alias(c) for c in ("documents_out", "duration_ms", "unpriced_calls", *(u for u in usage.UNITS if u != "audio_seconds"))), F.get(F.array(F.lit(float("nan")), F.lit(float("inf")), F.lit(-2.0), F.lit(2.25)), (F.col("event_id") % 4).cast("int")).alias("audio_seconds")),
    ).select("job_id", "audio_seconds")
)
# Prices in micro-dollars (plugin, model, a million input and output tokens, second of audio, request).
PRICES = [("llm_enricher", "gpt-4o-mini", 150000, 600000, 0, 0), ("llm_enricher", "gpt-4o", 2500000, 10000000, 0, 0), ("image_captioner", "gpt-4o-mini", 150000, 600000, 0, 0), ("image_captioner", "gpt-4o", 2500000, 10000000, 0, 0), ("whisper_transcriber", "whisper-1", 0, 0, 100, 0)]
PRICE_COLUMNS = "plugin string, model string, input_per_mtok long, output_per_mtok long, per_audio_second long, per_request long"
_CALLS = [("llm_enricher", "gpt-4o-mini"), ("llm_enricher", "openai/gpt-4o"), ("whisper_transcriber", "whisper-1"), ("jev_enricher", "x"), ("image_captioner", "gpt-4o"), ("whisper_transcriber", "unknown")]


def _calls(spark, d):
    at = (F.col("l_linenumber") + F.col("l_partkey")) % len(_CALLS) + 1
    pick = lambda k: F.element_at(F.array(*(F.lit(c[k]) for c in _CALLS)), at.cast("int"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", pick(0).alias("plugin"), pick(1).alias("model"), (F.col("l_partkey") % 50 * 37).alias("llm_input_tokens"), F.col("l_suppkey").cast("long").alias("llm_output_tokens"), F.lit(1).cast("long").alias("llm_requests"), F.lit(0).cast("long").alias("external_requests"), (F.col("l_quantity") - 5).alias("audio_seconds"))


query("provider_cost", f"""WITH p(plugin, model, i, o, a, r) AS (VALUES {', '.join(map(str, PRICES))}),
 c AS (SELECT *, ([{', '.join(repr(c[0]) for c in _CALLS)}])[k] AS plugin, ([{', '.join(repr(c[1]) for c in _CALLS)}])[k] AS model FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_linenumber + l_partkey) % {len(_CALLS)} + 1 AS k, l_partkey % 50 * 37 AS ti, l_suppkey AS tto, l_quantity - 5 AS s FROM lineitem)),
 f AS (SELECT c.*, p.i, p.o, p.a, p.r FROM c LEFT JOIN p ON p.plugin = c.plugin AND p.model = regexp_replace(c.model, '^[^/]*/', '')),
 u AS (SELECT *, i IS NULL OR ((i > 0 OR o > 0) AND ti = 0 AND tto = 0) OR (a > 0 AND NOT s > 0) AS un FROM f)
 SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, plugin, model, ti AS llm_input_tokens, tto AS llm_output_tokens, 1 AS llm_requests, 0 AS external_requests, s AS audio_seconds, CASE WHEN un THEN 0 ELSE ((ti * i + tto * o + 999999) // 1000000 + ceil(s * a) + r)::BIGINT END AS cost_micro_usd, un::INT AS unpriced_calls FROM u""")(
    lambda spark, d: usage.provider_cost(_calls(spark, d), spark.createDataFrame(PRICES, PRICE_COLUMNS))
)
_NAMES = ["llm_enricher", "jev_enricher", "image_captioner", "whisper_transcriber", "chunker", "csv_parser"]


def _registered(spark: SparkSession, d: str) -> DataFrame:
    """A plugin of each part's brand; suppliers set prices, some of which are zero."""
    name = lambda n: F.get(F.array(*map(F.lit, _NAMES)), (n % len(_NAMES)).cast("int"))
    plugins = table(spark, d, "part").select(F.concat(name(F.col("p_partkey")), F.when(F.col("p_size") % 9 == 0, F.lit("_old")).otherwise(F.lit(""))).alias("plugin")).distinct()
    key = F.col("s_suppkey")
    rate = F.when((key % 6).isin(1, 2), 0).otherwise(key + 1).cast("long")
    prices = table(spark, d, "supplier").select(name(key).alias("plugin"), F.lit("default").alias("model"), rate.alias("input_per_mtok"), *(F.lit(0).cast("long").alias(c) for c in ("output_per_mtok", "per_audio_second", "per_request")))
    return usage.unpriced_plugins(plugins, prices).distinct()


query("unpriced_plugins", "SELECT DISTINCT plugin FROM (SELECT (['llm_enricher', 'jev_enricher', 'image_captioner', 'whisper_transcriber', 'chunker', 'csv_parser'])[p_partkey % 6 + 1] || CASE WHEN p_size % 9 = 0 THEN '_old' ELSE '' END AS plugin FROM part) WHERE plugin IN ('jev_enricher', 'image_captioner')")(_registered)
query("fan_out", "SELECT doc_id, floor((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) / ceil(count(*) OVER (PARTITION BY source) / 50))::BIGINT AS branch FROM documents")(
    lambda spark, d: usage.fan_out(table(spark, d, "documents").select("doc_id", "source"), ["doc_id"], 50, ["source"]).select("doc_id", "branch")
)


def _branches(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("step"), (F.col("l_linenumber").cast("long") * 10**13 + F.col("l_partkey") * 10**7 + F.col("l_suppkey") * 1000 + F.col("l_quantity").cast("long")).alias("branch"), F.when(F.col("l_returnflag") != "A", (F.col("l_returnflag") != "R") | (F.col("l_linenumber") > 2)).alias("ok"), F.concat(F.lit("err"), F.col("l_partkey").cast("string")).alias("error"), F.col("l_quantity").cast("long").alias("documents"), F.floor("l_extendedprice").alias("duration_ms"), F.col("l_partkey").alias("input_bytes"), F.col("l_suppkey").alias("pages"))


query("fan_in", """WITH b AS (SELECT l_orderkey AS step, l_linenumber::BIGINT * 10000000000000 + l_partkey * 10000000 + l_suppkey * 1000 + l_quantity::BIGINT AS branch, CASE WHEN l_returnflag = 'A' THEN NULL ELSE l_returnflag <> 'R' OR l_linenumber > 2 END AS ok, 'err' || l_partkey AS error, l_quantity::BIGINT AS documents, floor(l_extendedprice)::BIGINT AS duration_ms, l_partkey AS input_bytes, l_suppkey AS pages FROM lineitem)
 SELECT step, CASE WHEN count(*) FILTER (NOT ok) > 0 THEN 'failed' WHEN count(*) FILTER (ok) < count(*) THEN 'cancelled' ELSE 'succeeded' END AS outcome, count(*) AS branches, coalesce(sum(documents) FILTER (ok), 0)::BIGINT AS documents, coalesce(sum(duration_ms) FILTER (ok), 0)::BIGINT AS duration_ms, coalesce(sum(input_bytes) FILTER (ok), 0)::BIGINT AS input_bytes, coalesce(sum(pages) FILTER (ok), 0)::BIGINT AS pages,
 CASE WHEN count(*) FILTER (NOT ok) > 0 THEN count(*) - count(*) FILTER (ok) || ' of ' || count(*) || ' branches failed; first error: ' || arg_min(error, branch) FILTER (NOT ok) END AS error FROM b GROUP BY 1""")(lambda spark, d: usage.fan_in(_branches(spark, d)))


def _merged(spark: SparkSession, d: str) -> DataFrame:
    """A step that takes what two others gave, in the order of its dependencies."""
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("title"), "source", F.lit("x").alias("content"))
    steps = [
        {"id": "in", "plugin": "document_script", "config": {"keep": "true"}},
        {"id": "even", "plugin": "document_script", "depends_on": ["in"], "config": {"keep": "cast(id as int) % 2 = 0", "drop": ["source"]}},
        {"id": "third", "plugin": "document_script", "depends_on": ["in"], "config": {"keep": "cast(id as int) % 3 = 0", "set": {"title": "upper(title)"}}},
        {"id": "both", "plugin": "document_script", "depends_on": ["even", "third"], "config": {"keep": "title <> 'de'"}},
    ]
    return build(Pipeline.parse({"uid": "m", "steps": steps}), docs, OPERATORS)["both"].select("id", "title", "source")


query("resolve_input", "SELECT doc_id::VARCHAR AS id, lang AS title, NULL::VARCHAR AS source FROM documents WHERE doc_id % 2 = 0 AND lang <> 'de' UNION ALL SELECT doc_id::VARCHAR, upper(lang), source FROM documents WHERE doc_id % 3 = 0")(_merged)

# jobs
query("jobs_list", f"WITH {JOBS_SQL} SELECT job_id, status, started_at FROM jobs WHERE tenant_id = 't2' ORDER BY started_at DESC, job_id LIMIT 40 OFFSET 20")(lambda spark, d: control.jobs_list(jobs_table(spark, d), tenant="t2", limit=40, offset=20).select("job_id", "status", "started_at"))
query("capped_count", f"WITH {JOBS_SQL} SELECT count(*) AS total FROM (SELECT 1 FROM jobs WHERE status = 'failed' LIMIT 100)")(lambda spark, d: control.capped_count(jobs_table(spark, d).where("status = 'failed'"), 100))
_DUE = "status IN ('succeeded', 'failed', 'cancelled')"
query("blob_sweep_claim", f"WITH {JOBS_SQL} SELECT job_id, pipeline_uid FROM jobs j WHERE {_DUE} AND blobs_deleted_at IS NULL AND updated_at < {NOW} - INTERVAL 7 DAYS AND (blobs_claimed_at IS NULL OR blobs_claimed_at < {NOW} - INTERVAL 3600 SECONDS) AND NOT EXISTS (SELECT 1 FROM jobs c WHERE c.parent_job_id = j.job_id AND c.status NOT IN ('succeeded', 'failed', 'cancelled')) ORDER BY updated_at, job_id LIMIT 100")(
    lambda spark, d: control.blob_sweep_claim(jobs_table(spark, d), F.expr("TIMESTAMP_NTZ '1998-08-02 00:00:00'"), 7, 3600, 100).select("job_id", "pipeline_uid")
)
query("retention_jobs", f"WITH {JOBS_SQL} SELECT job_id FROM jobs j WHERE {_DUE} AND started_at < TIMESTAMP '1996-01-01' AND NOT EXISTS (SELECT 1 FROM jobs c WHERE c.parent_job_id = j.job_id)")(lambda spark, d: control.retention_jobs(jobs_table(spark, d), F.expr("TIMESTAMP_NTZ '1996-01-01 00:00:00'")).select("job_id"))
query("retention_runs", f"WITH {RUNS_SQL} SELECT run_id FROM runs WHERE started_at < (SELECT min(started_at) + INTERVAL 10 DAYS FROM runs)")(lambda spark, d: control.retention_runs(runs_table(spark, d), F.lit(runs_table(spark, d).agg(F.min("started_at") + F.expr("INTERVAL 10 DAYS")).first()[0]).cast("timestamp_ntz")).select("run_id"))


def _writes(spark, d):
    l = table(spark, d, "lineitem")  # noqa: E741
    status = F.element_at(F.array(*map(F.lit, ["queued", "running", "succeeded", "failed"])), (F.col("l_partkey") % 4 + 1).cast("int"))
    return l.select(F.col("l_orderkey").alias("job_id"), (F.col("l_linenumber").cast("long") * 10**13 + F.col("l_partkey") * 10**7 + F.col("l_suppkey") * 1000 + F.col("l_quantity").cast("long")).alias("seq"), status.alias("status"), F.concat(F.lit("st"), F.col("l_suppkey").cast("string")).alias("current_step"), F.when(F.col("l_partkey") % 4 == 3, F.lit("e")).alias("error"), F.col("l_shipdate").alias("started_at"), F.col("l_returnflag").alias("pipeline_uid"), F.col("l_linestatus").alias("tenant_id"), F.when(F.col("l_suppkey") % 3 == 0, F.col("l_suppkey")).alias("source_id"))


query("job_upsert", """WITH w AS (SELECT l_orderkey AS job_id, l_linenumber::BIGINT * 10000000000000 + l_partkey * 10000000 + l_suppkey * 1000 + l_quantity::BIGINT AS seq, (['queued', 'running', 'succeeded', 'failed'])[l_partkey % 4 + 1] AS status, 'st' || l_suppkey AS current_step, CASE WHEN l_partkey % 4 = 3 THEN 'e' END AS error, l_shipdate AS started_at, l_returnflag AS pipeline_uid, l_linestatus AS tenant_id, CASE WHEN l_suppkey % 3 = 0 THEN l_suppkey END AS source_id FROM lineitem),
 r AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY CASE status WHEN 'queued' THEN 0 WHEN 'running' THEN 1 ELSE 2 END DESC, seq DESC) AS k, row_number() OVER (PARTITION BY job_id ORDER BY seq DESC) AS n FROM w)
 SELECT a.job_id, b.pipeline_uid, b.tenant_id, a.status, a.current_step, a.error, a.started_at, s.source_id FROM r a JOIN r b ON a.job_id = b.job_id AND b.n = 1 JOIN (SELECT job_id, arg_max(source_id, seq) FILTER (source_id IS NOT NULL) AS source_id FROM w GROUP BY 1) s ON s.job_id = a.job_id WHERE a.k = 1""")(lambda spark, d: control.job_upsert(_writes(spark, d)))


def _patches(spark, d):
    c = table(spark, d, "orders").where("o_orderkey % 2 = 0")
    status = F.element_at(F.array(*map(F.lit, ["queued", "running", "succeeded"])), (F.col("o_custkey") % 3 + 1).cast("int"))
    return c.select(F.col("o_orderkey").alias("job_id"), F.when(F.col("o_custkey") % 4 != 0, status).alias("status"), F.when(F.col("o_custkey") % 5 == 0, F.lit("new")).alias("current_step"), F.when(F.col("o_custkey") % 6 == 0, F.lit("bad")).alias("error"), F.when(F.col("o_custkey") % 7 == 0, F.lit("pages")).alias("index_name"))


query("job_patch", f"""WITH {JOBS_SQL}, p AS (SELECT o_orderkey AS job_id, CASE WHEN o_custkey % 4 <> 0 THEN (['queued', 'running', 'succeeded'])[o_custkey % 3 + 1] END AS status, CASE WHEN o_custkey % 5 = 0 THEN 'new' END AS current_step, CASE WHEN o_custkey % 6 = 0 THEN 'bad' END AS error, CASE WHEN o_custkey % 7 = 0 THEN 'pages' END AS index_name FROM orders WHERE o_orderkey % 2 = 0),
 b AS (SELECT j.*, p.status AS ns, p.current_step AS nc, p.error AS ne, p.index_name AS ni, coalesce(CASE p.status WHEN 'queued' THEN 0 WHEN 'running' THEN 1 WHEN 'succeeded' THEN 2 END < CASE j.status WHEN 'queued' THEN 0 WHEN 'running' THEN 1 ELSE 2 END, false) AS stale FROM jobs j LEFT JOIN p USING (job_id))
 SELECT job_id, CASE WHEN stale THEN status ELSE coalesce(ns, status) END AS status, CASE WHEN stale THEN current_step WHEN ns = 'succeeded' THEN NULL ELSE coalesce(nc, current_step) END AS current_step, CASE WHEN stale THEN error ELSE coalesce(ne, error) END AS error, coalesce(ni, index_name) AS index_name FROM b""")(
    lambda spark, d: control.job_patch(jobs_table(spark, d), _patches(spark, d)).select("job_id", "status", "current_step", "error", "index_name")
)

# runs
query("failure_streak", f"WITH {RUNS_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY started_at DESC, run_id DESC) AS k FROM runs) SELECT source_id, coalesce(min(k) FILTER (outcome <> 'failed'), count(*) + 1) - 1 AS streak FROM k WHERE k <= 1000 GROUP BY 1")(lambda spark, d: control.failure_streak(runs_table(spark, d)))
query("status_transition", f"WITH {RUNS_SQL} SELECT run_id, source_id, CASE WHEN f THEN 'failing' ELSE 'ok' END AS transition FROM (SELECT *, outcome = 'failed' AS f, coalesce(lag(outcome = 'failed') OVER (PARTITION BY source_id ORDER BY started_at, run_id), false) AS b FROM runs) WHERE f <> b")(lambda spark, d: control.status_transition(runs_table(spark, d)).select("run_id", "source_id", "transition"))
query("latest_runs", f"WITH {RUNS_SQL} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY started_at DESC, run_id DESC) AS rank FROM runs) WHERE rank <= 5")(lambda spark, d: control.latest_runs(runs_table(spark, d), 5))
query("run_upsert", "SELECT user_id AS run_id, arg_min(ts, event_id) AS started_at, arg_max(event_type, event_id) AS outcome, arg_max(event_id % 9, event_id) AS items FROM events GROUP BY 1")(
    lambda spark, d: control.run_upsert(table(spark, d, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), F.col("ts").alias("started_at"), F.col("event_type").alias("outcome"), (F.col("event_id") % 9).alias("items")))
)
# runs of three kinds: by users (many jobs), single failing jobs, and runs without news
_RUN_JOBS = "run_jobs AS (SELECT 'u' || user_id AS run_id, event_id AS n, event_type <> 'error' AS ok, 'e' || event_id AS error FROM events UNION ALL SELECT 'one' || event_id, 1, false, 'only' FROM events WHERE event_id % 50 = 1 UNION ALL SELECT 'none' || event_id, 0, NULL, NULL FROM events WHERE event_id % 50 = 2 UNION ALL SELECT 'two' || event_id, k, k = 1, 'x' FROM events, range(3) t(k) WHERE event_id % 50 = 3 AND k < 2)"
query("run_outcome", f"""WITH {_RUN_JOBS} SELECT run_id, CASE WHEN count(ok) = 0 THEN 'unchanged' WHEN count(*) FILTER (NOT ok) > 0 THEN 'failed' ELSE 'ingested' END AS outcome, count(*) FILTER (ok) AS items,
 CASE WHEN count(*) FILTER (NOT ok) = 0 THEN NULL WHEN count(*) = 1 THEN min(error) ELSE count(*) FILTER (NOT ok) || ' of ' || count(*) || ' jobs failed; first: ' || arg_min(error, n) FILTER (NOT ok) || CASE WHEN count(*) FILTER (NOT ok) > 1 THEN ' (see the jobs for the others)' ELSE '' END END AS error FROM run_jobs GROUP BY 1""")(
    lambda spark, d: (lambda e, row: control.run_outcome(
        row(e, F.concat(F.lit("u"), F.col("user_id").cast("string")), F.col("event_id"), F.col("event_type") != "error", F.concat(F.lit("e"), F.col("event_id").cast("string")))
        .unionByName(row(e.where("event_id % 50 = 1"), F.concat(F.lit("one"), F.col("event_id").cast("string")), F.lit(1), F.lit(False), F.lit("only")))
        .unionByName(row(e.where("event_id % 50 = 2"), F.concat(F.lit("none"), F.col("event_id").cast("string")), F.lit(0), F.lit(None).cast("boolean"), F.lit(None).cast("string")))
        .unionByName(row(e.where("event_id % 50 = 3").withColumn("k", F.explode(F.array(F.lit(0), F.lit(1)))), F.concat(F.lit("two"), F.col("event_id").cast("string")), F.col("k"), F.col("k") == 1, F.lit("x")))
    ))(table(spark, d, "events"), lambda df, run, n, ok, error: df.select(run.alias("run_id"), n.cast("long").alias("n"), ok.alias("ok"), error.alias("error")))
)
_FILES = "files AS (SELECT 'j' || user_id AS job_id, event_id AS n, CASE event_type WHEN 'click' THEN 'succeeded' WHEN 'error' THEN 'failed' ELSE 'skipped' END AS status FROM events UNION ALL SELECT 's' || event_id, 1, 'skipped' FROM events WHERE event_id % 20 = 1 UNION ALL SELECT 'n' || event_id, 0, NULL FROM events WHERE event_id % 20 = 2 UNION ALL SELECT 'o' || event_id, 1, 'succeeded' FROM events WHERE event_id % 20 = 3)"
query("archive_outcome", f"""WITH {_FILES} SELECT job_id, count(*) FILTER (status = 'succeeded') AS succeeded, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'skipped') AS skipped,
 CASE WHEN count(*) FILTER (status = 'failed') > 0 THEN count(*) FILTER (status = 'failed') || ' of ' || count(*) FILTER (status IN ('failed', 'succeeded')) || ' files failed; first: p/' || min(n) FILTER (status = 'failed') || ': e' || min(n) FILTER (status = 'failed')
 WHEN count(*) FILTER (status = 'succeeded') > 0 THEN NULL WHEN count(status) = 0 THEN 'the archive holds no files' ELSE 'none of the archive''s files could be ingested (' || count(status) || ' skipped; see progress.archive.skipped)' END AS error FROM files GROUP BY 1""")(
    lambda spark, d: (lambda e, row: control.archive_outcome(
        row(e, "j", F.col("user_id"), F.when(F.col("event_type") == "click", F.lit("succeeded")).when(F.col("event_type") == "error", F.lit("failed")).otherwise(F.lit("skipped")))
        .unionByName(row(e.where("event_id % 20 = 1"), "s", F.col("event_id"), F.lit("skipped"))).unionByName(row(e.where("event_id % 20 = 2"), "n", F.col("event_id"), F.lit(None).cast("string"))).unionByName(row(e.where("event_id % 20 = 3"), "o", F.col("event_id"), F.lit("succeeded")))
    ))(table(spark, d, "events"), lambda df, kind, of, status: df.select(F.concat(F.lit(kind), of.cast("string")).alias("job_id"), F.col("event_id").alias("n"), F.concat(F.lit("p/"), F.col("event_id").cast("string")).alias("path"), status.alias("status"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("error")))
)
# pipelines: suppliers by uid (nation) and tenant
def _pipelines(spark, d):
    return table(spark, d, "customer").groupBy(F.concat(F.lit("u"), (F.col("c_nationkey") % 9).cast("string")).alias("uid"), F.when(F.col("c_custkey") % 4 != 0, F.concat(F.lit("t"), (F.col("c_custkey") % 4).cast("string"))).alias("tenant_id")).agg(F.count("*").alias("version"))


_PIPES = "pipes AS (SELECT 'u' || (c_nationkey % 9) AS uid, CASE WHEN c_custkey % 4 <> 0 THEN 't' || (c_custkey % 4) END AS tenant_id, count(*) AS version FROM customer GROUP BY 1, 2)"
_LOOKUP = f"WITH {_PIPES} SELECT uid, arg_min_null(tenant_id, tenant_id IS NULL) AS tenant_id, arg_min(version, tenant_id IS NULL) AS version FROM pipes WHERE tenant_id IS NULL OR tenant_id = 't1' GROUP BY 1"
query("by_uid", _LOOKUP)(lambda spark, d: control.shadowed_lookup(_pipelines(spark, d), "t1"))
query("tenant_shadow_lookup", _LOOKUP.replace("'t1'", "'t2'"))(lambda spark, d: control.shadowed_lookup(_pipelines(spark, d), "t2"))
query("visible_all", f"WITH {_PIPES} SELECT * FROM pipes p WHERE tenant_id = 't3' OR (tenant_id IS NULL AND NOT EXISTS (SELECT 1 FROM pipes q WHERE q.uid = p.uid AND q.tenant_id = 't3'))")(lambda spark, d: control.visible(_pipelines(spark, d), "t3"))
query("pipeline_list", f"WITH {_PIPES} SELECT * FROM pipes WHERE tenant_id IS NULL OR tenant_id = 't1'")(lambda spark, d: control.listed(_pipelines(spark, d), "t1"))
query("pipeline_cascade", f"WITH {_PIPES}, s AS (SELECT s_suppkey AS source_id, 't' || (s_suppkey % 5) AS tenant_id, 'u' || (s_nationkey % 3) AS pipeline_uid FROM supplier) SELECT * FROM s WHERE pipeline_uid = 'u1' AND NOT EXISTS (SELECT 1 FROM pipes p WHERE p.uid = 'u1' AND p.tenant_id = s.tenant_id)")(
    lambda spark, d: control.pipeline_cascade(table(spark, d, "supplier").select(F.col("s_suppkey").alias("source_id"), F.concat(F.lit("t"), (F.col("s_suppkey") % 5).cast("string")).alias("tenant_id"), F.concat(F.lit("u"), (F.col("s_nationkey") % 3).cast("string")).alias("pipeline_uid")), _pipelines(spark, d), "u1")
)
query("pipeline_upsert", f"WITH {_PIPES}, n AS (SELECT DISTINCT 'u' || (s_nationkey % 20) AS uid, 't1' AS tenant_id FROM supplier) SELECT n.uid, n.tenant_id, coalesce(p.version, 0) + 1 AS version FROM n LEFT JOIN pipes p ON p.uid = n.uid AND coalesce(p.tenant_id, '') = n.tenant_id UNION ALL SELECT * FROM pipes p WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.uid = p.uid AND n.tenant_id = coalesce(p.tenant_id, ''))")(
    lambda spark, d: control.pipeline_upsert(_pipelines(spark, d), table(spark, d, "supplier").select(F.concat(F.lit("u"), (F.col("s_nationkey") % 20).cast("string")).alias("uid"), F.lit("t1").alias("tenant_id")).distinct())
)
query("connection_used_by", "SELECT DISTINCT 'o' || l_orderkey AS uid FROM lineitem WHERE 'c' || (l_suppkey % 6) = 'c2'")(
    lambda spark, d: control.connection_used_by(table(spark, d, "lineitem").groupBy(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("uid")).agg(F.collect_list(F.struct(F.lit("p").alias("plugin"), F.concat(F.lit("c"), (F.col("l_suppkey") % 6).cast("string")).alias("connection"))).alias("steps")), "c2")
)
query("unknown_plugins", "SELECT DISTINCT 'plug' || (p_partkey % 40) AS plugin FROM part WHERE p_partkey % 40 >= 30")(
    lambda spark, d: (lambda p: control.unknown_plugins(p, p.where("n < 30")))(table(spark, d, "part").select(F.concat(F.lit("plug"), (F.col("p_partkey") % 40).cast("string")).alias("plugin"), (F.col("p_partkey") % 40).alias("n")))
)
query("plugin_upsert", "SELECT p_brand AS name, arg_max(p_type, p_partkey) AS version, max(p_partkey) AS updated_at FROM part GROUP BY 1")(lambda spark, d: usage.deduplicated_last(table(spark, d, "part").select(F.col("p_brand").alias("name"), F.col("p_type").alias("version"), F.col("p_partkey").alias("updated_at")), ["name"], ["updated_at"]))
_PATCH = {"pipeline_uid": (3, "u7"), "location": (5, "loc"), "timezone": (7, "UTC"), "cron": (4, "0 1 * * *")}
query("source_patch", f"""WITH s AS (SELECT c_custkey AS source_id, 'u' || (c_nationkey % 9) AS pipeline_uid, CASE WHEN c_custkey % 4 = 0 THEN 'loc' ELSE c_name END AS location, CASE WHEN c_custkey % 2 = 0 THEN 'UTC' END AS timezone, '0 0 * * *' AS cron, CASE WHEN c_custkey % 11 < 3 THEN 'own' END AS index_name, CASE WHEN c_custkey % 13 < 3 THEN 'key' END AS fetch_auth, false AS paused, 'tag' || c_custkey AS etag, 'day' AS last_modified, 'h' AS hash FROM customer),
 p AS (SELECT c_custkey AS source_id, {", ".join(f"CASE WHEN c_custkey % {n} = 0 THEN '{v}' END AS {c}" for c, (n, v) in _PATCH.items())}, CASE WHEN c_custkey % 11 = 1 THEN 'own' WHEN c_custkey % 11 = 2 THEN 'new' END AS index_name, c_custkey % 11 IN (0, 1, 2) AS set_index, CASE WHEN c_custkey % 13 = 1 THEN 'key' END AS fetch_auth, c_custkey % 13 IN (0, 1) AS set_auth, true AS paused FROM customer WHERE c_custkey % 10 < 9),
 n AS (SELECT s.*, coalesce(p.pipeline_uid, s.pipeline_uid) AS n1, coalesce(p.location, s.location) AS n2, coalesce(p.timezone, s.timezone) AS n3, coalesce(p.cron, s.cron) AS n4, CASE WHEN p.set_index THEN p.index_name ELSE s.index_name END AS n5, CASE WHEN p.set_auth THEN p.fetch_auth ELSE s.fetch_auth END AS n6, coalesce(p.paused, s.paused) AS n7 FROM s LEFT JOIN p USING (source_id)),
 r AS (SELECT *, n1 IS DISTINCT FROM pipeline_uid OR n2 IS DISTINCT FROM location OR n3 IS DISTINCT FROM timezone OR n5 IS DISTINCT FROM index_name OR n6 IS DISTINCT FROM fetch_auth AS f FROM n)
 SELECT source_id, n1 AS pipeline_uid, n2 AS location, n3 AS timezone, n4 AS cron, n5 AS index_name, n6 AS fetch_auth, n7 AS paused, CASE WHEN NOT f THEN etag END AS etag, CASE WHEN NOT f THEN last_modified END AS last_modified, CASE WHEN NOT f THEN hash END AS hash FROM r""")(
    lambda spark, d: (lambda c, key: control.source_patch(
        c.select(key.alias("source_id"), F.concat(F.lit("u"), (F.col("c_nationkey") % 9).cast("string")).alias("pipeline_uid"), F.when(key % 4 == 0, F.lit("loc")).otherwise(F.col("c_name")).alias("location"), F.when(key % 2 == 0, F.lit("UTC")).alias("timezone"), F.lit("0 0 * * *").alias("cron"), F.when(key % 11 < 3, F.lit("own")).alias("index_name"), F.when(key % 13 < 3, F.lit("key")).alias("fetch_auth"), F.lit(False).alias("paused"), F.concat(F.lit("tag"), key.cast("string")).alias("etag"), F.lit("day").alias("last_modified"), F.lit("h").alias("hash")),
        c.where("c_custkey % 10 < 9").select(key.alias("source_id"), *(F.when(key % n == 0, F.lit(v)).alias(x) for x, (n, v) in _PATCH.items()), F.when(key % 11 == 1, F.lit("own")).when(key % 11 == 2, F.lit("new")).alias("index_name"), (key % 11).isin(0, 1, 2).alias("set_index"), F.when(key % 13 == 1, F.lit("key")).alias("fetch_auth"), (key % 13).isin(0, 1).alias("set_auth"), F.lit(True).alias("paused")),
    ))(table(spark, d, "customer"), F.col("c_custkey"))
)
# outbox: events
def _outbox(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"), (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("next_attempt_at"), F.when(F.col("event_type") != "error", F.col("ts") + F.expr("INTERVAL 2 HOURS")).alias("delivered_at"), (F.col("event_id") % 10 == 0).alias("skipped"))


_OUT = "outb AS (SELECT event_id AS id, ts AS created_at, ts + INTERVAL 1 HOUR AS next_attempt_at, CASE WHEN event_type <> 'error' THEN ts + INTERVAL 2 HOURS END AS delivered_at, event_id % 10 = 0 AS skipped FROM events)"
_LATE = "(SELECT max(ts) FROM events)"


def _late(spark, d):
    return F.lit(table(spark, d, "events").agg(F.max("ts")).first()[0]).cast("timestamp_ntz")


query("outbox_claim", f"WITH {_OUT}, c AS (SELECT id FROM outb WHERE delivered_at IS NULL AND next_attempt_at <= {_LATE} ORDER BY created_at, id LIMIT 50) SELECT id, id IN (SELECT id FROM c) AS claimed, CASE WHEN id IN (SELECT id FROM c) THEN {_LATE}::TIMESTAMP + INTERVAL 60 SECONDS ELSE next_attempt_at END AS next_attempt_at FROM outb")(
    lambda spark, d: control.outbox_lease(_outbox(spark, d), _late(spark, d), 50, 60).select("id", "claimed", "next_attempt_at")
)
def _lease_queue(spark: SparkSession, d: str) -> DataFrame:
    """Three workers one after another, and a fourth when the first one's lease has run out."""
    path, now = shared_folder(spark, "leases"), _late(spark, d)
    after = [(0, "a", 30), (20, "b", 60), (20, "c", 60), (40, "d", 60)]
    claims = [control.claim(_outbox(spark, d), path, owner, now + F.expr(f"INTERVAL {at} SECONDS"), 100, secs) for at, owner, secs in after]
    return reduce(DataFrame.unionAll, claims).select(F.col("id").cast("long").alias("id"), "owner")


query(
    "lease_queue",
    f"""WITH {_OUT}, k AS (SELECT id, row_number() OVER (ORDER BY created_at, id) - 1 AS k FROM outb WHERE delivered_at IS NULL AND next_attempt_at <= {_LATE})
 SELECT id, (['a', 'b', 'c'])[k // 100 + 1] AS owner FROM k WHERE k < 300 UNION ALL SELECT id, 'd' FROM k WHERE k < 100""",
)(_lease_queue)
query("outbox_stats", f"WITH {_OUT} SELECT count(*) AS pending, (epoch({_LATE}::TIMESTAMP)::BIGINT - floor(epoch(min(created_at)))::BIGINT) AS oldest_secs FROM outb WHERE delivered_at IS NULL")(lambda spark, d: control.outbox_stats(_outbox(spark, d), _late(spark, d)))
query("outbox_drop", f"WITH {_OUT} SELECT id FROM outb WHERE NOT ((skipped AND created_at < {_LATE} - INTERVAL 24 HOURS) OR (delivered_at IS NULL AND created_at < {_LATE} - INTERVAL 7 DAYS) OR coalesce(delivered_at < {_LATE} - INTERVAL 7 DAYS, false))")(lambda spark, d: control.outbox_drop(_outbox(spark, d), _late(spark, d)).select("id"))
query("outbox_insert", "SELECT event_id AS id, event_type AS payload FROM events WHERE event_id % 3 = 0 UNION ALL SELECT id, arg_min(payload, seq) FROM (SELECT event_id // 2 AS id, event_type AS payload, event_id AS seq FROM events) WHERE id NOT IN (SELECT event_id FROM events WHERE event_id % 3 = 0) GROUP BY 1")(
    lambda spark, d: control.outbox_insert(table(spark, d, "events").where("event_id % 3 = 0").select(F.col("event_id").alias("id"), F.col("event_type").alias("payload")), table(spark, d, "events").select(F.floor(F.col("event_id") / 2).alias("id"), F.col("event_type").alias("payload"), F.col("event_id").alias("seq")))
)


# the index: turns of conversations as chunks
def _chunks(spark, d, run: bool):
    c = table(spark, d, "conversations")
    total = c.groupBy("conv_id").agg(F.count("*").alias("chunk_total"))
    rows = c.join(total, "conv_id").select(F.concat_ws("_", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), F.col("conv_id").cast("string").alias("parent_id"), "chunk_total", "role", "turn", "conv_id")
    if not run:
        return rows.select("id", "parent_id", "role")
    return rows.where("conv_id % 2 = 0 and not (conv_id % 4 = 0 and turn = 0)").select("id", "parent_id", (F.col("chunk_total") - F.when(F.col("conv_id") % 8 == 0, 1).otherwise(0)).alias("chunk_total"))


_CHUNKS = """stored AS (SELECT conv_id || '_' || turn AS id, conv_id::VARCHAR AS parent_id, role FROM conversations), run AS (SELECT conv_id || '_' || turn AS id, conv_id::VARCHAR AS parent_id, count(*) OVER (PARTITION BY conv_id) - CASE WHEN conv_id % 8 = 0 THEN 1 ELSE 0 END AS chunk_total, turn, conv_id FROM conversations),
 cut AS (SELECT * FROM run WHERE conv_id % 2 = 0 AND NOT (conv_id % 4 = 0 AND turn = 0)), ok AS (SELECT parent_id FROM cut GROUP BY 1 HAVING min(chunk_total) = max(chunk_total) AND count(DISTINCT id) = max(chunk_total))"""
query("complete_children", f"WITH {_CHUNKS} SELECT parent_id FROM ok")(lambda spark, d: sink.complete_parents(_chunks(spark, d, True)))
query("prune", f"WITH {_CHUNKS} SELECT * FROM stored WHERE parent_id IN (SELECT parent_id FROM ok) AND id NOT IN (SELECT id FROM cut)")(lambda spark, d: sink.prune(_chunks(spark, d, False), _chunks(spark, d, True)).select("id", "parent_id", "role"))
def _index(spark: SparkSession, d: str) -> DataFrame:
    """Old rows of all users, then new ones of every other, through the sink's step into an index of its own."""
    path = shared_folder(spark, "index")
    e = table(spark, d, "events")
    old = e.select(F.col("user_id").cast("string").alias("id"), F.lit("old").alias("content")).distinct()
    new = e.where("user_id % 2 = 0").select(F.col("user_id").cast("string").alias("id"), F.col("event_type").alias("content"), F.col("event_id").alias("chunk_index"))
    for rows in (old, new):
        OPERATORS["index_sink"](rows, {"path": path})
    return read_index(spark, path).select("id", F.col("content").alias("v"))


query("index_sink", "SELECT user_id::VARCHAR AS id, arg_max(event_type, event_id) AS v FROM events WHERE user_id % 2 = 0 GROUP BY 1 UNION ALL SELECT DISTINCT user_id::VARCHAR, 'old' FROM events WHERE user_id % 2 = 1")(_index)
_INDEX_JSON = """SELECT doc_id, '{"id":"' || doc_id || '","content":' || to_json(text)::VARCHAR || ',"source":' || to_json(source)::VARCHAR || ',"_meta":{"language":' || to_json(lang)::VARCHAR || '}}' AS j FROM documents"""
query("to_index_json", _INDEX_JSON)(
    lambda spark, d: table(spark, d, "documents").select("doc_id", sink.index_json(F.col("doc_id").cast("string"), F.lit(None).cast("string"), F.col("text"), {"source": F.col("source")}, F.struct(F.col("lang").alias("language"))).alias("j"))
)
# the same rows under the name of the test against json.dumps
query("to_index_json_whole", _INDEX_JSON)(
    lambda spark, d: table(spark, d, "documents").select("doc_id", sink.index_json(F.col("doc_id").cast("string"), F.lit(None).cast("string"), F.col("text"), {"source": F.col("source")}, F.struct(F.col("lang").alias("language"))).alias("j"))
)
query("plan_batches", """WITH RECURSIVE s AS (SELECT source AS part, doc_id AS seq, strlen(text) AS size, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents),
 r AS (SELECT part, seq, size, k, 0::BIGINT AS batch, 1 AS n, size + 2 AS b FROM s WHERE k = 1 UNION ALL SELECT s.part, s.seq, s.size, s.k, CASE WHEN n = 20 OR b + s.size + 1 > 200000 THEN batch + 1 ELSE batch END, CASE WHEN n = 20 OR b + s.size + 1 > 200000 THEN 1 ELSE n + 1 END, CASE WHEN n = 20 OR b + s.size + 1 > 200000 THEN s.size + 2 ELSE b + s.size + 1 END FROM r JOIN s ON s.part = r.part AND s.k = r.k + 1)
 SELECT part, seq, size, batch FROM r""")(lambda spark, d: sink.plan_batches(table(spark, d, "documents").select(F.col("source").alias("part"), F.col("doc_id").alias("seq"), F.octet_length("text").cast("long").alias("size")), 20, 200_000))


def _parsed(spark: SparkSession, d: str, name: str, config: dict) -> DataFrame:
    """A table's files as documents, by a scan that no file is too large for; the operator takes files up to its limits."""
    return parquet_scan.documents(spark, f"{d}/{name}.parquet", **config)


query("parquet_parse", """SELECT 'customer_r' || c_custkey AS id, '{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '","c_nationkey":' || c_nationkey || '}' AS fields FROM customer""")(
    lambda spark, d: _parsed(spark, d, "customer", {"columns": ["c_custkey", "c_name", "c_nationkey"]}).select(F.concat(F.lit("customer_r"), F.get_json_object("fields", "$.c_custkey")).alias("id"), "fields")
)
# the same by Spark's own scan, with ids by place in the file
query(
    "parquet_scan",
    """SELECT 'customer_r' || (c_custkey + 1) AS id, c_name AS title, c_mktsegment AS content, '{"c_custkey":' || c_custkey || ',"c_nationkey":' || c_nationkey || '}' AS fields FROM customer""",
)(lambda spark, d: parquet_scan.scan(spark, f"{d}/customer.parquet", columns=["c_custkey", "c_name", "c_nationkey", "c_mktsegment"], title_field="c_name", content_fields=("c_mktsegment",)))
# parquet_parse numbers rows by key, as its SQL does. All columns, and the operator's own ids: numbers have no common text form with DuckDB, so no SQL
query("parquet_parse_all")(lambda spark, d: _parsed(spark, d, "customer", {}))
query("incremental_skip", "SELECT doc_id AS source_id, sha256(text) AS hash FROM documents WHERE doc_id % 3 <> 0 OR doc_id % 2 <> 0")(
    lambda spark, d: (lambda t: url.changed(t, t.select("source_id", F.when(F.col("source_id") % 6 == 0, F.sha2("content", 256)).otherwise(F.lit("older")).alias("hash")), lambda c: F.sha2(c, 256)).select("source_id", "hash"))(table(spark, d, "documents").select(F.col("doc_id").alias("source_id"), F.col("text").alias("content")))
)


def _decoded(n: int, kind: str) -> dict:
    """An object of n % 5 keys of three letters, each with the event's kind; n % 7 of them are a file, within limits or not."""
    record = {f"k{k:02}": kind for k in range(n % 5)}
    size, ok = json_records.decoded_size(record), True
    try:
        json_records.check_limits([record], most_bytes=170)
        json_records.check_limits([None] * (n % 7), most_rows=5)
    except json_records.InvalidInput:
        ok = False
    return {"size": size, "ok": ok}


query("decode_limits", "SELECT event_id, 32 * (event_id % 5 + 1) + (event_id % 5) * (3 + length(event_type)) AS size, 32 * (event_id % 5 + 1) + (event_id % 5) * (3 + length(event_type)) <= 170 AND event_id % 7 <= 5 AS ok FROM events")(
    lambda spark, d: table(spark, d, "events").select("event_id", F.udf(_decoded, "size long, ok boolean", useArrow=True)("event_id", "event_type").alias("r")).select("event_id", "r.size", "r.ok")
)
query("state_for", "SELECT doc_id, left(CASE WHEN doc_id % 3 = 0 THEN '' ELSE source || chr(10) || chr(10) END || text, 48000) AS state FROM documents")(
    lambda spark, d: (lambda t: t.select("doc_id", enrich.state_for(t).alias("state")))(table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.lit(" ")).otherwise(F.col("source")).alias("title"), F.col("text").alias("content")))
)
query("approx_size", "SELECT doc_id, (strlen(doc_id::VARCHAR) + strlen(source) + strlen(text) + strlen('{\"lang\":\"' || lang || '\"}') + 256)::BIGINT AS size, (strlen(text) * 4 // 3)::BIGINT AS raw FROM documents")(
    lambda spark, d: (lambda t: t.select(F.col("id").cast("long").alias("doc_id"), usage.approx_size(t).alias("size"), usage.blob_size(F.col("content").cast("binary")).alias("raw")))(table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("title"), F.col("text").alias("content"), F.to_json(F.struct("lang")).alias("fields")))
)