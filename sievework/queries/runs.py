"""Queries of whole runs: pipelines over many jobs with their step results, branches and usage events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import usage
from ..plans.catalog import MANIFESTS, STEPS
from ..plans.pipeline import Pipeline
from ..plans.run import Ran, execute
from .base import query, table

_JOB = "floor((c_custkey - 1) / 50)"


def _customers(spark: SparkSession, d: str) -> DataFrame:
    """Fifty customers a CSV file, a file a job; every seventh file calls its key otherwise."""
    c = table(spark, d, "customer").withColumn("job_id", F.expr(_JOB))
    line = F.concat_ws(",", F.col("c_custkey").cast("string"), "c_mktsegment", F.col("c_nationkey").cast("string"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", line.alias("line")))), lambda x: x["line"]), "\n")
    head = F.when(F.col("job_id") % 7 == 3, F.lit("key,segment,nation\n")).otherwise(F.lit("id,segment,nation\n"))
    files = c.groupBy("job_id").agg(lines.alias("lines"))
    none = F.lit(None).cast("string")
    return files.select("job_id", F.concat(head, "lines", F.lit("\n")).cast("binary").alias("data"), none.alias("mime"), F.concat(F.lit("c"), F.col("job_id").cast("string"), F.lit(".csv")).alias("filename"), none.alias("origin"), none.alias("charset"))


def _csv_run(spark: SparkSession, d: str) -> Ran:
    steps = [
        {"id": "parse", "plugin": "csv_parser", "config": {"id_column": "id", "content_columns": ["segment"]}},
        {"id": "keep", "plugin": "document_script", "config": {"keep": "content <> 'MACHINERY'"}},
        {"id": "index", "plugin": "index_sink"},
    ]
    return execute(Pipeline.parse({"uid": "csv", "steps": steps}), _customers(spark, d), STEPS, MANIFESTS)


_ROWS = f"""rows AS (SELECT ({_JOB})::BIGINT AS job_id, row_number() OVER (PARTITION BY {_JOB} ORDER BY c_custkey) AS n, c_custkey || ',' || c_mktsegment || ',' || c_nationkey AS line, c_mktsegment AS segment,
  strlen(c_custkey::VARCHAR) + strlen(c_mktsegment) + 256 AS bare, c_custkey, c_nationkey FROM customer),
 docs AS (SELECT *, bare + strlen('{{"_row":' || n || ',"id":' || c_custkey || ',"nation":' || c_nationkey || ',"segment":"' || segment || '"}}') AS size FROM rows),
 jobs AS (SELECT job_id, job_id % 7 = 3 AS bad, sum(strlen(line) + 1) + CASE WHEN job_id % 7 = 3 THEN 19 ELSE 18 END AS bytes, count(*) AS n, count(*) FILTER (segment <> 'MACHINERY') AS kept, sum(size) AS size, sum(size) FILTER (segment <> 'MACHINERY') AS kept_size FROM docs GROUP BY 1),
 steps AS (SELECT job_id, 1 AS step_no, 'parse' AS step_id, 'csv_parser' AS plugin, bad, CASE WHEN bad THEN 0 ELSE n END AS documents_out, CASE WHEN bad THEN 0 ELSE bytes * 4 // 3 END AS input_bytes FROM jobs
  UNION ALL SELECT job_id, 1001, 'keep', 'document_script', false, kept, size FROM jobs WHERE NOT bad UNION ALL SELECT job_id, 2001, 'index', 'index_sink', false, kept, coalesce(kept_size, 0) FROM jobs WHERE NOT bad)"""
_UNKNOWN = "invalid config: csv_parser: id_column names an unknown column ''id'' (available: key, segment, nation)"

query(
    "run_results",
    f"WITH {_ROWS} SELECT job_id::VARCHAR AS job_id, step_no, step_id, plugin, CASE WHEN bad THEN 'failed' ELSE 'succeeded' END AS status, 1 AS branches, input_bytes::BIGINT AS input_bytes, documents_out::BIGINT AS documents_out, CASE WHEN bad THEN '{_UNKNOWN}' END AS error FROM steps",
)(lambda spark, d: _csv_run(spark, d).results().select("job_id", "step_no", "step_id", "plugin", "status", "branches", "input_bytes", "documents_out", "error"))


def _events(spark: SparkSession, d: str) -> DataFrame:
    """What a run left, as usage events."""
    ran = _csv_run(spark, d)
    at = F.expr("TIMESTAMP_NTZ '2024-05-01 00:00:00'")
    text = {c: F.lit(c) for c in ("workflow_id", "project_id", "region", "pipeline_uid", "index_name", "task_queue", "input_mime")}
    jobs = ran.jobs().select("job_id", "status", "error", *(v.alias(c) for c, v in text.items()), F.lit(0).alias("pipeline_builtin"), F.lit(0).cast("long").alias("input_bytes"), at.alias("started_at"), at.alias("finished_at"))
    return usage.events_for_jobs(ran.results(), jobs).select("event_id", "kind", "plugin", "status", "documents_out", "error_kind", "error")


query(
    "run_events",
    f"""WITH {_ROWS} SELECT job_id || ':' || step_id || ':1' AS event_id, 'step' AS kind, plugin, CASE WHEN bad THEN 'failed' ELSE 'succeeded' END AS status, documents_out::BIGINT AS documents_out, CASE WHEN bad THEN 'invalid_config' ELSE '' END AS error_kind, CASE WHEN bad THEN '{_UNKNOWN}' ELSE '' END AS error FROM steps
 UNION ALL SELECT job_id || ':job', 'job', '', CASE WHEN bad THEN 'failed' ELSE 'succeeded' END, CASE WHEN bad THEN 0 ELSE kept END, CASE WHEN bad THEN 'invalid_config' ELSE '' END, CASE WHEN bad THEN 'step parse (csv_parser) failed: {_UNKNOWN}' ELSE '' END FROM jobs""",
)(_events)


def _branches(spark: SparkSession, d: str) -> DataFrame:
    """Documents of a source as one job, fanned out; a document that the script cannot handle fails its branch."""
    n = F.col("doc_id")
    docs = table(spark, d, "documents").select("doc_id", F.col("source").alias("job_id"), n.cast("string").alias("id"), F.lit(None).cast("string").alias("title"), F.when(n % 211 == 5, F.lit("bad")).otherwise(F.lit("good")).alias("content"), F.lit("{}").alias("fields"))
    steps = [
        {"id": "in", "plugin": "document_script", "config": {"set": {"title": "upper(content)"}}},
        {"id": "check", "plugin": "document_script", "fan_out": "$.documents", "config": {"set": {"title": "concat(title, '!')"}, "valid": "content <> 'bad'"}},
    ]
    ran = execute(Pipeline.parse({"uid": "fan", "steps": steps}), docs, STEPS, MANIFESTS, order="doc_id")
    return ran.outcomes().where("step_id = 'check'").select("job_id", "status", "branches", "documents", "message")


query(
    "run_branches",
    """WITH d AS (SELECT source, doc_id, doc_id % 211 = 5 AS bad, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS k, count(*) OVER (PARTITION BY source) AS n FROM documents),
 b AS (SELECT source, floor(k / ceil(n / 500)) AS branch, bool_or(bad) AS bad, count(*) FILTER (NOT bad) AS docs FROM d GROUP BY 1, 2)
 SELECT source AS job_id, CASE WHEN bool_or(bad) THEN 'failed' ELSE 'succeeded' END AS status, count(*)::INT AS branches, coalesce(sum(docs) FILTER (NOT bad), 0)::BIGINT AS documents,
  CASE WHEN bool_or(bad) THEN count(*) FILTER (bad) || ' of ' || count(*) || ' branches failed; first error: invalid input: the script failed for a document' END AS message FROM b GROUP BY source""",
)(_branches)
