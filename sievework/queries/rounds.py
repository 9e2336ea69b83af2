"""Queries of rounds, archive waves, schedules, sources, scripts and what the sinks send."""

from __future__ import annotations

import gzip
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rounds, sink, usage
from ..plans.catalog import OPERATORS
from ..sources import fetch, schedule
from .base import USAGE_SQL, query, shared_folder, sql_text, table, usage_events


# rounds: ten events are the steps of a job, three a round
def _results(spark: SparkSession, d: str) -> DataFrame:
    e, n = F.col("event_id"), F.col("event_id") % 10
    status = F.when((e * 5) % 7 == 0, "failed").when((e * 5) % 7 == 1, "cancelled").otherwise("succeeded")
    return table(spark, d, "events").select(F.floor(e / 10).alias("job_id"), F.floor(n / 3).alias("round"), n.alias("n"), F.concat(F.lit("s"), n.cast("string")).alias("step_id"), F.col("event_type").alias("plugin"), status.alias("status"), (e % 100).alias("documents"), F.concat(F.lit("m"), e.cast("string")).alias("message"), (e % 2 == 0).alias("metered"))


_RESULTS = """res AS (SELECT event_id // 10 AS job_id, event_id % 10 // 3 AS round, event_id % 10 AS n, 's' || (event_id % 10) AS step_id, event_type AS plugin, CASE event_id * 5 % 7 WHEN 0 THEN 'failed' WHEN 1 THEN 'cancelled' ELSE 'succeeded' END AS status, event_id % 100 AS documents, 'm' || event_id AS message, event_id % 2 = 0 AS metered FROM events)"""
query("settle_round", f"""WITH {_RESULTS} SELECT job_id, round, row_number() OVER (PARTITION BY job_id, round ORDER BY CASE WHEN status = 'succeeded' THEN 0 ELSE 1 END, n) AS place, step_id, plugin, status, CASE WHEN status = 'succeeded' THEN documents ELSE 0 END AS documents, CASE WHEN status = 'failed' THEN message END AS error FROM res WHERE status <> 'cancelled' OR metered""")(
    lambda spark, d: rounds.settled(_results(spark, d))
)
query("round_end", f"""WITH {_RESULTS}, stop AS (SELECT job_id, round, min(n) AS n FROM res WHERE status <> 'succeeded' GROUP BY 1, 2), every AS (SELECT DISTINCT job_id, round FROM res)
 SELECT e.job_id, e.round, r.status AS outcome, CASE WHEN r.status = 'failed' THEN 'step ' || r.step_id || ' (' || r.plugin || ') failed: ' || r.message END AS error FROM every e LEFT JOIN stop s ON e.job_id = s.job_id AND e.round = s.round LEFT JOIN res r ON r.job_id = s.job_id AND r.round = s.round AND r.n = s.n""")(
    lambda spark, d: rounds.round_ends(_results(spark, d))
)


# archives: the documents of a source are the files of one
def _archive(spark: SparkSession, d: str) -> DataFrame:
    status = F.when((F.col("event_id") % 11) == 0, "failed").when((F.col("event_id") % 11) == 1, "skipped").otherwise("succeeded")
    return table(spark, d, "events").select(F.col("event_id").alias("e"), (F.col("event_id") % 3).alias("job_id"), F.floor(F.col("event_id") / 3).alias("n"), F.concat(F.lit("f/"), F.col("event_id").cast("string")).alias("path"), status.alias("status"), F.col("event_type").alias("error"))


_ARCHIVE = "arc AS (SELECT event_id % 3 AS job_id, event_id // 3 AS n, 'f/' || event_id AS path, CASE event_id % 11 WHEN 0 THEN 'failed' WHEN 1 THEN 'skipped' ELSE 'succeeded' END AS status, event_type AS error FROM events)"
query("archive_waves", f"WITH {_ARCHIVE} SELECT job_id, n // 50 AS wave, min(n) AS first, max(n) AS last, count(*) FILTER (status <> 'skipped') AS started, count(*) FILTER (status = 'succeeded') AS succeeded, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'skipped') AS skipped, n // 50 // 10 AS run FROM arc GROUP BY ALL")(
    lambda spark, d: rounds.waves(_archive(spark, d))
)
query("archive_issues", f"WITH {_ARCHIVE}, k AS (SELECT *, row_number() OVER (PARTITION BY job_id, status ORDER BY n) AS k FROM arc WHERE status <> 'succeeded') SELECT job_id, status, n, path, error AS reason FROM k WHERE k <= 50")(
    lambda spark, d: rounds.issues(_archive(spark, d))
)

# fan-out of a table as one group
query("fan_out_whole", "SELECT event_id, floor((row_number() OVER (ORDER BY event_id) - 1) / ceil(count(*) OVER () / 500))::BIGINT AS branch FROM events")(lambda spark, d: usage.fan_out(table(spark, d, "events").select("event_id"), ["event_id"]))


# what a service's sink sends: order lines as children of their orders
def _lines(spark: SparkSession, d: str) -> DataFrame:
    order, line = F.col("l_orderkey"), F.col("l_linenumber")
    name = F.when(order % 13 == 0, F.concat(F.lit("a\\\\"), order.cast("string"))).when(order % 5 == 0, F.concat(F.lit('q"'), order.cast("string"))).otherwise(order.cast("string"))
    return table(spark, d, "lineitem").select((order % 4).alias("part"), (order * 10 + line).alias("seq"), name.alias("parent_id"), F.concat_ws("_", order.cast("string"), line.cast("string")).alias("id"))


query("prune_filters", r"""WITH RECURSIVE p AS (SELECT l_orderkey % 4 AS part, l_orderkey AS o, '"' || CASE WHEN l_orderkey % 5 = 0 THEN 'q\"' ELSE '' END || l_orderkey || '"' AS p, count(*) AS c, string_agg('"' || l_orderkey || '_' || l_linenumber || '"', ', ' ORDER BY l_linenumber) AS ids FROM lineitem WHERE l_orderkey % 13 <> 0 GROUP BY ALL),
 k AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY o) AS k FROM p),
 g AS (SELECT part, k, c, p, ids, 0 AS n FROM k WHERE k = 1 UNION ALL SELECT k.part, k.k, CASE WHEN g.c + k.c > 1000 THEN k.c ELSE g.c + k.c END, k.p, k.ids, CASE WHEN g.c + k.c > 1000 THEN n + 1 ELSE n END FROM g JOIN k ON k.part = g.part AND k.k = g.k + 1)
 SELECT part, n, '_meta.parent_id IN [' || string_agg(p, ', ' ORDER BY k) || '] AND NOT id IN [' || string_agg(ids, ', ' ORDER BY k) || ']' AS filter FROM g GROUP BY part, n""")(
    lambda spark, d: sink.prune_filters(_lines(spark, d))
)


def _sent(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    plan = table(spark, d, "events").select(e.alias("e"), F.floor(e / 10).alias("step"), (e % 10).alias("batch"), (e % 10 * 10).alias("start"), (e % 10 * 10 + 10).alias("end"), F.lit("here").alias("destination"), F.lit("docs").alias("documents"))
    last = plan.where("e % 17 > 0").select("step", "batch", "start", "end", F.when(F.col("e") % 17 == 1, F.lit("elsewhere")).otherwise(F.col("destination")).alias("destination"), F.when(F.col("e") % 17 == 2, F.lit("others")).otherwise(F.col("documents")).alias("documents"), F.col("e").alias("task"), F.col("batch").alias("enqueued_ms"))
    tasks = plan.where("e % 23 > 0").select(F.col("e").alias("task"), "destination", (F.col("batch") + F.when(F.col("e") % 29 == 0, 1).otherwise(0)).alias("enqueued_ms"))
    return sink.confirmed(plan.drop("e"), last, tasks)


query("resume_batches", """WITH p AS (SELECT event_id // 10 AS step, event_id % 10 AS batch, event_id AS task, event_id % 17 > 2 AND event_id % 23 > 0 AND event_id % 29 > 0 AS ok FROM events), f AS (SELECT step, min(batch) FILTER (NOT ok) AS first FROM p GROUP BY 1)
 SELECT step, batch, task FROM p JOIN f USING (step) WHERE first IS NULL OR batch < first""")(_sent)


def _usage_table(spark: SparkSession, d: str) -> DataFrame:
    """Events of an older release, then those of one that has a column more, then some of them again."""
    path, e = shared_folder(spark, "usage"), usage_events(spark, d)
    now = e.where("kind <> 'step'").withColumn("region", F.lit("eu"))
    for part in (e.where("kind = 'step'"), now, now):
        usage.write_usage(part, path)
    return usage.dedup(usage.read_usage(spark, path)).select("project_id", "ts", "event_id", "kind", "region")


query("usage_sink", f"WITH {USAGE_SQL} SELECT DISTINCT project_id, ts, event_id, kind, CASE WHEN kind <> 'step' THEN 'eu' END AS region FROM events_u")(_usage_table)

# schedules: customers as sources
_CRONS = ["30 0 * * *", "0 */6 * * *", "15 12 1 * *", "0 9-17/4 * * 1-5", "5,35 3 * JAN,feb 0"]
_SINCE, _UNTIL = datetime(2024, 1, 31, 0, 30), datetime(2024, 2, 6, 12, 0)


def _due(spark: SparkSession, d: str) -> DataFrame:
    c, key = table(spark, d, "customer"), F.col("c_custkey")
    sources = c.select(key.alias("source_id"), F.get(F.array(*map(F.lit, _CRONS)), (key % len(_CRONS)).cast("int")).alias("cron"), F.when(key % 2 == 0, "Asia/Tokyo").otherwise("UTC").alias("timezone"), (key % 9 == 0).alias("paused"))
    start = F.lit("2024-02-01 23:00:00").cast("timestamp_ntz")
    runs = c.where("c_custkey % 4 = 0").select(key.alias("source_id"), start.alias("started_at"), F.when(key % 8 == 0, start + F.expr("INTERVAL 20 HOURS")).alias("finished_at"))
    return schedule.due(sources, runs, _SINCE, _UNTIL)


query("cron_source", f"""WITH t AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-30', TIMESTAMP '2024-02-08', INTERVAL 5 MINUTES)) AS l),
 h AS (SELECT l, hour(l) AS h, minute(l) AS m, dayofweek(l) AS w FROM t),
 f AS (SELECT 0 AS k, l FROM h WHERE m = 30 AND h = 0 UNION ALL SELECT 1, l FROM h WHERE m = 0 AND h % 6 = 0 UNION ALL SELECT 2, l FROM h WHERE m = 15 AND h = 12 AND day(l) = 1 UNION ALL SELECT 3, l FROM h WHERE m = 0 AND h IN (9, 13, 17) AND w BETWEEN 1 AND 5 UNION ALL SELECT 4, l FROM h WHERE m IN (5, 35) AND h = 3 AND month(l) IN (1, 2) AND w = 0),
 s AS (SELECT c_custkey AS source_id, f.l - CASE WHEN c_custkey % 2 = 0 THEN INTERVAL 9 HOURS ELSE INTERVAL 0 HOURS END AS scheduled_at FROM customer JOIN f ON f.k = c_custkey % 5 WHERE c_custkey % 9 <> 0)
 SELECT source_id, scheduled_at FROM s WHERE scheduled_at > TIMESTAMP '{_SINCE}' AND scheduled_at <= TIMESTAMP '{_UNTIL}' AND NOT (source_id % 4 = 0 AND scheduled_at > TIMESTAMP '2024-02-01 23:00:00' AND (source_id % 8 <> 0 OR scheduled_at < TIMESTAMP '2024-02-02 19:00:00'))""")(_due)


def _server(method: str, url: str, headers: dict):
    """A stand-in for the network: what a URL answers follows from its last number."""
    host, name = url.split("/")[2], url.rsplit("/", 1)[-1]
    n = int("".join(c for c in name.split(".")[0] if c.isdigit()))
    if host == "old.example.org":
        return 302, {"location": f"https://files.example.org/{name}" if n % 12 == 5 else "http://127.0.0.1/x1"}, []
    if n % 12 in (3, 4):
        return (404, {}, []) if n % 12 == 3 else (503, {}, [])
    if headers.get("if-none-match") == f"v{n}":
        return 304, {}, []
    body = f"body {n} {'key' if headers.get('authorization') else 'open'}".encode()
    return 200, {"content-type": "Text/Plain; charset=UTF-8", "etag": f"v{n}"}, [gzip.compress(body, mtime=0)] if name.endswith(".gz") else [body[:3], body[3:]]


def _fetched(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("c_custkey")
    kind = key % 12
    host = F.when(kind.isin(5, 6), F.lit("old.example.org")).otherwise(F.lit("files.example.org"))
    url = F.when(kind == 7, F.lit("https://files.example.org/{{ bad }}1")).otherwise(F.concat(F.lit("https://"), host, F.lit("/f"), key.cast("string"), F.when(kind == 8, F.lit(".gz")).otherwise(F.lit(".txt"))))
    sources = table(spark, d, "customer").select(key.alias("source_id"), url.alias("url"), F.create_map(F.lit("authorization"), F.lit("Bearer x")).alias("credentials"), F.when(kind == 1, F.concat(F.lit("v"), key.cast("string"))).alias("etag"))
    got = fetch.resolve(sources, _server, datetime(2024, 2, 1), ["*.example.org"])
    return got.select(F.col("source_id").cast("long").alias("source_id"), "outcome", "transient", F.decode("data", "UTF-8").alias("text"), "mime", "filename", "charset", "etag")


query("url_source", """WITH c AS (SELECT c_custkey AS k, c_custkey % 12 AS m FROM customer), o AS (SELECT *, CASE WHEN m = 1 THEN 'unchanged' WHEN m IN (3, 4, 6, 7) THEN 'failed' ELSE 'items' END AS outcome FROM c)
 SELECT k AS source_id, outcome, CASE WHEN outcome = 'failed' THEN m = 4 END AS transient, CASE WHEN outcome = 'items' THEN 'body ' || k || CASE WHEN m = 5 THEN ' open' ELSE ' key' END END AS text, CASE WHEN outcome = 'items' THEN 'text/plain' END AS mime,
 CASE WHEN outcome = 'items' THEN 'f' || k || CASE WHEN m = 8 THEN '' ELSE '.txt' END END AS filename, CASE WHEN outcome = 'items' THEN 'UTF-8' END AS charset, CASE WHEN outcome = 'items' THEN 'v' || k END AS etag FROM o""")(_fetched)

# scripts as a pipeline's step
query("document_script", f"SELECT doc_id AS n, 'id_' || doc_id AS id, upper(lang) || {sql_text(': ')} || source AS title, text AS content, n_chars * 2 AS twice FROM documents WHERE lang <> 'de'")(
    lambda spark, d: OPERATORS["document_script"](
        table(spark, d, "documents").select(F.col("doc_id").alias("n"), F.concat(F.lit("id "), F.col("doc_id").cast("string")).alias("id"), F.col("source").alias("title"), F.col("text").alias("content"), "lang", "n_chars"),
        {"set": {"id": "id", "title": "concat(upper(lang), ': ', title)", "twice": "n_chars * 2"}, "keep": "lang <> 'de'", "drop": ["lang", "n_chars"]},
    )
)
query("script_limits", "SELECT doc_id, CASE WHEN strlen(text) + 5999 * (len(text) - len(replace(text, 'e', ''))) <= strlen(text) + 524288 THEN strlen(text) + 5999 * (len(text) - len(replace(text, 'e', ''))) ELSE strlen(text) END AS n FROM documents")(
    lambda spark, d: OPERATORS["document_script"](
        table(spark, d, "documents").select("doc_id", F.col("text").alias("content")),
        {"set": {"content": f"replace(content, 'e', '{'y' * 6000}')"}, "on_error": "keep"},
    ).select("doc_id", F.octet_length("content").alias("n"))
)
