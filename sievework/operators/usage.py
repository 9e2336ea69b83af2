"""Usage metering: events of steps and jobs, deduplication, daily rollups, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import errors
from .tables import numbered

# The plugins that pay a provider.
PRICED_PLUGINS = ["llm_enricher", "jev_enricher", "image_captioner", "whisper_transcriber"]
KEYS = ["project_id", "day", "pipeline_uid", "plugin"]
# Counters summed over step rows, so that a job's totals do not count twice.
STEP_SUMS = ["documents_out", "input_bytes", "duration_ms", "llm_input_tokens", "llm_output_tokens", "llm_requests", "audio_seconds", "pages", "images", "external_requests"]
# The columns of an event, in order.
EVENT_COLUMNS = ["event_id", "kind", "ts", "job_id", "workflow_id", "project_id", "region", "pipeline_uid", "pipeline_builtin", "index_name", "step_id", "plugin", "task_queue", "status", "attempt", "branches", "duration_ms",
    "input_bytes", "input_mime", "documents_out", "llm_input_tokens", "llm_output_tokens", "llm_requests", "audio_seconds", "pages", "images", "external_requests", "error_kind", "error"]


def dedup(events: DataFrame, order: str = "seq") -> DataFrame:
    """One row for each (project_id, ts, event_id): the one that came in last, where `order` tells; else deliveries are alike."""
    keys = ["project_id", "ts", "event_id"]
    if order not in events.columns:
        return events.dropDuplicates(keys)
    return deduplicated_last(events, keys, [order]).drop(order)


def _measures() -> list[Column]:
    step, job = F.col("kind") == "step", F.col("kind") == "job"
    zero = lambda c: F.coalesce(c, F.lit(0))
    return [
        F.count_if(step).alias("steps"),
        F.count_if(job).alias("jobs"),
        F.count_if(job & (F.col("status") == "succeeded")).alias("jobs_succeeded"),
        F.count_if(job & (F.col("status") == "failed")).alias("jobs_failed"),
        zero(F.sum(F.when(job, F.col("documents_out")))).alias("documents_indexed"),
        *(zero(F.sum(F.when(step, F.col(c)))).alias(c) for c in STEP_SUMS),
    ]


MEASURES = ["steps", "jobs", "jobs_succeeded", "jobs_failed", "documents_indexed", *STEP_SUMS]


def daily(events: DataFrame) -> DataFrame:
    """One row for each project, UTC day, pipeline and plugin."""
    return events.withColumn("day", F.to_date("ts")).groupBy(*KEYS).agg(F.count("*").alias("rows_count"), *_measures())


def partials(events: DataFrame, part: Column) -> DataFrame:
    """Daily states of each part of the events; merge() adds them up."""
    return events.withColumns({"day": F.to_date("ts"), "part": part}).groupBy("part", *KEYS).agg(F.count("*").alias("rows_count"), *_measures())


def merge(states: DataFrame) -> DataFrame:
    return states.groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in ["rows_count", *MEASURES]))


def billing(events: DataFrame, today: Column) -> DataFrame:
    """The deduplicated rollup from the first of the month that was two days ago."""
    since = F.trunc(F.date_sub(today, 2), "MM")
    return daily(dedup(events.where(F.to_date("ts") >= since))).drop("rows_count")


def tenant_usage(rollup: DataFrame, project_id: str, date_from: str, date_to: str) -> DataFrame:
    """One project's usage by day, pipeline and plugin; both days belong to the period."""
    chosen = rollup.where((F.col("project_id") == project_id) & F.col("day").between(F.lit(date_from).cast("date"), F.lit(date_to).cast("date")))
    return chosen.groupBy("day", "pipeline_uid", "plugin").agg(*(F.sum(c).alias(c) for c in MEASURES)).orderBy("day", "pipeline_uid", "plugin")


def usage_report(events: DataFrame, project_id: str, date_from: str, date_to: str) -> DataFrame:
    """The same straight from the events."""
    return tenant_usage(daily(dedup(events.where(F.col("project_id") == project_id))), project_id, date_from, date_to)


#: Counters of a step that a job's row has the sums of.
UNITS = ["llm_input_tokens", "llm_output_tokens", "llm_requests", "audio_seconds", "pages", "images", "external_requests"]
#: Fixed value: characters of an error that an event keeps.
MOST_ERROR = 512


def events_for_jobs(steps: DataFrame, jobs: DataFrame) -> DataFrame:
    """The events of EVENT_COLUMNS: a row for each step and a row with each job's totals.

    steps: job_id, step_no, step_id, plugin, status, branches, duration_ms, input_bytes, documents_out, UNITS, error; jobs:
    job_id, workflow_id, project_id, region, pipeline_uid, pipeline_builtin, index_name, task_queue, input_mime, status,
    input_bytes, started_at, finished_at, error.
    """
    common = ["workflow_id", "project_id", "region", "pipeline_uid", "pipeline_builtin", "index_name", "task_queue", "input_mime"]
    told = lambda status: [errors.error_kind(F.col(status), F.col("error")).alias("error_kind"), F.coalesce(F.left("error", F.lit(MOST_ERROR)), F.lit("")).alias("error")]
    each = steps.join(jobs.select("job_id", F.col("finished_at").alias("ts"), *common), "job_id")
    own = [F.concat_ws(":", "job_id", "step_id", F.lit("1")).alias("event_id"), F.lit("step").alias("kind"), F.lit(1).alias("attempt")]
    step_rows = each.select(*own, "ts", "job_id", *common, "step_id", "plugin", "status", F.col("branches").cast("int").alias("branches"), "duration_ms", "input_bytes", "documents_out", *UNITS, *told("status"))
    sums = steps.groupBy("job_id").agg(*(F.sum(c).alias(c) for c in UNITS), indexed(F.col("step_no"), F.col("plugin"), F.col("status"), F.col("documents_out")).alias("reached"))
    whole = jobs.join(sums, "job_id", "left")
    reached = documents_reached(F.col("status"), F.col("reached"))
    zero = [F.coalesce(F.col(c), F.lit(0)).cast(steps.schema[c].dataType).alias(c) for c in UNITS]
    job_rows = whole.select(
        F.concat(F.col("job_id"), F.lit(":job")).alias("event_id"), F.lit("job").alias("kind"), F.lit(1).alias("attempt"), F.col("finished_at").alias("ts"), "job_id", *common, F.lit("").alias("step_id"), F.lit("").alias("plugin"), "status",
        F.lit(0).alias("branches"), wall_clock_ms(F.col("started_at"), F.col("finished_at")).alias("duration_ms"), "input_bytes", reached.alias("documents_out"), *zero, *told("status"),
    )
    return step_rows.unionByName(job_rows).select(*EVENT_COLUMNS)


def indexed(step_no: Column, plugin: Column, status: Column, documents: Column, sink: str = "index_sink") -> Column:
    """Aggregate over a job's steps: (whether a sink ran, the documents of those that succeeded, the last step's documents)."""
    sinks = F.sum(F.when((plugin == sink) & (status == "succeeded"), documents))
    return F.struct((F.count_if(plugin == sink) > 0).alias("sink"), F.coalesce(sinks, F.lit(0)).cast("long").alias("sunk"), F.max_by(documents, step_no).cast("long").alias("last"))


def documents_reached(job_status: Column, reached: Column) -> Column:
    """The documents of a job that reached the index; without a sink step, a succeeded job's last step's."""
    return F.coalesce(F.when(reached["sink"], reached["sunk"]).when(job_status == "succeeded", reached["last"]), F.lit(0).cast("long"))


def wall_clock_ms(started: Column, finished: Column) -> Column:
    return F.greatest(F.lit(0), F.unix_millis(finished.cast("timestamp")) - F.unix_millis(started.cast("timestamp")))


def billing_units(jobs: DataFrame, steps: DataFrame) -> DataFrame:
    """jobs: job_id, status, input_bytes; steps as in events_for_jobs, with unpriced_calls. The whole units that a job is billed for, and those that are only told."""
    ocr = F.when(F.col("plugin") == "ocr", F.when(F.col("pages") > 0, F.col("pages")).otherwise(F.col("documents_out")))
    plain = ["pages", "images", "llm_requests", "external_requests"]
    sums = steps.groupBy("job_id").agg(
        F.sum("duration_ms").alias("ms"), F.sum("llm_input_tokens").alias("llm_tokens_in"), F.sum("llm_output_tokens").alias("llm_tokens_out"), F.sum("audio_seconds").alias("seconds"), F.sum(ocr).alias("ocr_pages"),
        *(F.sum(c).alias(c) for c in plain), F.sum("unpriced_calls").alias("unpriced_provider_calls"), indexed(F.col("step_no"), F.col("plugin"), F.col("status"), F.col("documents_out")).alias("reached"),
    )
    whole = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    some = (F.col("seconds") > 0) & ~F.isnan("seconds") & (F.col("seconds") < float("inf"))
    counted = ["llm_tokens_in", "llm_tokens_out", "ocr_pages", *plain, "unpriced_provider_calls"]
    return jobs.join(sums, "job_id", "left").select(
        "job_id", documents_reached(F.col("status"), F.col("reached")).alias("documents"), F.col("input_bytes").alias("bytes_in"), whole(F.ceil(F.col("ms") / 1000)).alias("step_seconds"), whole(F.when(some, F.ceil("seconds"))).alias("audio_seconds"), *(whole(F.col(c)).alias(c) for c in counted)
    )


def approx_size(docs: DataFrame) -> Column:
    """Bytes that a document row counts for in metering: id, title, content, fields as JSON, and 256 for the rest."""
    n = lambda c: F.coalesce(F.octet_length(c), F.lit(0)) if c in docs.columns else F.lit(0)
    return (n("id") + n("title") + n("content") + (F.coalesce(F.octet_length("fields"), F.lit(2)) if "fields" in docs.columns else F.lit(2)) + 256).cast("long")


def blob_size(data: Column) -> Column:
    """Bytes that raw content counts for: its length in base 64, without padding."""
    return F.floor(F.octet_length(data) * 4 / 3).cast("long")


def provider_cost(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """calls: plugin, model, llm_input_tokens, llm_output_tokens, llm_requests, external_requests, audio_seconds.

    prices: plugin, model (`default` for any), input_per_mtok, output_per_mtok, per_audio_second, per_request: a fixed
    configuration table of a few rows. The exact model, the model without its provider, then the default; a call without a
    price, or without the quantity that is priced, costs 0 and counts as unpriced. Whole micro-dollars, each part rounded up.
    """
    table = F.broadcast(prices.groupBy(F.col("plugin").alias("p")).agg(F.map_from_entries(F.collect_list(F.struct("model", F.struct("input_per_mtok", "output_per_mtok", "per_audio_second", "per_request")))).alias("by_model")))
    bare = F.when(F.contains("model", F.lit("/")), F.regexp_replace("model", "^[^/]*/", ""))
    found = calls.join(table, calls["plugin"] == table["p"], "left").withColumn("price", F.coalesce(F.col("by_model")[F.col("model")], F.col("by_model")[bare], F.col("by_model")["default"]))
    p = lambda c: F.coalesce(F.col("price")[c], F.lit(0)).cast("decimal(20,0)")
    no_tokens = ((p("input_per_mtok") > 0) | (p("output_per_mtok") > 0)) & (F.col("llm_input_tokens") == 0) & (F.col("llm_output_tokens") == 0)
    no_seconds = (p("per_audio_second") > 0) & ~((F.col("audio_seconds") > 0) & ~F.isnan("audio_seconds") & (F.col("audio_seconds") < float("inf")))
    unpriced = F.col("price").isNull() | no_tokens | no_seconds
    tokens = F.ceil((F.col("llm_input_tokens") * p("input_per_mtok") + F.col("llm_output_tokens") * p("output_per_mtok")) / 1_000_000)
    audio = F.ceil(F.col("audio_seconds") * p("per_audio_second").cast("double"))
    requests = F.greatest(F.lit(1), F.col("llm_requests") + F.col("external_requests")) * p("per_request")
    cost = F.when(unpriced, F.lit(0)).otherwise((tokens + audio + requests).cast("long"))
    return found.select(*calls.columns, cost.cast("long").alias("cost_micro_usd"), unpriced.cast("int").alias("unpriced_calls"))


def unpriced_plugins(registered: DataFrame, prices: DataFrame) -> DataFrame:
    """Registered plugins that pay a provider and have no price over zero."""
    registered = registered.where(F.col("plugin").isin(PRICED_PLUGINS))
    some = prices.where("input_per_mtok + output_per_mtok + per_audio_second + per_request > 0").select("plugin")
    return registered.join(some, "plugin", "left_anti")


def fan_in(branches: DataFrame, sums: list[str] | None = None, keys: tuple[str, ...] = ("step",)) -> DataFrame:
    """branches: step, branch, ok (null: cancelled), error, documents, duration_ms, input_bytes and usage counters (`sums`). A step's branches as one outcome.

    A failed branch fails the step, before one that was cancelled; what the branches that ended well add up to is kept.
    """
    sums = sums or [c for c in ("documents", "duration_ms", "input_bytes", *UNITS) if c in branches.columns]
    done, failed = F.count_if(F.col("ok")), F.count_if(~F.col("ok"))
    first = F.min_by(F.when(~F.col("ok"), F.col("error")), F.when(~F.col("ok"), F.col("branch")))
    # Fixed value: the text of the message.
    message = F.concat((F.count("*") - done).cast("string"), F.lit(" of "), F.count("*").cast("string"), F.lit(" branches failed; first error: "), first)
    outcome = F.when(failed > 0, F.lit("failed")).when(done < F.count("*"), F.lit("cancelled")).otherwise(F.lit("succeeded"))
    added = [F.coalesce(F.sum(F.when(F.col("ok"), F.col(c))), F.lit(0)).alias(c) for c in sums]
    return branches.groupBy(*keys).agg(outcome.alias("outcome"), F.count("*").alias("branches"), *added, F.when(failed > 0, message).alias("error"))


def fan_out(docs: DataFrame, order: list[str], most: int = 500, per: list[str] | None = None) -> DataFrame:
    """Adds branch: contiguous groups of ceil(n / most) documents in order, for each group of `per`. A group of any size spreads over tasks."""
    placed = numbered(docs, per or [], order)
    return placed.select(*docs.columns, F.floor(F.col("rank") / F.ceil(F.col("total") / most)).alias("branch"))


def deduplicated_last(rows: DataFrame, key: list[str], newest: list[str]) -> DataFrame:
    """The newest row for each key: an aggregate, so that it combines before the shuffle."""
    order = F.struct(*newest)
    return rows.groupBy(*key).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in key]), order).alias("r")).select(*key, "r.*")


def expired(events: DataFrame, now: Column, days: int = 180) -> DataFrame:
    """What a time-to-live of so many days keeps."""
    return events.where(F.col("ts") >= now - F.expr(f"INTERVAL {days} DAYS"))


def write_usage(events: DataFrame, path: str) -> None:
    """Appends events to the Parquet table at path, by month of ts. Columns may be added or missing; another type is an error.

    Deliveries that come twice stay: dedup() keeps the last one when the table is read.
    """
    spark = events.sparkSession
    try:
        known = {f.name: f.dataType for f in read_usage(spark, path).schema}
    except Exception as e:  # noqa: BLE001  no table yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        known = {}
    for f in events.schema:
        if f.name in known and known[f.name] != f.dataType:
            raise ValueError(f"column {f.name} is {known[f.name].simpleString()} in the table, not {f.dataType.simpleString()}")
    events.withColumn("month", F.date_format("ts", "yyyyMM")).write.mode("append").partitionBy("month").parquet(path)


def read_usage(spark, path: str) -> DataFrame:
    """All events of the table, with the columns of every release that wrote to it."""
    return spark.read.option("mergeSchema", "true").parquet(path).drop("month")
