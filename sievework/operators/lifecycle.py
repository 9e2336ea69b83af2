"""Events of jobs for other systems, and their migration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.errors import failure_reason

MOST_LONG = 9223372036854775807


def execution_status(described: Column, progress: Column) -> Column:
    """A job's status by the scheduler's word; while it runs, the job's own view where there is one."""
    ended = F.when(described == "completed", F.lit("succeeded")).when(described.isin("failed", "timed_out"), F.lit("failed")).when(described.isin("canceled", "terminated"), F.lit("cancelled"))
    return F.coalesce(ended, progress, F.lit("running"))


def lifecycle_events(jobs: DataFrame, steps: DataFrame) -> DataFrame:
    """jobs: job_id, status, error, started_at, finished_at; steps: job_id, step_no, step_id, plugin, status, error.

    type job.completed, job.cancelled or job.failed; seconds never under 0; the reason of a failure is that of the first failed step.
    """
    first = F.min_by(F.struct("step_id", "plugin", "error"), "step_no")
    failed = steps.where("status = 'failed'").groupBy("job_id").agg(first.alias("f"))
    both = jobs.join(failed, "job_id", "left")
    kind = F.when(F.col("status") == "succeeded", F.lit("job.completed")).when(F.col("status") == "cancelled", F.lit("job.cancelled")).otherwise(F.lit("job.failed"))
    message = F.coalesce(F.nullif(F.trim("error"), F.lit("")), F.col("status"))
    lost = kind == "job.failed"
    secs = F.greatest(F.lit(0), F.unix_timestamp(F.col("finished_at").cast("timestamp")) - F.unix_timestamp(F.col("started_at").cast("timestamp")))
    return both.select(
        "job_id", kind.alias("type"), F.when(kind == "job.completed", secs).alias("duration_secs"), F.when(lost, F.col("f.step_id")).alias("step"), F.when(lost, failure_reason(F.col("f.plugin"), F.coalesce(F.col("f.error"), message))).alias("reason"), F.when(lost, message).alias("error_message")
    )


def usage_recorded(units: DataFrame) -> DataFrame:
    """units: job_id, pages, images, cost_micro_usd, unpriced_calls. The billed event: cost capped at 64 bits, and its description."""
    text = F.concat(F.format_string("%d pages, %d images", "pages", "images"), F.when(F.col("unpriced_calls") > 0, F.lit(" (provider cost incomplete)")).otherwise(F.lit("")))
    return units.select("job_id", F.least(F.col("cost_micro_usd"), F.lit(MOST_LONG).cast("decimal(38,0)")).cast("long").alias("cost_micro_usd"), text.alias("description"))


def migrate_units(events: DataFrame) -> DataFrame:
    """events: id, body (JSON with a `units` object). Units as whole numbers of 0 or more, 0 for what is no number; sorted by key."""
    units = F.map_entries(F.coalesce(F.from_json(F.get_json_object("body", "$.units"), "map<string, string>"), F.create_map().cast("map<string,string>")))
    rows = events.select("id", F.explode_outer(units).alias("u"))
    number = F.when(F.col("u.value").rlike(r"^-?[0-9]+(\.[0-9]+)?$"), F.ceil(F.greatest(F.col("u.value").cast("decimal(30,6)"), F.lit(0).cast("decimal(30,6)"))).cast("long")).otherwise(F.lit(0).cast("long"))
    entry = F.when(F.col("u").isNotNull(), F.struct(F.col("u.key").alias("key"), number.alias("value")))
    return rows.groupBy("id").agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(entry)))).alias("units"))
