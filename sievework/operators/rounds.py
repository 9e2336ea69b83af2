"""How a job goes on: rounds of steps that ran side by side, and an archive's files in waves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Files started at once, waves of a run before it starts anew, and the issues kept in each list.
WAVE, WAVES_PER_RUN, ISSUES_KEPT = 50, 10, 50


def settled(results: DataFrame) -> DataFrame:
    """results: job_id, round, n (place among the round's ready steps), step_id, plugin, status, documents, message, metered.

    The rows that a job's record gets, with `place` in the round: steps that completed first, then those that stopped, so that
    a job that ends here ends on a step that did not complete. A cancelled step has a row only where some branch of it
    was metered. A round holds a pipeline's steps, so a window over it is small.
    """
    stopped = F.col("status") != "succeeded"
    kept = results.where((F.col("status") != "cancelled") | F.coalesce("metered", F.lit(False)))
    order = Window.partitionBy("job_id", "round").orderBy(stopped, "n")
    documents = F.when(stopped, F.lit(0)).otherwise(F.col("documents"))
    error = F.when(F.col("status") == "failed", F.col("message"))
    return kept.select("job_id", "round", F.row_number().over(order).alias("place"), "step_id", "plugin", "status", documents.alias("documents"), error.alias("error"))


def round_ends(results: DataFrame) -> DataFrame:
    """How each round ended a job, if it did: by its first step, in order, that did not complete."""
    # Fixed value: the text of the message.
    said = F.when(F.col("status") == "failed", F.concat(F.lit("step "), "step_id", F.lit(" ("), "plugin", F.lit(") failed: "), F.coalesce("message", F.lit(""))))
    stop = F.min_by(F.struct(F.col("status").alias("outcome"), said.alias("error")), F.when(F.col("status") != "succeeded", F.col("n")))
    return results.groupBy("job_id", "round").agg(stop.alias("s")).select("job_id", "round", F.when(F.col("s.outcome") == "succeeded", None).otherwise(F.col("s.outcome")).alias("outcome"), "s.error")


def waves(files: DataFrame, wave: int = WAVE, waves_per_run: int = WAVES_PER_RUN) -> DataFrame:
    """files: job_id, n (from 0, in the archive), status (succeeded, failed, skipped). A row for each wave of each archive, with its run and counts.

    Skipped files take a place in their wave and are not started.
    """
    wave, waves_per_run = max(1, wave), max(1, waves_per_run)
    numbered = files.withColumn("wave", F.floor(F.col("n") / wave))
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    each = numbered.groupBy("job_id", "wave").agg(F.min("n").alias("first"), F.max("n").alias("last"), F.count_if(F.col("status").isin("succeeded", "failed")).alias("started"), *map(count, ("succeeded", "failed", "skipped")))
    return each.withColumn("run", F.floor(F.col("wave") / waves_per_run))


def issues(files: DataFrame, kept: int = ISSUES_KEPT) -> DataFrame:
    """files: job_id, n, path, status, error. Of each archive the first `kept` failed and the first `kept` skipped files; counts stay exact elsewhere.

    Every block of 1000 files gives its first `kept` before an archive's blocks meet, so no task sorts a whole archive.
    """
    bad = files.where(F.col("status").isin("failed", "skipped"))
    row = F.struct("n", "path", F.col("error").alias("reason"))
    first = lambda df, *keys: df.groupBy(*keys).agg(F.slice(F.array_sort(F.flatten(F.collect_list("rows"))), 1, kept).alias("rows"))
    blocks = first(bad.withColumns({"block": F.floor(F.col("n") / 1000), "rows": F.array(row)}), "job_id", "status", "block")
    while_small = blocks.withColumn("block", F.floor(F.col("block") / 1000))
    return first(first(while_small, "job_id", "status", "block"), "job_id", "status").select("job_id", "status", F.inline("rows"))
