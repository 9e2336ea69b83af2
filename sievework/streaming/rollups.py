"""Daily usage kept by a stream with retractions: an event delivered anew takes its former contribution back.

Beside the rollup lies a merge table with the last delivery of every event, laid out by month. A batch reads the months it has
events of, from that table; what it adds and takes back is one small table of partial states, and the rollup is
their sum. Nothing is computed anew from raw events.

A batch that is replayed gives the same: its states are written before the events are, under the batch's number, and a
batch whose states are there only brings its events in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from ..operators import index, usage

_SUMS = ["rows_count", *usage.MEASURES]


def month(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMM")


def identified(events: DataFrame, order: str = "seq") -> DataFrame:
    """What the rollup needs of events, with the id of each (project, time and event id) and its month."""
    needed = ["ts", "project_id", "pipeline_uid", "plugin", "kind", "status", order, *usage.STEP_SUMS]
    return events.select("event_id", *needed).withColumns({"id": F.concat_ws("|", F.col("project_id"), F.col("ts").cast("string"), F.col("event_id")), "month": month(F.col("ts"))}).drop("event_id")


def changes(new: DataFrame, old: DataFrame | None, order: str = "seq") -> DataFrame:
    """What a batch does to the events that count: those that count now with _sign 1, those that they replace with -1. A delivery older than the one that counts does nothing.

    old may have several deliveries of an event: the latest by `order` counts. One sort by ranges of month and id deduplicates, compares
    and lays out by month; each event is held by itself.
    """
    both = new.withColumn("_old", F.lit(0))
    if old is not None:
        both = both.unionByName(old.select(*(c for c in old.columns if c in new.columns), F.lit(1).alias("_old")), allowMissingColumns=True)
    latest = Window.partitionBy("month", "id").orderBy(F.col(order).desc(), F.col("_old").desc())
    ranked = both.repartitionByRange("month", "id").withColumns({"_n": F.row_number().over(latest), "_olds": F.sum("_old").over(latest.rowsBetween(Window.unboundedPreceding, 0))})
    counts, replaced = (F.col("_old") == 0) & (F.col("_n") == 1), (F.col("_old") == 1) & (F.col("_olds") == 1) & (F.col("_n") > 1)
    return ranked.where(counts | replaced).select(*new.columns, F.when(counts, 1).otherwise(-1).alias("_sign"))


def states(changed: DataFrame) -> DataFrame:
    """What changes add to the rollup."""
    each = usage.partials(changed, F.col("_sign"))
    return each.groupBy(*usage.KEYS).agg(*(F.sum(F.col("part") * F.col(c)).alias(c) for c in _SUMS)).withColumn("month", month(F.col("day")))


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _there(spark: SparkSession, path: str) -> bool:
    fs, where = _at(spark, path)
    return fs.exists(where)


def touched(spark: SparkSession, path: str, months: list[str]) -> DataFrame | None:
    """The deliveries in these months that count or did so; null before the first batch."""
    return index.history(spark, f"{path}/events", F.col("month").isin(months))


def apply_batch(events: DataFrame, batch: int, path: str, order: str = "seq") -> None:
    """events: usage events with a number `order` that tells the later of two deliveries."""
    spark = events.sparkSession
    months = sorted(r["month"] for r in events.select(month(F.col("ts")).alias("month")).distinct().collect())  # few: a batch's months
    if not months:
        return
    changed = changes(identified(events, order), touched(spark, path, months), order).withColumn("_gone", F.lit(False))
    made, sums = f"{path}/changes/batch={batch}", f"{path}/states/batch={batch}"
    changed.write.mode("overwrite").partitionBy("_sign", "month").parquet(made)  # read twice below
    if not _there(spark, f"{sums}/_SUCCESS"):
        states(spark.read.schema(changed.schema).parquet(made)).hint("rebalance", "month").write.mode("overwrite").partitionBy("month").parquet(sums)
    index.adopt(spark, f"{path}/events", f"{made}/_sign=1", changed.drop("_sign").schema, "month")
    fs, where = _at(spark, made)
    fs.delete(where, True)


def read_rollup(spark: SparkSession, path: str, months: list[str] | None = None) -> DataFrame:
    """The rollup: day, project, pipeline and plugin with their measures, of these months or all."""
    states = spark.read.parquet(f"{path}/states")
    if months is not None:
        states = states.where(F.col("month").cast("string").isin(months))
    return usage.merge(states).where("rows_count > 0")


def maintain(events: DataFrame, path: str, checkpoint: str, order: str = "seq") -> StreamingQuery:
    """Keeps the rollup at path by what the stream has now."""
    return events.writeStream.foreachBatch(lambda df, n: apply_batch(df, n, path, order)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
