"""Usage metering as Structured Streaming: deduplication, daily rollups, the recomputed billing table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import usage


def with_event_time(events: DataFrame, watermark: str) -> DataFrame:
    """Event times are UTC; a watermark needs a TIMESTAMP."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)


def dedup(events: DataFrame, watermark: str = "1 day") -> DataFrame:
    """Each event once: delivery is at least once and ids are deterministic. State older than the watermark goes."""
    return with_event_time(events, watermark).dropDuplicatesWithinWatermark(["event_id"])


def daily_counts(events: DataFrame) -> DataFrame:
    """Rows and values by tenant, UTC day and type."""
    day = F.window("ts", "1 day")["start"].cast("date").alias("day")
    return events.groupBy(day, "project_id", "kind").agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Processes what there is and stops."""
    return df.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def maintain_billing(events: DataFrame, raw: str, billing: str, checkpoint: str, today: str) -> StreamingQuery:
    """Each batch is added to the raw table, and the months that can still change are computed anew from it, deduplicated."""

    def batch(df: DataFrame, _: int) -> None:
        spark = df.sparkSession
        df.write.mode("append").parquet(raw)
        rollup = usage.billing(spark.read.parquet(raw), F.lit(today).cast("date")).withColumn("month", F.trunc("day", "MM"))
        rollup.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(billing)

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
