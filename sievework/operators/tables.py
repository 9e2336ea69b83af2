"""Tables between the stages of a job, in the folder that driver and executors share, and places of rows in an order."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir; a local one only for a local master."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared:
        return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return "file://" + tempfile.mkdtemp(prefix=f"sievework-{name}-")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: df written once and read back, so that what reads it twice computes it once."""
    path = f"{shared_folder(df.sparkSession, name)}/table"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, order: list[str | Column]) -> DataFrame:
    """df written by ranges of its order, with the range of each row as __part: ranges go up with the order, and a group of any size has many."""
    return stage(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "dealt")


def numbered(df: DataFrame, per: list[str], order: list[str | Column]) -> DataFrame:
    """Adds rank (from 0) and total of each group of `per`, in order.

    A range-partitioned sort over groups and order: a part knows how many rows of its first group lie in the parts before,
    so a group of any size spreads over parts, and no window holds one.
    """
    by = [F.col(c) for c in per] + [F.col(c) if isinstance(c, str) else c for c in order]
    sorted_ = df.repartitionByRange(*by).sortWithinPartitions(*by)
    rows = stage(sorted_.select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__row")), "numbered")
    keys = [F.col(c).alias(f"__k{n}") for n, c in enumerate(per)]
    names = [f"__k{n}" for n in range(len(per))]
    parts = rows.groupBy(*keys, F.col("__part").alias("__p")).agg(F.min("__row").alias("__first"), F.count("*").alias("__n"))
    group = Window.partitionBy(*(names or [F.lit(0)]))  # a row for each group and part of the sort
    placed = parts.select(*names, "__p", "__first", (F.sum("__n").over(group.orderBy("__p")) - F.col("__n")).alias("__before"), F.sum("__n").over(group).alias("total"))
    same = F.col("__part") == F.col("__p")
    for c, k in zip(per, names, strict=True):
        same &= F.col(c).eqNullSafe(F.col(k))
    return rows.join(placed, same).select(*df.columns, (F.col("__before") + F.col("__row") - F.col("__first")).alias("rank"), "total")
