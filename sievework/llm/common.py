"""Helpers shared by the training-data operators: word rule, Arrow slicing, staged tables."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

# The word rule is [^\x20\x09-\x0D]+, which is what bytes.split() splits by.
ASCII_SPACE = " \t\n\v\f\r"

#: Paths that stage() wrote within the innermost open scope() (none outside one: such tables stay).
_open: ContextVar[list[str] | None] = ContextVar("staged", default=None)


def temp_name(stem: str) -> str:
    """A column name that no input column has."""
    return f"__{stem}_{uuid.uuid4().hex[:12]}"


def read_table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not spark.sparkContext.master.startswith("local-cluster"):
        own = "file://" + tempfile.mkdtemp(prefix="sievework-")
        spark.conf.set("spark.checkpoint.dir", own)
        return own
    raise ValueError("spark.checkpoint.dir must name a folder that all executors share")


def stage(df: DataFrame, name: str, free: bool = False) -> DataFrame:
    """Cuts lineage: writes df as Parquet in the shared folder and reads it back, so a lost executor costs no recompute.

    free: lets the driver's JVM collect its garbage, upon which Spark deletes the shuffle files that df needed.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    within = _open.get()
    if within is not None:
        within.append(path)
    if free:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def drop(staged: DataFrame) -> None:
    """Deletes a table of stage() that nothing reads any more."""
    for path in {x.rsplit("/", 1)[0] for x in staged.inputFiles()}:
        delete(staged.sparkSession, path)


def again(staged: DataFrame) -> DataFrame:
    """A table of stage() read once more: as a relation of its own it can meet itself in a join or cogroup."""
    paths = {x.rsplit("/", 1)[0] for x in staged.inputFiles()}
    return staged.sparkSession.read.schema(staged.schema).parquet(*paths) if paths else staged


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what was staged within it, and nothing else: other results keep their tables."""
    mine: list[str] = []
    token = _open.set(mine)
    try:
        yield
    finally:
        _open.reset(token)
        for path in mine:
            delete(spark, path)


def settled(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The rows of make(), written once; all that it staged on the way goes. The result's own table stays for its readers."""
    outer = _open.get()
    with scope(spark):
        out = make()
        path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        out.write.option("compression", "zstd").parquet(path)
    if outer is not None:
        outer.append(path)
    return spark.read.schema(out.schema).parquet(path)


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """Texts as UTF-8 bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    elif pa.types.is_string(column.type):
        column = column.cast(pa.binary())
    return [b"" if x is None else x for x in column.to_pylist()]


def slices(batch: pa.RecordBatch, column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about `most` bytes of text each (at least one row), so that memory follows the longest text."""
    sizes = np.fromiter((x or 0 for x in pc.binary_length(batch.column(column)).to_pylist()), np.int64, batch.num_rows)
    ends, at = np.cumsum(sizes), 0
    while at < batch.num_rows:
        upto = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right"))
        upto = min(batch.num_rows, max(at + 1, upto))
        yield batch.slice(at, upto - at)
        at = upto


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the published SplitMix64 constants)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def first_in_batch(who: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (a document each, `who`) by key: the pre-aggregation that bounds the rows of a hot key by the number of batches.

    Returns indexes: of each key's row with the least document (the only one that must ask other batches about the
    key), of the rows of later documents (for them this batch has an earlier one), and of the least rows of keys that
    several documents of the batch have. Rows that repeat a key within one document are left out.
    """
    order = np.lexsort((who, *keys))
    new_key = np.zeros(len(order), bool)
    new_key[:1] = True
    for k in keys:
        x = k[order]
        new_key[1:] |= x[1:] != x[:-1]
    w = who[order]
    new_row = new_key.copy()
    new_row[1:] |= w[1:] != w[:-1]
    several = np.zeros(len(order), bool)
    starts = np.flatnonzero(new_key)
    if len(starts):
        several[starts] = np.add.reduceat(new_row, starts) > 1
    return order[new_key], order[new_row & ~new_key], order[several]
