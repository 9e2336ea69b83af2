"""The index as a log-structured merge table: a manifest of versions, data files, delete vectors, compaction.

A version is a small JSON manifest `_versions/<n>.json` that lists, newest first, the table's runs: folders of Parquet
files with whole rows and tombstones (ids that are gone) of one upsert. A row counts if no newer run has its id. Writers
create the next version's file and never overwrite one, so of two writers one loses and tries again upon the new
version; a writer that dies before that leaves nothing that a reader sees. Readers open the newest version.

An upsert writes its own rows alone. Runs of like size are merged when MERGE of them have come together (each row is so rewritten
a logarithmic number of times); a merge that reaches the oldest run drops tombstones. Runs are partitioned by nothing
and bounded by their size alone; a reader needs one window-free anti join for each run but the newest.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Runs of one size class that are merged, and the rows of the smallest class.
MERGE, SMALL = 4, 1000
#: Attempts to commit against other writers.
ATTEMPTS = 10


class Conflict(RuntimeError):
    pass


@dataclass(frozen=True)
class Run:
    name: str
    rows: int
    schema: str
    partition: str | None = None


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def versions(spark: SparkSession, path: str) -> list[int]:
    fs, where = _files(spark, f"{path}/_versions")
    if not fs.exists(where):
        return []
    names = (f.getPath().getName() for f in fs.listStatus(where))
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def runs(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, list[Run]]:
    """The version (the newest by default; 0 before the first) and its runs, newest first."""
    known = versions(spark, path)
    version = (known[-1] if known else 0) if version is None else version
    if not version:
        return 0, []
    fs, where = _files(spark, f"{path}/_versions/{version:020d}.json")
    stream = fs.open(where)
    try:
        text = bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()
    return version, [Run(**r) for r in json.loads(text)["runs"]]


def commit(spark: SparkSession, path: str, version: int, found: list[Run]) -> None:
    """Makes `found` the version after `version`; Conflict if another writer was first.

    The manifest is written under another name and renamed, which does not replace a file that is there.
    """
    fs, target = _files(spark, f"{path}/_versions/{version + 1:020d}.json")
    fs.mkdirs(target.getParent())
    temporary = _path(spark, f"{path}/_versions/.{uuid.uuid4().hex}")
    out = fs.create(temporary, False)
    try:
        out.write(bytearray(json.dumps({"runs": [asdict(r) for r in found]}).encode()))
    finally:
        out.close()
    jvm = spark._jvm
    options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:  # as the logs of Structured Streaming: a rename that fails if the target is there
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(temporary), fs.makeQualified(target), options)
    except Py4JJavaError as e:
        fs.delete(temporary, False)
        if "FileAlreadyExistsException" not in str(e.java_exception):
            raise
        raise Conflict(f"version {version + 1} of {path} is another writer's") from None


def _read(spark: SparkSession, path: str, run: Run) -> DataFrame:
    return spark.read.schema(T.StructType.fromJson(json.loads(run.schema))).parquet(f"{path}/{run.name}")


def _write(spark: SparkSession, path: str, rows: DataFrame, partition: str | None = None) -> Run:
    """rows: an index row each, with _gone for tombstones. partition: a column by which the run's files are laid out."""
    name = f"run-{uuid.uuid4().hex}"
    (rows.hint("rebalance", partition).write.partitionBy(partition) if partition else rows.write).parquet(f"{path}/{name}")
    return Run(name, spark.read.schema(rows.schema).parquet(f"{path}/{name}").count(), rows.schema.json(), partition)


def live(spark: SparkSession, path: str, found: list[Run], tombstones: bool = False, where: Column | None = None) -> DataFrame:
    """The newest row of each id in these runs; of each run only rows that `where` holds for are read (an id's rows all or none)."""
    tables = [_read(spark, path, r) for r in found]
    if where is not None:
        tables = [t.where(where) for t in tables]
    out = tables[0]
    newer = out.select("id")
    for older in tables[1:]:
        out = out.unionByName(older.join(newer, "id", "left_anti"), allowMissingColumns=True)
        newer = newer.unionByName(older.select("id"))
    return out if tombstones else out.where(~F.col("_gone"))


def read_index(spark: SparkSession, path: str, version: int | None = None, where: Column | None = None) -> DataFrame:
    """The rows of a version (the newest by default)."""
    at, found = runs(spark, path, version)
    if not at:
        raise FileNotFoundError(f"no index at {path}")
    return live(spark, path, found, where=where).drop("_gone")


def history(spark: SparkSession, path: str, where: Column | None = None) -> DataFrame | None:
    """The rows of all runs of the newest version, replaced ones too, without a join; null before the first."""
    tables = [_read(spark, path, r) for r in runs(spark, path)[1]]
    if not tables:
        return None
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [t if where is None else t.where(where) for t in tables])


def _size_class(rows: int) -> int:
    n = 0
    while rows > SMALL:
        rows, n = rows // MERGE, n + 1
    return n


def due(found: list[Run]) -> tuple[int, int] | None:
    """Neighbouring runs [start, end) to merge: MERGE or more, none above a class, of the lowest class that has such."""
    classes = [_size_class(r.rows) for r in found]
    for most in sorted(set(classes)):
        start = 0
        for at in range(len(classes) + 1):
            if at == len(classes) or classes[at] > most:
                if at - start >= MERGE:
                    return start, at
                start = at + 1
    return None


def compact(spark: SparkSession, path: str) -> bool:
    """Merges the runs that are due, if any. Readers of older versions keep their files until vacuum()."""
    version, found = runs(spark, path)
    stretch = due(found)
    if not stretch:
        return False
    start, end = stretch
    merged = _write(spark, path, live(spark, path, found[start:end], end < len(found)), found[start].partition)
    commit(spark, path, version, [*found[:start], merged, *found[end:]])
    return True


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Deletes runs that none of the newest `keep` versions lists, and older manifests. Not while writers are at work."""
    known = versions(spark, path)
    used = {r.name for v in known[-keep:] for r in runs(spark, path, v)[1]}
    fs, where = _files(spark, path)
    gone = [f.getPath() for f in fs.listStatus(where) if f.getPath().getName().startswith("run-") and f.getPath().getName() not in used]
    for p in gone:
        fs.delete(p, True)
    for v in known[:-keep]:
        fs.delete(_path(spark, f"{path}/_versions/{v:020d}.json"), False)
    return len(gone)


def _discard(spark: SparkSession, path: str, run: Run) -> None:
    fs, where = _files(spark, f"{path}/{run.name}")
    fs.delete(where, True)


def append(spark: SparkSession, path: str, make: Callable[[DataFrame | None], DataFrame]) -> DataFrame:
    """Commits one run whose rows follow from what the table holds: make(rows, or null before the first). Of writers at one time each sees the others' rows."""
    for _ in range(ATTEMPTS):
        version, found = runs(spark, path)
        run = _write(spark, path, make(live(spark, path, found).drop("_gone") if found else None).withColumn("_gone", F.lit(False)))
        try:
            commit(spark, path, version, [run, *found])
            return _read(spark, path, run).drop("_gone")
        except Conflict:
            _discard(spark, path, run)
    raise Conflict(f"{ATTEMPTS} other writers were first at {path}")


def write_index(spark: SparkSession, docs: DataFrame, path: str, order: str = "seq", prune_stale: bool = False, partition: str | None = None) -> int:
    """Upserts docs (id, parent_id, chunk_total, ...), of rows with one id the last by `order`; with prune_stale, children of the
    run's complete parents that the run does not have are gone. Returns the version.

    What is written follows the docs, not the index. Running it twice changes nothing.
    """
    from .sink import prune  # the rule of stale children is the sink's

    latest = docs.groupBy("id").agg(F.max_by(F.struct(*[c for c in docs.columns if c not in ("id", order)]), order).alias("r")).select("id", "r.*", F.lit(False).alias("_gone"))
    for _ in range(ATTEMPTS):
        version, found = runs(spark, path)
        rows = latest
        if prune_stale and found:
            stale = prune(live(spark, path, found), docs).select("id", F.lit(True).alias("_gone"))
            rows = latest.unionByName(stale, allowMissingColumns=True)
        run = _write(spark, path, rows, partition)
        try:
            commit(spark, path, version, [run, *found])
        except Conflict:
            _discard(spark, path, run)
            continue
        return _merged(spark, path)
    raise Conflict(f"{ATTEMPTS} other writers were first at {path}")


def _merged(spark: SparkSession, path: str) -> int:
    """The version after all merges that are due."""
    try:
        while compact(spark, path):
            pass
    except Conflict:  # another writer's next upsert merges
        pass
    return runs(spark, path)[0]


def adopt(spark: SparkSession, path: str, folder: str, schema: T.StructType, partition: str | None = None) -> int:
    """Upserts the rows of a folder of Parquet files, which becomes a run as it is: rows as _write() takes them, each id once, laid out by `partition`.
    A folder that is not there has no rows. Returns the version.
    """
    fs, where = _files(spark, folder)
    if not fs.exists(where):
        return runs(spark, path)[0]
    run = Run(f"run-{uuid.uuid4().hex}", spark.read.schema(schema).parquet(folder).count(), schema.json(), partition)
    fs.mkdirs(_path(spark, path))
    if not fs.rename(where, _path(spark, f"{path}/{run.name}")):
        raise OSError(f"{folder} cannot be renamed to {path}/{run.name}")
    for _ in range(ATTEMPTS):
        version, found = runs(spark, path)
        try:
            commit(spark, path, version, [run, *found])
        except Conflict:
            continue
        return _merged(spark, path)
    raise Conflict(f"{ATTEMPTS} other writers were first at {path}")
