"""Document fingerprints by locally consistent parsing.

Runs of one symbol are named first. Deterministic coin tossing then gives each symbol a small label from the
lowest bit in which it differs from its left neighbour, again and again until a handful of labels are left; a phrase
begins at each local maximum. A phrase's name is a hash of its symbols, and names are the next level's
symbols. Whether a phrase begins depends on a few symbols around it alone, so equal substrings have equal
names inside, wherever they stand. A fingerprint holds the KEPT smallest names of levels 1 to 3
(phrases of about 3, 12 and 40 characters); likeness is the share of common names among the
smallest of both, at the highest level that has LEAST names in both.

Defined results: null text is empty; empty texts have an empty fingerprint, alike to each other (1) and to no
other (0); repeated rows and doc_ids are ordered by the text's hash; a single document is its own next one; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mix64, read_table, utf8

#: Names kept of each level, lowest level first, and those that both need for a level to count.
KEPT = (8, 24, 32)
LEAST = (1, 6, 8)
TOSSES = 3
#: Code points parsed at a time (at least one text).
PARSED = 1 << 19


def _below(x: np.ndarray) -> np.ndarray:
    """Zeros below the lowest set bit."""
    return np.bitwise_count((x & (~x + np.asarray(1, x.dtype))) - np.asarray(1, x.dtype))


def parse_level(x: np.ndarray, doc: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and their documents -> the names of their phrases and their documents."""
    first = np.empty(len(x), bool)
    first[:1] = True
    np.not_equal(doc[1:], doc[:-1], out=first[1:])
    starts = first.copy()
    starts[1:] |= x[1:] != x[:-1]
    at = np.flatnonzero(starts)
    if len(at) < len(x):  # runs
        length = np.diff(at, append=len(x))
        x, doc, first = x[at], doc[at], first[at]
        long = length > 1
        x = x.copy()
        x[long] = mix64(x[long] + length[long].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    label = x
    for _ in range(TOSSES):
        low = _below(label[1:] ^ label[:-1]).astype(np.uint8)  # as wide as the type where equal, which only a text's first can be
        bit = ((label[1:] >> low.astype(label.dtype)) & np.asarray(1, label.dtype)).astype(np.uint8)
        new = np.empty(len(label), np.uint8)
        new[:1], new[1:] = 0, 2 * low + bit
        new[first] = (label[first] & np.asarray(1, label.dtype)).astype(np.uint8)
        label = new
    peak, after = first.copy(), np.append(label[1:], label[:1])[: len(label)]
    after[np.append(first[1:], True)[: len(label)]] = 0  # nothing follows a text's last symbol
    peak[1:] |= (label[1:] > label[:-1]) & (label[1:] >= after[1:])
    at = np.flatnonzero(peak)
    place = (np.arange(len(x)) - np.repeat(at, np.diff(at, append=len(x)))).astype(np.uint64)
    names = np.add.reduceat(mix64(x + place * np.uint64(0xD6E8FEB86659FD93)), at) if len(at) else np.zeros(0, np.uint64)
    return mix64(names + np.uint64(level)), doc[at]


def sketch(texts: list[str]) -> list[str]:
    """The fingerprint of each text: levels parted by '.', names of 8 hex digits in order."""
    x = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) for t in texts])
    x = mix64(x + np.uint64(1))
    levels = []
    for level, kept in enumerate(KEPT, 1):
        x, doc = parse_level(x, doc, level)
        bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
        levels.append(["".join(map("%08x".__mod__, np.unique(x[a:b] >> np.uint64(32))[:kept])) for a, b in zip(bounds[:-1], bounds[1:], strict=True)])
    return [".".join(p) if t else "" for t, *p in zip(texts, *levels, strict=True)]


def likeness(one: str, other: str) -> float:
    """From 0 to 1; of two fingerprints of sketch()."""
    if one == other:
        return 1.0
    if not one or not other:
        return 0.0
    pairs = [({p[i : i + 8] for i in range(0, len(p), 8)}, {q[i : i + 8] for i in range(0, len(q), 8)}) for p, q in zip(one.split("."), other.split("."), strict=True)]
    for k in range(len(KEPT) - 1, -1, -1):
        a, b = pairs[k]
        if min(len(a), len(b)) >= LEAST[k] or not k:
            least = sorted(a | b)[: KEPT[k]]
            return len(a.intersection(least) & b) / len(least) if least else 0.0
    return 0.0


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of every row of docs."""

    def run(batches):
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), [x.decode() for x in utf8(batch.column("text"))]
            for a, b in _chunks(list(map(len, texts))):
                yield pa.RecordBatch.from_arrays([pa.array(ids[a:b], pa.int64()), pa.array(sketch(texts[a:b]), pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fingerprint string")


def _chunks(sizes: list[int]):
    a = total = 0
    for b, n in enumerate(sizes):
        if total and total + n > PARSED:
            yield a, b
            a, total = b, 0
        total += n
    if sizes:
        yield a, len(sizes)


def in_descending_order(docs: DataFrame) -> DataFrame:
    """docs dealt by ranges of doc_id, one range a partition, in descending order (null last), each followed by the
    document that comes next in the next range (own = 1). The texts are shuffled once; the driver sees one doc_id a range.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    bounds = sorted(set(ids.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 1 / (4 * parts)))) if parts > 1 else []

    @F.arrow_udf(T.IntegerType())
    def range_of(doc_id: pa.Array) -> pa.Array:
        place = np.searchsorted(bounds, doc_id.fill_null(0).to_numpy(zero_copy_only=False), "right")
        return pa.array(np.where(doc_id.is_null().to_numpy(zero_copy_only=False), 0, place).astype(np.int32))

    tops = {r["r"]: r["top"] for r in ids.select("doc_id", range_of("doc_id").alias("r")).groupBy("r").agg(F.max("doc_id").alias("top")).collect()}
    order = sorted(tops)
    ends = [(r, order[(i + 1) % len(order)], tops[r]) for i, r in enumerate(order)]  # the top document of range r also ends the range `lead`
    table = F.broadcast(spark.createDataFrame(ends, "r int, lead int, top long"))  # a row a range
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("r", range_of("doc_id")).join(table, "r")
    copies = F.array(F.struct(F.col("r").alias("target"), F.lit(0).alias("own")), F.when(F.col("doc_id").eqNullSafe(F.col("top")), F.struct(F.col("lead").alias("target"), F.lit(1).alias("own"))))
    dealt = own.select("doc_id", "text", F.inline(F.filter(copies, lambda x: x.isNotNull())))
    return dealt.repartitionById(len(bounds) + 1, "target").sortWithinPartitions("target", "own", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"))


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """The contract's rows: each text, its edited text, and the likenesses of their fingerprints."""
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def emit(rows):
        texts = [r[1] for r in rows]
        edited = [t[: len(t) - len(t) // 3] + n[: len(t) // 3] for t, n in zip(texts, texts[1:], strict=False)]
        found = sketch(texts)
        changed = sketch(edited)
        columns = [
            pa.array([r[0] for r in rows[:-1]], pa.int64()),
            pa.array(list(map(len, texts[:-1])), pa.int64()),
            pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited], pa.string()),
            pa.array(found[:-1], pa.string()),
            pa.array(changed, pa.string()),
            pa.array(list(map(likeness, found, changed)), pa.float64()),
            pa.array(list(map(likeness, found, found[1:])), pa.float64()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in schema.split(", ")])

    def run(batches):
        held, chars, ended = [], 0, False
        for batch in batches:
            for doc_id, raw, extra in zip(batch.column("doc_id").to_pylist(), utf8(batch.column("text")), batch.column("own").to_pylist(), strict=True):
                if extra and ended:
                    continue  # more rows of the same doc_id
                ended = bool(extra)
                held.append((doc_id, raw.decode()))
                chars += len(held[-1][1])
                if len(held) > 1 and chars > PARSED:
                    yield emit(held)
                    held = held[-1:]
                    chars = len(held[0][1])
        if len(held) > 1:
            yield emit(held)

    return in_descending_order(docs).mapInArrow(run, schema)


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_edits(read_table(spark, sf_dir, "documents"))
