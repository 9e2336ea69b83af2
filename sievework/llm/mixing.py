"""Mixing sources to target weights.

Each source's words are laid end to end (documents by hash bucket, then doc_id) and cut into blocks of fixed
length. Every output shard draws its source counts from a multinomial with the sources' target shares, from a generator
of its own, so that a lost shard is drawn again alike. The draws decide how many blocks the mix takes: a source comes
near its target as multinomial counts do (a standard deviation of one by the root of its slots; small
sources have smaller blocks for that). A source's k-th slot, counted through the shards, maps through a pseudorandom
permutation of its block indexes (a keyed Feistel network, a new key each time the source begins again), and slots
meet blocks by index. mix_blocks() gives the shards themselves, mix_documents() the same blocks put together by document.

Targets: sources by code point, null last, weigh WEIGHTS in turn and share all words; a target stops at
MOST_REPEATS times its source's words and the excess is shared again by weight. A block is taken at most
MOST_REPEATS times (a slot drawn beyond that stays empty), so no document exceeds that either. A source whose target is
that many times its size has all its blocks so often, without a draw, and so meets its target exactly.

Defined results: null text has no words; null source is a source of its own; documents without words are never
taken; repeated rows are separate documents; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf
from pyspark.sql.window import Window

from .common import ASCII_SPACE, mix64, read_table, settled, stage, temp_name, utf8

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
#: Words in a block, but at most a 16384th of its source, so that small sources come near their targets too.
BLOCK_WORDS, LEAST_BLOCKS = 256, 1 << 14
#: Slots in an output shard; shards whose counts one task adds up; documents in a bucket about, and the fewest buckets.
SHARD_SLOTS, SHARD_GROUP, BUCKET_ROWS, BUCKETS = 4096, 4096, 50_000, 256
#: Sources up to which their table is broadcast; beyond, Spark chooses the join.
BROADCAST_SOURCES = 100_000
SEED = 20_24


@arrow_udf(T.LongType())
def count_words(text: pa.Array) -> pa.Array:
    return pa.array([len(x.split()) for x in utf8(text)], pa.int64())


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> list[float]:
    """sizes: words of each source in order. Its target words."""
    each = [weights[i % len(weights)] for i in range(len(sizes))]
    full: set[int] = set()
    while True:
        rest = sum(sizes) - most * sum(sizes[i] for i in full)
        share = sum(w for i, w in enumerate(each) if i not in full)
        goal = [float(most * s) if i in full else rest * w / share for i, (s, w) in enumerate(zip(sizes, each, strict=True))]
        over = {i for i, (g, s) in enumerate(zip(goal, sizes, strict=True)) if i not in full and g > most * s}
        if not over:
            return goal
        full |= over


def permute(index: np.ndarray, domain: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A permutation of range(domain) for each key: four Feistel rounds, walked until within the domain."""
    half = np.maximum(1, (np.frompyfunc(lambda n: (int(n) - 1).bit_length(), 1, 1)(domain).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = index.astype(np.uint64), np.arange(len(index))
    while len(todo):
        h, m, k = half[todo], mask[todo], key[todo]
        left, right = out[todo] >> h, out[todo] & m
        for turn in range(4):
            left, right = right, left ^ (mix64(right ^ mix64(k + np.uint64(turn))) & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= domain[todo].astype(np.uint64)]
    return out.astype(np.int64)


def _before(df: DataFrame, keys: list[str], group: Column, order: list, value: str, name: str) -> DataFrame:
    """df with the sum of value over all rows before, by keys; sums of groups first, so that no task adds up a whole key."""
    g = temp_name("group")
    df = df.withColumn(g, group)
    none = F.lit(0).cast("long")
    upto = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys, g).agg(F.sum(value).alias("n"))
    base = totals.select(*keys, g, F.coalesce(F.sum("n").over(upto(*keys).orderBy(g)), none).alias(f"{g}_n"))
    inner = F.coalesce(F.sum(value).over(upto(*keys, g).orderBy(*order)), none)
    return df.withColumn(name, inner).join(base, [*keys, g]).withColumn(name, F.col(name) + F.col(f"{g}_n")).drop(g, f"{g}_n")


def lay_out(docs: DataFrame) -> tuple[DataFrame, list[dict]]:
    """(row of every document: doc_id, source, h, size, idx, start; sources in order with their figures)."""
    sized = stage(docs.select("doc_id", "source", F.xxhash64("text").alias("h"), count_words("text").alias("size")), "mix-sizes")
    figures = sized.groupBy("source").agg(F.sum("size").alias("n"), F.count("*").alias("rows")).collect()  # one row a source
    found, rows = {r["source"]: r["n"] for r in figures}, sum(r["rows"] for r in figures)
    names = sorted(x for x in found if x is not None) + [None] * (None in found)
    goal = targets([found[x] for x in names])
    sources = []
    for i, (name, target) in enumerate(zip(names, goal, strict=True)):
        block = max(1, min(BLOCK_WORDS, found[name] // LEAST_BLOCKS))
        blocks, full = -(-found[name] // block), found[name] > 0 and target >= MOST_REPEATS * found[name]
        sources.append({"idx": i, "name": name, "size": found[name], "target": target, "block": block, "blocks": blocks, "full": full, "slots": MOST_REPEATS * blocks if full else round(target / block)})
    schema = "idx int, name string, source_size long, target double, block int"
    table = sized.sparkSession.createDataFrame([(s["idx"], s["name"], s["size"], s["target"], s["block"]) for s in sources], schema)
    if len(sources) <= BROADCAST_SOURCES:
        table = F.broadcast(table)
    alike = sized.groupBy("doc_id", "source", "h", "size").agg(F.count("*").alias("times")).withColumn("words", F.col("size") * F.col("times"))
    named = alike.join(table, alike["source"].eqNullSafe(table["name"])).drop("name")
    bucket = F.pmod(F.xxhash64("doc_id", "h"), F.lit(max(BUCKETS, rows // BUCKET_ROWS)))
    placed = _before(named, ["idx"], bucket, ["doc_id", "h", "size"], "words", "first")
    each = placed.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)))  # equal rows lie side by side
    return each.select("doc_id", "source", "h", "size", "idx", "source_size", "target", "block", (F.col("first") + F.col("copy") * F.col("size")).alias("start")), sources


def shard_counts(shard: int, slots: int, shares: np.ndarray, seed: int = SEED) -> np.ndarray:
    """An output shard's draw: how many of its slots each source gets."""
    return np.random.default_rng([seed, shard]).multinomial(slots, shares)


def dealt(slots: np.ndarray, low: int, high: int, total: int) -> np.ndarray:
    """Of slots that are dealt evenly over `total`, those between low and high."""
    slots = slots.astype(object)  # products may pass 64 bits
    return (slots * high // total - slots * low // total).astype(np.int64)


def draw_slots(spark: SparkSession, sources: list[dict], seed: int = SEED) -> DataFrame:
    """shard, slot (in the shard), idx, index (of a block): one row for each block that the mix takes.

    A source that stops at MOST_REPEATS times its size has each block so often, for certain: its slots are dealt evenly to
    the shards. The other slots of a shard are drawn among the other sources.
    """
    some = [s for s in sources if s["slots"]]
    index, slots, full = np.array([s["idx"] for s in some], np.int32), np.array([s["slots"] for s in some], np.int64), np.array([s["full"] for s in some], bool)
    total, drawn = int(slots.sum()), int(slots[~full].sum())
    shares, blocks = slots[~full] / max(1, drawn), np.array([s["blocks"] for s in sources], np.int64)
    schema = "shard long, idx int, n long, slot long"

    def of(shard: int) -> np.ndarray:
        low, high = shard * SHARD_SLOTS, min(total, (shard + 1) * SHARD_SLOTS)
        n = dealt(slots, low, high, total)
        if drawn:
            n[~full] = shard_counts(shard, int(dealt(np.array([drawn]), low, high, total)[0]), shares, seed)
        return n

    def draw(batches):
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                n = of(shard)
                at = np.flatnonzero(n)
                columns = (np.full(len(at), shard), index[at], n[at], (np.cumsum(n) - n)[at])
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["shard", "idx", "n", "slot"])

    def fill(batches):
        for batch in batches:
            shard, idx, n, slot, before = (batch.column(c).to_numpy() for c in ("shard", "idx", "n", "slot", "before"))
            row = np.repeat(np.arange(len(n)), n)
            j = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            k, size = before[row] + j, blocks[idx][row]
            keep = k < MOST_REPEATS * size
            row, j, k, size = row[keep], j[keep], k[keep], size[keep]
            key = mix64(np.uint64(seed) + mix64(idx[row].astype(np.uint64) << np.uint64(8) | (k // size).astype(np.uint64)))
            columns = (shard[row], slot[row] + j, idx[row], permute(k % size, size, key))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["shard", "slot", "idx", "index"])

    counts = spark.range(-(-total // SHARD_SLOTS)).mapInArrow(draw, schema)
    told = _before(counts, ["idx"], F.floor(F.col("shard") / SHARD_GROUP), ["shard"], "n", "before")
    return told.select("shard", "idx", "n", "slot", "before").mapInArrow(fill, "shard long, slot long, idx int, index long")


def _in_blocks(placed: DataFrame) -> DataFrame:
    """Every document with words, once for each block that it lies in; lo, hi: its words there."""
    first, last = F.floor(F.col("start") / F.col("block")), F.floor((F.col("start") + F.col("size") - 1) / F.col("block"))
    each = placed.where("size > 0").withColumn("index", F.explode(F.sequence(first, last)))
    lo, hi = F.greatest("start", F.col("index") * F.col("block")), F.least(F.col("start") + F.col("size"), (F.col("index") + 1) * F.col("block"))
    return each.withColumns({"lo": lo - F.col("start"), "hi": hi - F.col("start")})


def _block_parts(placed: DataFrame, sources: list[dict]) -> DataFrame:
    """_in_blocks() with the times that the mix takes the block and the first shard that does."""
    taken = draw_slots(placed.sparkSession, sources).groupBy("idx", "index").agg(F.count("*").alias("times"), F.min("shard").alias("shard"))
    return _in_blocks(placed).join(taken, ["idx", "index"], "left").withColumn("times", F.coalesce("times", F.lit(0)))


def mix_blocks(docs: DataFrame) -> DataFrame:
    """The mix by output shard: shard, slot (the order in it), place (in the block), source, doc_id, lo, hi (words of the document)."""
    placed, sources = lay_out(docs)
    placed = stage(placed, "mix-layout")
    parts = _in_blocks(placed).join(draw_slots(docs.sparkSession, sources), ["idx", "index"])
    return parts.select("shard", "slot", F.greatest(F.lit(0), F.col("start") - F.col("index") * F.col("block")).alias("place"), "source", "doc_id", "lo", "hi")


def mix_amounts(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, first_shard (the first with some of it): one row for each row of docs."""
    placed, sources = lay_out(docs)
    placed = stage(placed, "mix-layout")
    keys = ["doc_id", "source", "size", "source_size", "target", "idx", "start"]
    some = _block_parts(placed, sources).groupBy(*keys).agg(F.sum((F.col("hi") - F.col("lo")) * F.col("times")).alias("taken"), F.min("shard").alias("first_shard"))
    none = placed.where("size = 0").select(*keys, F.lit(0).cast("long").alias("taken"), F.lit(None).cast("long").alias("first_shard"))
    return some.unionByName(none).drop("idx", "start")


_WORD = f"[^{ASCII_SPACE}]+"


def mix_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents: a row for each time that (part of) a document is taken, with all its columns.

    Its n-th row holds the words of the blocks taken n times or more: the text as it is where those are all its words,
    else the words joined by spaces, with n_chars, where there is one, counted anew.
    """
    placed, sources = lay_out(docs)
    placed = stage(placed, "mix-layout")
    parts = _block_parts(placed, sources).where("times > 0")
    span = F.struct(F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"), F.col("times").cast("int").alias("times"))
    whole = parts.groupBy("doc_id", "h", "idx", "start", "size").agg(F.sort_array(F.collect_list(span)).alias("spans"))
    # identical rows (same doc_id and text) share a key; each keeps its own spans
    number = Window.partitionBy("doc_id", "h").orderBy("idx", "start")
    numbered = whole.select("doc_id", "h", "idx", F.row_number().over(number).alias("copy"), "spans")
    plan = stage(numbered, "mix-plan")
    key, text, spans, copy, turn = (temp_name(x) for x in ("key", "text", "spans", "copy", "turn"))

    @arrow_udf(T.StringType())
    def taken(column: pa.Array, spans: pa.Array, turn: pa.Array) -> pa.Array:
        out = []
        for raw, parts, t in zip(utf8(column), spans.to_pylist(), turn.to_pylist(), strict=True):
            words = raw.split()
            got = [w for x in parts if x["times"] >= t for w in words[x["lo"] : x["hi"]]]
            out.append((raw if len(got) == len(words) else b" ".join(got)).decode())
        return pa.array(out, pa.string())

    keyed = docs.withColumn(key, F.xxhash64("text"))
    if plan.where("copy > 1").isEmpty():
        numbered_docs = keyed.withColumn(copy, F.lit(1))
    else:
        numbered_docs = keyed.withColumn(copy, F.row_number().over(Window.partitionBy("doc_id", key).orderBy(F.col("source").asc_nulls_last())))
    right = plan.select(F.col("doc_id").alias(f"{key}_d"), F.col("h").alias(f"{key}_h"), F.col("copy").alias(f"{key}_c"), F.col("spans").alias(spans))
    on = numbered_docs["doc_id"].eqNullSafe(right[f"{key}_d"]) & (numbered_docs[key] == right[f"{key}_h"]) & (numbered_docs[copy] == right[f"{key}_c"])
    most = F.aggregate(spans, F.lit(0), lambda a, x: F.greatest(a, x["times"]))
    rows = numbered_docs.join(right, on).withColumn(turn, F.explode(F.sequence(F.lit(1), most)))
    done = rows.withColumn(text, taken("text", spans, turn))
    counted = {"n_chars": F.when(F.col(text) == F.col("text"), F.col("n_chars")).otherwise(F.length(text).cast(docs.schema["n_chars"].dataType))} if "n_chars" in docs.columns else {}
    return done.withColumns(counted).withColumn("text", F.col(text)).select(*docs.columns)


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(spark, "op4", lambda: mix_amounts(read_table(spark, sf_dir, "documents")).drop("source"))
