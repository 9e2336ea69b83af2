"""Suffix dedup on bytes: merged Burrows-Wheeler transforms of shards.

1. Texts that are equal as a whole become one, the earliest.
2. Every WINDOW-byte string is known by its minimizer, the least hash of its GRAM-byte substrings. Documents name their
   minimizers; strings whose minimizer no other document has stand in one document only and take no further part.
3. What is left are regions. Regions are cut at places that the minimizers choose, into stretches that copies share; equal
   stretches become one, with the earliest document that has it. Later ones are repeats as a whole.
4. Stretches are cut into segments, each the bytes under a run of strings with one minimizer, and go to buckets by minimizer.
   A bucket deals its segments to SHARDS shards. Each shard has its Burrows-Wheeler transform, and the transforms are
   merged by refinement of their interleave: step t orders the suffixes by t symbols, from the order of step t-1 and
   the transforms alone. Neighbours that step t parts have t-1 symbols in common, so intervals that hold together
   through WINDOW steps are the repeated strings, and each learns the earliest document of its interval. An
   interval with one document only can hold no repeat; its suffixes leave the refinement as soon as that shows.
5. Bytes under strings that an earlier document has go.

Hot keys: of the rows with one minimizer or one stretch, a batch of texts sends one, so a key has at most as many rows as
there are batches. A minimizer with over HOT different segments is dealt again, each of its strings alone, by string.

Defined results: null and empty texts have no bytes; texts under WINDOW bytes lose none; rows with equal doc_id,
and null ones (first of all), go in the order of their text, and a repeated row repeats all; an empty table
gives an empty result; other columns are not read. Cuts are made between bytes, so kept bytes need not be whole characters.
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import drop, first_in_batch, mix64, read_table, settled, slices, stage, utf8
from .substring_dedup import Sums, in_order, spans_of

WINDOW, GRAM = 50, 20
#: Different segments of one minimizer beyond which its strings are dealt one by one.
HOT = 8000
#: Windows in a segment and in a stretch at most, bytes of segments in a bucket about, shards in a bucket.
SEGMENT, STRETCH, BUCKET_BYTES, SHARDS = 64, 512, 1 << 20, 4
#: One in so many minimizers begins a stretch.
CUT = 8
#: Bytes of text that a task works on at once (or one text).
TEXT_BYTES = 1 << 20

_U = np.uint64
#: Odd multipliers and their inverses modulo 2**64.
_P, _Q = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F)
_PI, _QI = (_U(pow(int(p), -1, 1 << 64)) for p in (_P, _Q))
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64))


class Runs:
    """Texts laid end to end, and their runs of windows with one minimizer: start, n (windows), name, row (of the text)."""

    def __init__(self, texts: list[bytes], window: int, gram: int):
        self.raw, self.sums = b"".join(texts), None
        self.bounds = np.cumsum([0, *map(len, texts)])
        self.x = _BYTE[np.frombuffer(self.raw, np.uint8)]
        places = len(self.x) - window + 1
        if places < 1:
            self.start = self.n = self.row = np.zeros(0, np.int64)
            self.name = np.zeros(0, np.uint64)
            return
        self.sums = Sums(self.x, _P, _PI)
        least, span, wide = self.sums.rolling(gram), 1, window - gram + 1
        while span < wide:
            step = min(span, wide - span)
            least = np.minimum(least[:-step], least[step:])
            span += step
        whole = np.zeros(places + window, bool)  # windows within one text
        for a, b in pairwise(self.bounds.tolist()):
            whole[a : max(a, b - window + 1)] = True
        whole = whole[:places]
        edge = np.ones(places, bool)
        edge[1:] = (least[1:] != least[:-1]) | (whole[1:] != whole[:-1])
        edge[self.bounds[self.bounds < places]] = True
        starts = np.flatnonzero(edge)
        n, ok = np.diff(starts, append=places), whole[starts]
        self.start, self.n = starts[ok], n[ok]
        self.name = least[self.start]
        self.row = np.searchsorted(self.bounds, self.start, "right") - 1


def _longs(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return batch.column(column).to_numpy(zero_copy_only=False).astype(np.int64)


def _rows(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()], names=list(columns))


def shared_minimizers(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """d, names: minimizers that another document has too."""

    def name(batches):
        for whole in batches:
            for batch in slices(whole, "text", TEXT_BYTES):
                runs = Runs(utf8(batch.column("text")), window, gram)
                who = _longs(batch, "d")[runs.row]
                ask, later, least = first_in_batch(who, runs.name)
                told = np.concatenate([later, least])
                names, d = runs.name.view(np.int64), who
                key = np.concatenate([names[ask], mix64(d[told].view(np.uint64)).view(np.int64)])
                at = np.concatenate([ask, told])
                yield _rows(key=key, name=names[at], d=d[at], told=np.arange(len(at)) >= len(ask))

    named = docs.select("d", "text").mapInArrow(name, "key long, name long, d long, told boolean")
    same = Window.partitionBy("key").orderBy("d")  # told rows have their document for key: they only travel with the rest
    near = named.withColumns({"before": F.lag("d").over(same), "after": F.lead("d").over(same)})
    shared = near.where("told or before <> d or after <> d")
    return shared.groupBy("d").agg(F.collect_list("name").alias("names"))


def stretches(docs: DataFrame, shared: DataFrame, window: int, gram: int) -> DataFrame:
    """d, at, n (windows), h1, h2, bytes, later: stretches of windows with shared minimizers.

    Of equal ones in a batch, the first of the least document has the bytes, that document's other ones have none, and
    those of other documents are known to be later ones.
    """

    def cut(batches):
        for whole in batches:
            for batch in slices(whole, "text", TEXT_BYTES):
                runs = Runs(utf8(batch.column("text")), window, gram)
                names = batch.column("names")
                of = np.repeat(np.arange(len(names)), names.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                salt = lambda name, row: name + mix64(row.astype(np.uint64))
                ok = np.isin(salt(runs.name, runs.row), salt(names.flatten().to_numpy().view(np.uint64), of))
                start, n, row, name = (x[ok] for x in (runs.start, runs.n, runs.row, runs.name))
                new = np.ones(len(start), bool)
                new[1:] = (start[1:] != start[:-1] + n[:-1]) | (row[1:] != row[:-1]) | (mix64(name[1:]) % _U(CUT) == 0)
                first = np.flatnonzero(new)
                total = np.add.reduceat(n, first) if len(first) else n
                parts = -(-total // STRETCH)
                k = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
                a = np.repeat(start[first], parts) + k * STRETCH
                n = np.minimum(STRETCH, np.repeat(total, parts) - k * STRETCH)
                row = np.repeat(row[first], parts)
                b = a + n + window - 1
                h1, h2 = (sums.of(a, b) if len(a) else runs.name[:0] for sums in (runs.sums, Sums(mix64(runs.x), _Q, _QI) if len(a) else None))
                who = _longs(batch, "d")[row]
                ask, later, _ = first_in_batch(who, h1, h2)
                state = np.zeros(len(a), np.int8)  # 0: again in the least document
                state[ask], state[later] = 1, 2
                if len(later):  # further places in later documents are later, too
                    order = np.lexsort((who, h1, h2))
                    head = np.append(True, (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1]))
                    least = np.repeat(who[order][head], np.diff(np.flatnonzero(head), append=len(order)))
                    state[order[who[order] != least]] = 2
                held = [runs.raw[i:j] if s == 1 else None for i, j, s in zip(a.tolist(), b.tolist(), state.tolist(), strict=True)]
                yield _rows(d=who, at=(a - runs.bounds[row]).astype(np.int32), n=n.astype(np.int32), h1=h1.view(np.int64), h2=h2.view(np.int64), bytes=pa.array(held, pa.binary()), later=state == 2)

    joined = docs.select("d", "text").join(shared.hint("shuffle_hash"), "d")
    return joined.mapInArrow(cut, "d long, at int, n int, h1 long, h2 long, bytes binary, later boolean")


def segments(own: DataFrame, window: int, gram: int) -> DataFrame:
    """own: distinct stretches (d, h1, h2, bytes). d, h1, h2, at (in the stretch), name, bytes: runs of strings with one minimizer."""

    def cut(batches):
        for whole in batches:
            for batch in slices(whole, "bytes", TEXT_BYTES):
                runs = Runs(batch.column("bytes").to_pylist(), window, gram)
                parts = -(-runs.n // SEGMENT)
                k = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
                a = np.repeat(runs.start, parts) + k * SEGMENT
                b = a + np.minimum(SEGMENT, np.repeat(runs.n, parts) - k * SEGMENT) + window - 1
                row = np.repeat(runs.row, parts)
                held = [runs.raw[i:j] for i, j in zip(a.tolist(), b.tolist(), strict=True)]
                of = {c: _longs(batch, c)[row] for c in ("d", "h1", "h2")}
                yield _rows(**of, at=(a - runs.bounds[row]).astype(np.int32), name=np.repeat(runs.name, parts).view(np.int64), bytes=pa.array(held, pa.binary()))

    return own.select("d", "h1", "h2", "bytes").mapInArrow(cut, "d long, h1 long, h2 long, at int, name long, bytes binary")


def _ranks(key: np.ndarray) -> np.ndarray:
    order = np.argsort(key)  # equal keys have one rank, in any order
    out = np.empty(len(key), np.uint64)
    out[order] = np.cumsum(np.append(False, key[order][1:] != key[order][:-1])[: len(key)])
    return out


def transform(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix places in the order of their first `depth` symbols, and the symbol before each (the transform)."""
    n, span = len(text), 8
    ahead = lambda x, k: np.append(x[k:], np.zeros(min(k, n), x.dtype))
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = key << _U(8) | ahead(text, k).astype(np.uint64)
    rank = _ranks(key)
    while span < depth:  # ranks by 8, 16, 32, ... symbols
        step = min(span, depth - span)
        rank = _ranks(rank << _U(32) | ahead(rank, step))
        span += step
    order = np.argsort(rank)
    return order, np.append(text[-1:], text[:-1])[order]


def merge(shards: list[tuple[np.ndarray, np.ndarray]], docs: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """shards: (suffix places, symbols before them) of texts whose parts end with symbol 0; docs: the document of every place
    of the texts laid end to end. The places, in order by `depth` symbols, whose string of that length several documents
    have, and the number of each one's interval.
    """
    before = np.concatenate([symbols for _, symbols in shards])
    kind = np.int32 if len(before) < 1 << 31 else np.int64
    place, base, into = np.empty(len(before), np.int64), 0, np.empty(len(before), kind)
    for order, _ in shards:  # where in the shard's order the suffix that begins one symbol earlier is
        of = np.empty(len(order), kind)
        of[order] = np.arange(len(order)) + base
        into[base : base + len(order)] = of[order - 1]
        place[base : base + len(order)] = order + base
        base += len(order)
    who = docs[place]
    at, interval = np.arange(len(before), dtype=kind), np.zeros(len(before), kind)
    for _ in range(depth):
        symbol = before[at]
        inside = symbol != 0
        at, interval, symbol = at[inside], interval[inside], symbol[inside]
        order = np.argsort(symbol, kind="stable")
        at, interval, symbol = into[at[order]], interval[order], symbol[order]
        new = np.ones(len(at), bool)
        new[1:] = (interval[1:] != interval[:-1]) | (symbol[1:] != symbol[:-1])
        starts = np.flatnonzero(new)
        if not len(starts):
            break
        d = who[at]
        several = np.minimum.reduceat(d, starts) != np.maximum.reduceat(d, starts)
        keep = np.repeat(several, np.diff(starts, append=len(at)))
        at, interval = at[keep], np.cumsum(new, dtype=kind)[keep]
    return place[at], interval


def earliest(parts: list[bytes], least: np.ndarray, window: int) -> list[np.ndarray]:
    """parts: a bucket's segments; least: the earliest document of each. Of every string in a part: its earliest document."""
    if not parts:
        return []
    shards, base = [], 0
    for k in range(min(SHARDS, len(parts))):
        text = np.frombuffer(b"".join(x + b"\xff" for x in parts[k::SHARDS]), np.uint8) + np.uint8(1)  # an end is 0; UTF-8 has no byte 255
        shards.append(transform(text, window))
    dealt = [p for k in range(len(shards)) for p in range(k, len(parts), SHARDS)]
    sizes = np.array([len(parts[p]) + 1 for p in dealt], np.int64)
    known, code = np.unique(least[dealt], return_inverse=True)
    docs = np.repeat(code.astype(np.int32), sizes)  # numbers of documents in their order
    first = docs.copy()
    at, interval = merge(shards, docs, window)
    if len(at):
        starts = np.flatnonzero(np.append(True, interval[1:] != interval[:-1]))
        first[at] = np.repeat(np.minimum.reduceat(docs[at], starts), np.diff(starts, append=len(at)))
    first = known[first]
    out = [first[:0]] * len(parts)
    for p, n in zip(dealt, sizes.tolist(), strict=True):
        out[p] = first[base : base + n - window]
        base += n
    return out


def repeated_strings(cut: DataFrame, window: int) -> DataFrame:
    """cut: segments(), staged. h1, h2, start, n: runs of strings of a stretch that an earlier document has."""
    spark = cut.sparkSession
    hot = stage(cut.groupBy("name").agg(F.count("*").alias("k")).where(F.col("k") > HOT).select("name"), "suffix-hot")
    total = cut.agg(F.sum(F.length("bytes"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_BYTES))
    crowded = not hot.isEmpty()
    usual = cut.join(hot, "name", "left_anti") if crowded else cut

    def refine(table: pa.Table) -> pa.Table:
        number: dict[bytes, int] = {}
        of = np.array([number.setdefault(x, len(number)) for x in table.column("bytes").to_pylist()], np.int64)
        parts, d, name = list(number), table.column("d").to_numpy(), table.column("name").to_numpy()
        least = np.full(len(parts), np.iinfo(np.int64).max)
        np.minimum.at(least, of, d)
        named = np.empty(len(parts), np.int64)
        named[of] = name
        _, group = np.unique(named, return_inverse=True)
        lo, hi = np.full(len(parts), np.iinfo(np.int64).max), np.full(len(parts), np.iinfo(np.int64).min)
        np.minimum.at(lo, group, least)
        np.maximum.at(hi, group, least)
        several = np.flatnonzero(lo[group] != hi[group])  # segments of different documents under one minimizer
        n = np.array([len(x) - window + 1 for x in parts], np.int64)
        first = [np.full(k, x) for k, x in zip(n.tolist(), least.tolist(), strict=True)]
        for k, x in zip(several.tolist(), earliest([parts[k] for k in several], least[several], window), strict=True):
            first[k] = x
        flat, begin = np.concatenate([*first, least[:0]]), np.cumsum(n) - n
        times = n[of]  # strings of each row, then of all rows end to end
        base = np.cumsum(times) - times
        row = np.repeat(np.arange(len(of)), times)
        k = np.arange(len(row)) - base[row]
        hit = np.append(flat[begin[of][row] + k] < d[row], False)
        opens = np.flatnonzero(hit[:-1] & (~np.append(False, hit[:-2]) | (k == 0)))
        ends = np.flatnonzero(hit[:-1] & (~hit[1:] | (np.append(k, 0)[1:] == 0)))
        owner = row[opens]
        pick = {c: table.column(c).to_numpy()[owner] for c in ("h1", "h2", "at")}
        return pa.table({"h1": pick["h1"], "h2": pick["h2"], "start": (pick["at"] + k[opens]).astype(np.int32), "n": (ends - opens + 1).astype(np.int32)})

    found = usual.withColumn("bucket", F.pmod(F.col("name"), F.lit(buckets))).groupBy("bucket").applyInArrow(refine, "h1 long, h2 long, start int, n int")
    if not crowded:
        return found
    alone = F.transform(F.sequence(F.lit(1), F.length("bytes") - window + 1), lambda i: F.substring("bytes", i, F.lit(window)))
    dealt = cut.join(hot, "name", "left_semi").select("d", "h1", "h2", "at", F.posexplode(alone).alias("k", "string"))
    first = dealt.groupBy("string").agg(F.min("d").alias("first"))
    told = dealt.join(first, "string").where("first < d").select("h1", "h2", (F.col("at") + F.col("k")).alias("start"), F.lit(1).alias("n"))
    return found.unionByName(told)


def repeats(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """texts: d, text (distinct). d, at: structs (start, n) of windows that an earlier document has."""
    shared = stage(shared_minimizers(texts, window, gram), "suffix-shared", free=True)
    cut = stage(stretches(texts, shared, window, gram), "suffix-stretches", free=True)
    drop(shared)
    asked = cut.where("not later")
    first = asked.groupBy("h1", "h2").agg(F.min("d").alias("least"))
    marked = asked.join(first, ["h1", "h2"]).select("h1", "h2", "d", "at", "n", (F.col("d") > F.col("least")).alias("later"), F.when(F.col("d") == F.col("least"), F.col("bytes")).alias("bytes"))
    marked = stage(marked, "suffix-marked", free=True)
    pieces = stage(segments(marked.where("bytes is not null"), window, gram), "suffix-segments")
    inside = stage(repeated_strings(pieces, window), "suffix-repeats", free=True)
    drop(pieces)
    here = marked.where("not later").select("h1", "h2", "d", "at").join(inside, ["h1", "h2"]).select("d", (F.col("at") + F.col("start")).alias("start"), "n")
    wholes = [x.where("later").select("d", F.col("at").alias("start"), "n") for x in (cut, marked)]
    return here.unionByName(wholes[0]).unionByName(wholes[1]).groupBy("d").agg(F.collect_list(F.struct("start", "n")).alias("at"))


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, spans (of removed bytes), kept (binary): one row for each row of docs."""
    ordered = in_order(docs)
    tags = ordered.select("d", F.octet_length("text").alias("size"), F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2")).where(F.col("size") >= window)
    least = tags.groupBy("t1", "t2", "size").agg(F.min("d").alias("least"))
    copies = stage(tags.join(least, ["t1", "t2", "size"]).where("d > least").select("d"), "suffix-copies")
    texts = ordered.where(F.octet_length("text") >= window).join(copies, "d", "left_anti")  # Spark broadcasts the ids if they are small
    at = stage(repeats(texts, window, gram), "suffix-spans", free=True)
    known = at.unionByName(copies.select("d", F.array(F.struct(F.lit(0).alias("start"), F.lit(-1).alias("n"))).alias("at")))

    def apart(batches):
        for whole in batches:
            for batch in slices(whole, "text", TEXT_BYTES):
                spans, kept, texts = [], [], utf8(batch.column("text"))
                for raw, at in zip(texts, batch.column("at"), strict=True):
                    done = np.zeros(len(raw), bool)
                    if at.is_valid:
                        start, n = (at.values.field(k).to_numpy() for k in (0, 1))
                        edge = np.zeros(len(raw) + 1, np.int32)
                        np.add.at(edge, start, 1)
                        np.add.at(edge, np.where(n < 0, max(0, len(raw) - window + 1), start + n), -1)  # -1: all windows
                        done = np.cumsum(edge)[:-1] > 0
                    spans.append(spans_of(done, window))
                    edges = [0, *(x for s in spans[-1] for x in s), len(raw)]
                    kept.append(b"".join(raw[a:b] for a, b in list(pairwise(edges))[::2]))
                pair = pa.struct([("start", pa.int64()), ("end", pa.int64())])
                yield _rows(doc_id=batch.column("doc_id"), n_bytes=pa.array(list(map(len, texts)), pa.int64()), spans=pa.array([[{"start": a, "end": b} for a, b in x] for x in spans], pa.list_(pair)), kept=pa.array(kept, pa.binary()))

    joined = ordered.join(known.hint("shuffle_hash"), "d", "left").select("doc_id", "text", "at")
    return joined.mapInArrow(apart, "doc_id long, n_bytes long, spans array<struct<start: bigint, end: bigint>>, kept binary")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    def digests() -> DataFrame:
        found = remove_repeats(read_table(spark, sf_dir, "documents"))
        removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
        return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))

    return settled(spark, "op9", digests)
