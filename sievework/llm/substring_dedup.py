"""Substring dedup on words by recompression.

Every text is parsed in rounds: runs of one symbol get a name, then each symbol falls in one of two classes by
its name and every left-class symbol merges with a right-class one behind it. Names are hashes of what they
stand for, so all executors give equal substrings equal names without asking one another, and the same few
symbols around a place decide how it is parsed.

Spark rounds then work on names that documents share:
1. Every window of WINDOW words is known by an anchor, a low symbol that depends on words of the window alone (by
   highest round, then by hash), and every stretch of two neighbouring high symbols by its name and a second hash.
   Each document names its anchors and stretches; names are grouped, and each document learns which anchors
   others have too and which stretches begin in an earlier document.
2. Windows inside such a stretch are repeats. Of the rest, those with a shared anchor are compared by
   two independent 64-bit hashes of all their words; all but the first are repeats.
3. Words under repeated windows go.

Windows without an anchor (one word over and over) are named by their own hash. Nothing is capped. Hot keys: of the rows
with one name, or one window's hashes, a batch of texts sends only its earliest document's to the other batches and
answers the rest itself, so a key has at most as many rows as there are batches.

Defined results: null and empty texts have no words; texts under WINDOW words lose none; rows with equal doc_id,
and null ones (first of all), go in the order of their text, and a repeated row repeats all; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import first_in_batch, mix64, read_table, settled, slices, stage, utf8

WINDOW = 20
#: Rounds whose symbols serve as anchors, and rounds until the high symbols (about 40 words long).
ANCHOR_ROUNDS, ROUNDS = 4, 13

_U = np.uint64
_P1, _P2 = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)  # odd
_I1, _I2 = (_U(pow(int(p), -1, 1 << 64)) for p in (_P1, _P2))


_known: dict[int, np.ndarray] = {}


def _powers(p: np.uint64, n: int) -> np.ndarray:
    """p to the powers 0 to n; up to 2**20 they are made once."""
    most = 1 << 20
    if n <= most and int(p) in _known:
        return _known[int(p)][: n + 1]
    out = np.full(max(n, most) + 1, p, np.uint64)
    out[0] = 1
    out = np.multiply.accumulate(out)
    if n <= most:
        _known[int(p)] = out
    return out[: n + 1]


class Sums:
    """Hashes of any stretch of words: prefix sums of word hashes times powers, modulo 2**64."""

    def __init__(self, words: np.ndarray, p: np.uint64, inverse: np.uint64):
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * _powers(p, len(words))[:-1], dtype=np.uint64)])
        self.inverse = _powers(inverse, len(words))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))

    def rolling(self, size: int) -> np.ndarray:
        """of() for every stretch of one size."""
        total = self.sums[size:] - self.sums[:-size]
        return mix64(total * self.inverse[: len(total)] + _U(size))


class Parse:
    """Recompression of the words of some documents, laid end to end at `bounds`."""

    def __init__(self, hashes: np.ndarray, bounds: np.ndarray, window: int):
        self.bounds, self.window, n = bounds, window, len(hashes)
        self.h1 = Sums(hashes, _P1, _I1)
        self.h2 = Sums(mix64(hashes + _P2), _P2, _I2)
        name, s = mix64(hashes), np.arange(n, dtype=np.int64)
        e, ds, de = s + 1, s, s + 1
        first = np.zeros(n, bool)
        first[bounds[:-1][bounds[:-1] < n]] = True
        self.best = np.zeros(n, np.uint64)  # of each window's start: its anchor
        self.ends = np.repeat(bounds[1:], np.diff(bounds))
        self.valid = s + window <= self.ends
        for turn in range(1, ROUNDS + 1):
            near = turn <= ANCHOR_ROUNDS
            # runs
            closing = np.append(first[1:], True)[: len(name)]
            if near:  # that a run ends there, the symbols beside it tell
                ds, de = np.where(first, s - 1, np.append(s[:1], ds[:-1])[: len(name)]), np.where(closing, e + 1, np.append(de[1:], e[-1:]))
            head = first.copy()
            head[1:] |= name[1:] != name[:-1]
            at = np.flatnonzero(head)
            if len(at) < len(name):
                length = np.diff(at, append=len(name))
                last = at + length - 1
                name = np.where(length > 1, mix64(name[at] * _P1 + length.astype(np.uint64)), name[at])
                s, e, first, closing = s[at], e[last], first[at], closing[last]
                if near:
                    ds, de = ds[at], de[last]
            # pairs
            right = (mix64(name + _U(turn * int(_P2) % (1 << 64))) & _U(1)).astype(bool)
            joins = np.zeros(len(name), bool)
            joins[:-1] = ~right[:-1] & right[1:] & ~closing[:-1]
            gone = np.append(False, joins[:-1])[: len(name)]
            after = np.append(np.arange(1, len(name)), max(0, len(name) - 1))[: len(name)]
            if near:  # an unpaired symbol's neighbour tells that it stays alone
                alone = ~joins & ~gone
                before = np.append(0, np.arange(len(name) - 1))[: len(name)]
                nds = np.where(alone & right, np.where(first, s - 1, ds[before]), ds)
                nde = np.where(joins, de[after], np.where(alone & ~right, np.where(closing, e + 1, de[after]), de))
                ds, de = nds, nde
            name = np.where(joins, mix64(name * _P1 + mix64(name[after] + _P1)), name)
            e = np.where(joins, e[after], e)
            keep = ~gone
            name, s, e, first = name[keep], s[keep], e[keep], first[keep]
            if near:
                ds, de = ds[keep], de[keep]
                self._offer(turn, ds, de, joins[keep])
        bare = self.valid & (self.best == 0)
        at = np.flatnonzero(bare)
        self.best[at] = (self.h1.of(at, at + window) >> _U(4)) | _U(1)
        # stretches: two neighbours, or a document's only symbol
        two = np.flatnonzero(~first[1:]) if len(first) else np.zeros(0, np.int64)
        lone = np.flatnonzero(first & np.append(first[1:], True)[: len(first)])
        self.start, self.end = np.concatenate([s[two], s[lone]]), np.concatenate([e[two + 1] if len(two) else e[:0], e[lone]])
        self.stretch = np.concatenate([mix64(name[two] * _P2 + name[two + 1]) if len(two) else name[:0], name[lone]])
        wide = self.end - self.start >= window
        order = np.argsort(self.start[wide], kind="stable")
        self.start, self.end, self.stretch = (x[wide][order] for x in (self.start, self.end, self.stretch))

    def _offer(self, turn: int, ds: np.ndarray, de: np.ndarray, new: np.ndarray) -> None:
        """New symbols offer the hash of all words that they depend on to all windows that hold those."""
        at = np.flatnonzero(new & (de - ds <= self.window) & (de < len(self.h1.sums)))
        lo, hi = np.maximum(0, de[at] - self.window), ds[at]
        ok = hi >= lo
        at, lo, hi = at[ok], lo[ok], hi[ok]
        span = hi - lo + 1
        # the windows of one document alone: from its first word on, as far as they are valid
        index = np.repeat(lo - np.append(0, np.cumsum(span)[:-1])[: len(span)], span) + np.arange(int(span.sum()))
        key = np.repeat((_U(turn) << _U(60)) | (self.h1.of(ds[at], de[at]) >> _U(4)), span)
        inside = self.ends[index] == np.repeat(self.ends[ds[at]], span) if len(index) else np.zeros(0, bool)
        np.maximum.at(self.best, index[inside], key[inside])

    def doc(self, k: int) -> tuple[int, int]:
        return int(self.bounds[k]), int(self.bounds[k + 1])

    def stretches(self, a: int, b: int) -> slice:
        return slice(*np.searchsorted(self.start, (a, b)))

    def names(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A document's distinct anchors; its stretches with their second hashes."""
        a, b = self.doc(k)
        anchors = np.unique(self.best[a:b][self.valid[a:b]])
        part = self.stretches(a, b)
        found, at = np.unique(self.stretch[part], return_index=True)
        return anchors, found, self.h2.of(self.start[part][at], self.end[part][at])

    def settled(self, k: int, seen: np.ndarray) -> np.ndarray:
        """Of each window of a document: whether a stretch in `seen`, or an earlier place of this document, has it too."""
        a, b = self.doc(k)
        n = max(0, b - a - self.window + 1)
        part = self.stretches(a, b)
        edge = np.zeros(n + 1, np.int64)
        _, firsts = np.unique(self.stretch[part], return_index=True)
        again = np.ones(part.stop - part.start, bool)
        again[firsts] = False
        again |= np.isin(self.stretch[part], seen)
        np.add.at(edge, self.start[part][again] - a, 1)
        np.add.at(edge, self.end[part][again] - a - self.window + 1, -1)
        done = np.cumsum(edge)[:n] > 0
        if n:
            at = np.arange(a, a + n)
            _, firsts = np.unique(self.h1.of(at, at + self.window), return_index=True)
            local = np.ones(n, bool)
            local[firsts] = False
            done |= local
        return done


def parse_texts(texts: list[list[bytes]], window: int) -> Parse:
    digest = xxhash.xxh64_intdigest
    bounds = np.cumsum([0, *map(len, texts)])
    return Parse(np.fromiter((digest(w) for t in texts for w in t), np.uint64, int(bounds[-1])), bounds, window)


def in_order(docs: DataFrame) -> DataFrame:
    """d (a number in the order of documents), doc_id, text. d is doc_id itself unless some are null or repeated."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if own.where("doc_id is null").isEmpty() and own.groupBy("doc_id").count().where("count > 1").isEmpty():
        return own.withColumn("d", F.col("doc_id"))
    return stage(own.orderBy(F.col("doc_id").asc_nulls_first(), "text").withColumn("d", F.monotonically_increasing_id()), "substring-order")


def shared_names(docs: DataFrame, window: int) -> DataFrame:
    """d, anchors (names that other documents have too), seen (stretches that an earlier document has)."""

    def name(batches):
        for whole in batches:
            for batch in slices(whole, "text", 4 << 20):
                texts = [x.split() for x in utf8(batch.column("text"))]
                parse, kinds, names, checks, ids = parse_texts(texts, window), [], [], [], []
                for k, d in enumerate(batch.column("d").to_pylist()):
                    anchors, stretches, check = parse.names(k)
                    kinds += [np.zeros(len(anchors), np.int8), np.ones(len(stretches), np.int8)]
                    names += [anchors, stretches]
                    checks += [np.zeros(len(anchors), np.uint64), check]
                    ids.append(np.full(len(anchors) + len(stretches), d, np.int64))
                cat = lambda x, t: np.concatenate(x).view(t) if x else np.zeros(0, t)
                kind, name_, second, d = (cat(x, t) for x, t in ((kinds, np.int8), (names, np.int64), (checks, np.int64), (ids, np.int64)))
                ask, later, least = first_in_batch(d, second, name_, kind)
                told = np.concatenate([later, least[kind[least] == 0]])
                at = np.concatenate([ask, told])
                key = np.concatenate([name_[ask], mix64(d[told].view(np.uint64)).view(np.int64)])
                columns = (key, kind[at], name_[at], second[at], d[at], np.arange(len(at)) >= len(ask))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["key", "kind", "name", "second", "d", "told"])

    named = docs.select("d", "text").mapInArrow(name, "key long, kind byte, name long, second long, d long, told boolean")
    order = Window.partitionBy("key", "kind", "second").orderBy("d")  # told rows have their document for key: they only travel with the rest
    ranked = named.withColumns({"before": F.lag("d").over(order), "after": F.lead("d").over(order)})
    shared = ranked.where("told or before is not null or (kind = 0 and after is not null)")
    of = lambda kind: F.collect_list(F.when(F.col("kind") == kind, F.col("name")))
    return shared.groupBy("d").agg(of(0).alias("anchors"), of(1).alias("seen"))


def _array(x: list | None) -> np.ndarray:
    return np.array(x or [], np.int64).view(np.uint64)


def repeated_windows(docs: DataFrame, shared: DataFrame, window: int) -> DataFrame:
    """d, at: places of windows with a shared anchor that stand in an earlier document and in no seen stretch."""

    def emit(batches):
        for whole in batches:
            for batch in slices(whole, "text", 4 << 20):
                parse = parse_texts([x.split() for x in utf8(batch.column("text"))], window)
                places, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                rows = zip(*(batch.column(x).to_pylist() for x in ("d", "anchors", "seen")), strict=True)
                for k, (d, anchors, seen) in enumerate(rows):
                    a, b = parse.doc(k)
                    n = max(0, b - a - window + 1)
                    at = np.flatnonzero(np.isin(parse.best[a : a + n], _array(anchors)) & ~parse.settled(k, _array(seen)))
                    places.append(at + a)
                    ids.append(np.full(len(at), d, np.int64))
                at, d = np.concatenate(places), np.concatenate(ids)
                starts = parse.bounds[np.searchsorted(parse.bounds, at, "right") - 1]
                h1, h2 = parse.h1.of(at, at + window).view(np.int64), parse.h2.of(at, at + window).view(np.int64)
                ask, told, _ = first_in_batch(d, h2, h1)
                both = np.concatenate([ask, told])
                h1[told] = mix64(d[told].view(np.uint64)).view(np.int64)
                h2[told] = at[told] - starts[told]
                columns = (h1[both], h2[both], d[both], (at - starts)[both].astype(np.int32), np.arange(len(both)) >= len(ask))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["h1", "h2", "d", "at", "told"])

    texts = docs.select("d", "text").join(shared.where(F.size("anchors") > 0).hint("shuffle_hash"), "d")
    windows = texts.mapInArrow(emit, "h1 long, h2 long, d long, at int, told boolean")
    first = F.lag("d").over(Window.partitionBy("h1", "h2").orderBy("d", "at"))
    return windows.withColumn("before", first).where("told or before is not null").groupBy("d").agg(F.collect_list("at").alias("at"))


def spans_of(done: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Words under the marked windows, as joined spans."""
    at = np.flatnonzero(done)
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > window)
    return list(zip(at[np.append(0, cut + 1)].tolist(), (at[np.append(cut, len(at) - 1)] + window).tolist(), strict=True))


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, spans (of removed words), kept (the other words joined by a space): one row for each row of docs."""
    ordered = in_order(docs)
    shared = stage(shared_names(ordered, window), "substring-names", free=True)
    places = stage(repeated_windows(ordered, shared, window), "substring-places", free=True)
    known = shared.select("d", "seen").join(places, "d", "full_outer")

    def apart(batches):
        for whole in batches:
            for batch in slices(whole, "text", 4 << 20):
                texts = [x.split() for x in utf8(batch.column("text"))]
                parse, spans, kept = parse_texts(texts, window), [], []
                for k, (seen, at) in enumerate(zip(batch.column("seen").to_pylist(), batch.column("at").to_pylist(), strict=True)):
                    done = parse.settled(k, _array(seen))
                    done[np.array(at or [], np.int64)] = True
                    spans.append(spans_of(done, window))
                    edges = [0, *(x for s in spans[-1] for x in s), len(texts[k])]
                    kept.append(b" ".join(w for a, b in list(pairwise(edges))[::2] for w in texts[k][a:b]))
                pair = pa.struct([("start", pa.int64()), ("end", pa.int64())])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(list(map(len, texts)), pa.int64()), pa.array([[{"start": a, "end": b} for a, b in x] for x in spans], pa.list_(pair)), pa.array(kept, pa.binary()).cast(pa.string())],
                    names=["doc_id", "n_words", "spans", "kept"],
                )

    joined = ordered.join(known.hint("shuffle_hash"), "d", "left").select("doc_id", "text", "seen", "at")
    return joined.mapInArrow(apart, "doc_id long, n_words long, spans array<struct<start: bigint, end: bigint>>, kept string")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    def digests() -> DataFrame:
        found = remove_repeats(read_table(spark, sf_dir, "documents"))
        removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
        return found.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))

    return settled(spark, "op1", digests)
