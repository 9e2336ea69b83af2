"""SimHash near-dedup with a Gray-order hierarchical index.

Fingerprints: 64 bits, each set when over half the XXH64 (seed 42) of the text's 3-word shingles set it.
Documents with one fingerprint are one key from the start. Distinct fingerprints at most DISTANCE bits apart
agree on two of four 16-bit blocks, so each goes to the six groups that its block pairs name; in a group
they are sorted by Gray rank, and a tree of shared masked bit patterns is built over runs of the sorted
list: a node keeps the bits on which all below it agree. A search walks the tree with accumulated
differences and drops whole subtrees beyond DISTANCE. A group over MOST_GROUP keys is first split again by
parts of the bits it does not share, which loses no link, until the bits are used up. A group yields one link
of each linked key, never all pairs; components come from min-label hooking with shortcuts in rounds.

The pipeline's stage, drop_near_duplicates(), takes fingerprints of single words in place of shingles and STAGE_DISTANCE
bits, since near copies lie up to eleven bits apart by shingles and five by words; within such components
texts are compared by shingles of five words, and those with a likeness of 0.8 or more are one group.

Defined results: null, empty and wordless texts have fingerprint zero and link like any other; fewer than three
words are one shingle; ties and repeated rows share a fingerprint and so a component; an empty table gives an
empty result; a null doc_id is ignored as a component's name unless the component has no other.
"""

from __future__ import annotations

from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from .common import again, mix64, read_table, settled, slices, stage, temp_name, utf8

SEED = 42
DISTANCE = 2
SHINGLE = 3
MOST_GROUP = 4096
LEAF = 16
#: Of the stage that drops near-duplicates: differing bits of word fingerprints, how many of these a text has, words in a shingle, likeness of shingles,
#: and bands of least shingle hashes by which candidates of a component meet.
STAGE_DISTANCE, FINGERPRINTS, STAGE_SHINGLE, LIKENESS, BANDS, BAND = 5, 2, 5, 0.8, 20, 5


def fingerprint(raw: bytes) -> int:
    words = raw.lower().split()
    if not words:
        return 0
    text = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[:-1].tolist()]
    ends = (ends - 1).tolist()
    n = max(1, len(words) - SHINGLE + 1)
    digest = xxhash.xxh64_intdigest
    if n == 1:
        return digest(text, SEED)
    total = np.zeros(64, np.int64)
    for at in range(0, n, 8192):
        h = np.array([digest(text[a:b], SEED) for a, b in zip(starts[at : min(n, at + 8192)], ends[at + SHINGLE - 1 :], strict=False)], "<u8")
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int32)
    set_ = np.flatnonzero(2 * total > n)
    return int(sum(1 << int(k) for k in set_))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


@arrow_udf(T.LongType())
def fingerprint_udf(text: pa.Array) -> pa.Array:
    return pa.array([_signed(fingerprint(x)) for x in utf8(text)], pa.int64())


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each bit pattern in the reflected Gray order: its prefix parities."""
    x = x.astype(np.uint64, copy=True)
    for k in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(k)
    return x


def gray_links(keys: np.ndarray, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """keys: distinct uint64. Pairs of indexes that span the components of keys within `distance` bits.

    Level 0 of the tree has runs of LEAF keys in Gray order; a node's mask has the bits on which all its keys agree,
    and each level has one node for LEAF of the level below. All keys walk the tree together.
    """
    n = len(keys)
    order = np.argsort(gray_rank(keys), kind="stable")
    k = keys[order]
    levels, lo, hi = [], k, k
    while len(lo) > 1:  # every level: the AND and OR of each run
        cuts = np.arange(0, len(lo), LEAF)
        lo, hi = np.bitwise_and.reduceat(lo, cuts), np.bitwise_or.reduceat(hi, cuts)
        levels.append((lo, ~(lo ^ hi)))
    label = np.arange(n)  # by place in the order: the smallest place known to be linked with it
    step = 256
    for first in range(0, n, step):
        query = np.arange(first, min(n, first + step))
        node = np.zeros(len(query), np.int64)
        at = query
        for value, mask in reversed(levels):
            if value is not levels[-1][0]:  # from the parents kept: their children
                at = np.repeat(at, LEAF)
                node = (node[:, None] * LEAF + np.arange(LEAF)).ravel()
                ok = node < len(value)
                at, node = at[ok], node[ok]
            ok = np.bitwise_count((k[at] ^ value[node]) & mask[node]) <= distance
            at, node = at[ok], node[ok]
        if levels:
            at = np.repeat(at, LEAF)
            node = (node[:, None] * LEAF + np.arange(LEAF)).ravel()
            ok = node < at  # each pair once
            at, node = at[ok], node[ok]
            ok = np.bitwise_count(k[at] ^ k[node]) <= distance
            label = joined(label, at[ok], node[ok])
    first = np.full(n, n)
    np.minimum.at(first, label, order)  # the least index of each set
    return [(a, b) for a, b in zip(order.tolist(), first[label].tolist(), strict=True) if a != b]


def joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """label (each the least of its set) after the sets of all pairs a, b have become one."""
    while True:
        x, y = label[a], label[b]
        if (apart := x != y).any():
            np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
            while (label != (up := label[label])).any():
                label = up
        else:
            return label


def _blocks(distance: int) -> tuple[int, int]:
    """Blocks of the bits, and how many of them keys at most `distance` bits apart agree on."""
    return (4, 2) if distance <= 2 else (8, 8 - distance) if distance <= 6 else (16, 16 - distance)


def _groups(keys: DataFrame, distance: int) -> DataFrame:
    """fp, group (a hash of the blocks chosen and their bits), fixed (mask of the bits that the group shares)."""
    blocks, agree = _blocks(distance)
    width = 64 // blocks
    masks = [_signed(sum(((1 << width) - 1) << width * k for k in ks)) for ks in combinations(range(blocks), agree)]
    fixed = keys.select("fp", F.explode(F.array(*map(F.lit, masks))).alias("fixed"))
    return fixed.select("fp", F.xxhash64("fixed", F.col("fp").bitwiseAND(F.col("fixed"))).alias("group"), "fixed")


def _split(large: DataFrame, distance: int) -> DataFrame:
    """Each key of a large group to the groups named by parts of the free bits, one more than may differ: one part is left alone."""
    n = distance + 1

    def parts(batches):
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            group, fixed = batch.column("group").to_numpy().view(np.uint64), batch.column("fixed").to_numpy().view(np.uint64)
            out = []
            for mask in np.unique(fixed):
                free = [b for b in range(64) if not int(mask) >> b & 1]
                at = np.flatnonzero(fixed == mask)
                for t in range(n):
                    part = np.uint64(sum(1 << b for b in free[t::n]))
                    name = mix64(group[at] ^ mix64((fp[at] & part) ^ mix64(np.full(len(at), part))))
                    out.append((fp[at], name, np.full(len(at), mask | part)))
            columns = [np.concatenate(x).view(np.int64) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["fp", "group", "fixed"])

    return large.mapInArrow(parts, "fp long, group long, fixed long")


#: Keys of a group that are compared each with each.
FEW = 32


def _in_groups(fp: np.ndarray, group: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """fp (uint64) by group, in one order: pairs of places, of each key that is linked and the first one of its set, over whole groups.

    A set's first key is the same in most groups that hold it, so links of different groups are often one.
    """
    label, start = np.arange(len(fp)), np.flatnonzero(np.diff(group, prepend=group[:1] + 1))
    size = np.diff(start, append=len(fp))
    few = np.repeat(size <= FEW, size)
    for k in range(1, min(FEW, int(size.max(initial=1)))):
        near = few[k:] & (group[k:] == group[:-k]) & (np.bitwise_count(fp[k:] ^ fp[:-k]) <= distance)
        at = np.flatnonzero(near)
        if len(at):
            label = joined(label, at + k, at)
    for s, n in zip(start[size > FEW].tolist(), size[size > FEW].tolist(), strict=True):
        for a, b in gray_links(fp[s : s + n], distance):
            label[s + a] = s + b
    at = np.flatnonzero(label != np.arange(len(fp)))
    return at, label[at]


def _searched(distance: int):
    """Rows by group, in order: links (a, b; fixed null) of groups of moderate size, and the rows (a: fp, b: group) of large ones.

    A group with 14 or fewer free bits is bounded by itself.
    """

    def rows(a, b, fixed) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(fixed, pa.int64()) if fixed is not None else pa.nulls(len(a), pa.int64())], names=["a", "b", "fixed"])

    def settle(fp, group, fixed):
        _, of, size = np.unique(group, return_inverse=True, return_counts=True)
        large = (size[of] > MOST_GROUP) & (64 - np.bitwise_count(fixed.view(np.uint64)) > 14)
        if large.any():
            yield rows(fp[large], group[large], fixed[large])
        fp, group = fp[~large], group[~large]
        a, b = _in_groups(fp, group, distance)
        yield rows(fp[a], fp[b], None)

    def run(batches):
        held, going = [np.zeros(0, t) for t in (np.uint64, np.int64, np.int64)], None
        for batch in batches:
            x = [batch.column("fp").to_numpy().view(np.uint64), batch.column("group").to_numpy(), batch.column("fixed").to_numpy()]
            if going is not None:  # the rest of a large group
                n = int(np.searchsorted(x[1] != going, True)) if (x[1] != going).any() else len(x[1])
                yield rows(x[0][:n], x[1][:n], x[2][:n])
                if n == len(x[1]):
                    continue
                x, going = [c[n:] for c in x], None
            x = [np.concatenate(c) for c in zip(held, x, strict=True)]
            if not len(x[1]):
                continue
            last = int(np.flatnonzero(x[1] != x[1][-1])[-1]) + 1 if (x[1] != x[1][-1]).any() else 0
            if last:
                yield from settle(*(c[:last] for c in x))
            held = [c[last:] for c in x]
            if len(held[0]) > max(MOST_GROUP, 1 << 14):
                yield rows(*held)
                going, held = held[1][0], [c[:0] for c in held]
        if len(held[0]):
            yield from settle(*held)

    return run


def fingerprint_links(keys: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """keys: distinct fp. a, b: links that join what lies within `distance`; of each group a key has one at most."""
    grouped, out = _groups(keys, distance), None
    while True:
        found = stage(grouped.repartition("group").sortWithinPartitions("group", "fp").mapInArrow(_searched(distance), "a long, b long, fixed long"), "simhash-links")
        links = found.where(F.col("fixed").isNull()).select("a", "b")
        out = links if out is None else out.unionByName(links)
        rest = found.where(F.col("fixed").isNotNull()).select(F.col("a").alias("fp"), F.col("b").alias("group"), "fixed")
        if rest.isEmpty():
            return out
        grouped = _split(rest, distance)


#: Links that a task holds at once.
FOREST = 1 << 20


def forests(links: DataFrame) -> DataFrame:
    """links: a, b (long). Fewer links that join the same nodes: those of each a meet in one task, which gives each node one link, to the smallest that it reaches there.

    A key has many links to the first keys of its groups, and those first keys are much the same for all keys of a large set.
    """

    def spanned(held: list[np.ndarray]) -> pa.RecordBatch:
        a, b = (np.concatenate(held[k::2]) for k in (0, 1))
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        label = joined(np.arange(len(nodes)), at[: len(a)], at[len(a) :])
        linked = np.flatnonzero(label != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[linked]), pa.array(nodes[label[linked]])], names=["a", "b"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held += [batch.column(c).to_numpy() for c in ("a", "b")]
            n += batch.num_rows
            if n >= FOREST:
                yield spanned(held)
                held, n = [], 0
        if n:
            yield spanned(held)

    return links.select("a", "b").repartition("a").mapInArrow(run, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """links: a, b. node, label (the smallest node reachable) of every node that has a link.

    Links are reduced by forests() first. Each round hooks both ends of every link and their present labels to the smallest label seen, then follows
    labels of labels; it ends when no label changes. Sums of labels tell whether one did.
    """
    few = stage(forests(links), "components-forests")
    both = stage(few.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(few.select(F.col("b").alias("u"), F.col("a").alias("v"))), "components-links")
    labels = stage(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("label")).withColumnRenamed("u", "node"), "components-labels")
    if labels.isEmpty():
        return labels
    while True:
        of = labels.select(F.col("node").alias("label"), F.col("label").alias("upper"))
        jumped = stage(labels.join(of, "label").select("node", "label", "upper"), "components-jumped")
        seen = both.join(jumped.select(F.col("node").alias("v"), F.col("upper").alias("m")), "v").groupBy("u").agg(F.min("m").alias("m"))
        mine = jumped.join(seen.withColumnRenamed("u", "node"), "node").select("node", "label", "upper", F.least("upper", "m").alias("m"))
        offers = mine.select(F.col("node"), "m").unionByName(mine.select(F.col("label").alias("node"), "m")).groupBy("node").agg(F.min("m").alias("label"))
        new = stage(offers, "components-labels")
        changed = not new.join(labels.withColumnRenamed("label", "old"), "node").where("label <> old").isEmpty()
        labels = new
        if not changed:
            return labels


def _by_component(marked: DataFrame, first: Column) -> DataFrame:
    """marked: fp and what first aggregates. fp, label (the component's, whatever its ids) and first of each fp."""
    keys = stage(marked.groupBy("fp").agg(first.alias("first")), "simhash-keys")
    label = components(fingerprint_links(keys.select("fp"))).withColumnRenamed("node", "fp")
    return keys.join(label, "fp", "left").withColumn("label", F.coalesce("label", "fp"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp (a signed 64-bit number), component_id: one row for each row of docs."""
    marked = stage(docs.select("doc_id", fingerprint_udf("text").alias("fp")), "simhash-fingerprints")
    named = _by_component(marked, F.min("doc_id"))
    least = named.groupBy("label").agg(F.min("first").alias("component_id"))
    by_key = named.select("fp", "label").join(least, "label").select("fp", "component_id")
    return marked.join(by_key, "fp").select("doc_id", "fp", "component_id")


def word_fingerprint(raw: bytes, known: dict[bytes, int]) -> list[int]:
    """FINGERPRINTS of 64 bits by the text's words, weighed by the logarithm of their counts: a few changed words change few bits, however many shingles they change."""
    counts = Counter(raw.lower().split())
    if not counts:
        return [0] * FINGERPRINTS
    if len(known) > 50_000:
        known.clear()
    h = np.fromiter((known[w] if w in known else known.setdefault(w, xxhash.xxh64_intdigest(w, SEED)) for w in counts), np.uint64, len(counts))
    weight = np.floor(16 * (1 + np.log(np.fromiter(counts.values(), np.int64, len(counts))))).astype(np.int64)
    out = []
    for _ in range(FINGERPRINTS):
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        out.append(int(np.packbits(2 * (weight @ bits) > weight.sum(), bitorder="little").view("<u8")[0]))
        h = mix64(h)
    return out


def word_fingerprints(batches):
    known: dict[bytes, int] = {}
    for whole in batches:
        for batch in slices(whole, "text", 2 << 20):
            fps = pa.array([list(map(_signed, word_fingerprint(x, known))) for x in utf8(batch.column("text"))], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("h"), fps, batch.column("order")], names=["h", "fps", "order"])


def shingles(raw: bytes) -> np.ndarray:
    """Distinct hashes of the text's runs of STAGE_SHINGLE words, in order; fewer words are one run."""
    words = raw.lower().split()
    h = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words), np.uint64, len(words))
    n = max(1, len(h) - STAGE_SHINGLE + 1)
    out = np.full(n, len(h) if n == 1 else STAGE_SHINGLE, np.uint64)
    for k in range(min(len(h), STAGE_SHINGLE)):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
    return np.unique(out)


def _banded(batches):
    """h, the shingles, and BANDS hashes of BAND least shingles each."""
    seeds = mix64(np.arange(1, BANDS * BAND + 1, dtype=np.uint64))
    for whole in batches:
        for batch in slices(whole, "text", 2 << 20):
            sets, bands = [], []
            for raw in utf8(batch.column("text")):
                s = shingles(raw)
                least = np.array([mix64(s ^ seed).min() for seed in seeds]).reshape(BANDS, BAND)
                key = np.zeros(BANDS, np.uint64)
                for k in range(BAND):
                    key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + least[:, k])
                sets.append(s.tobytes())
                bands.append(key.view(np.int64))
            arrays = [batch.column("h"), pa.array(sets, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["h", "shingles", "bands"])


@arrow_udf(T.DoubleType())
def likeness(a: pa.Array, b: pa.Array) -> pa.Array:
    """Jaccard likeness of two sets of shingles."""
    out = []
    for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True):
        both = len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
        out.append(both / max(1, (len(x) + len(y)) // 8 - both))
    return pa.array(out, pa.float64())


def row_hash(docs: DataFrame) -> Column:
    """Of all columns; what is null counts too."""
    return F.xxhash64(*(F.isnull(c) for c in docs.columns), *docs.columns)


def like_texts(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """marked: h (hash of the text), row (hash of the row) and fps, of each row of docs. node, label: texts of one label are chained by shingle likeness of LIKENESS and more.

    Fingerprints within STAGE_DISTANCE make components, for each of a text's fingerprints; within one, texts that share a
    band of least shingle hashes meet the least of them, and the two are compared by all their shingles.
    """
    texts = stage(marked.groupBy("h").agg(F.min("row").alias("row"), F.first("fps").alias("fps")), "near-texts")
    both = stage(texts.select("h", F.posexplode("fps").alias("which", "fp")), "near-both")
    near = components(fingerprint_links(stage(both.select("fp").distinct(), "near-keys"), STAGE_DISTANCE)).withColumnRenamed("node", "fp")
    labelled = stage(both.join(near, "fp", "left").select("h", "which", F.coalesce("label", "fp").alias("label")), "near-labels")
    several = labelled.groupBy("which", "label").agg(F.count("*").alias("n")).where("n > 1").select("which", "label")
    members = stage(labelled.join(several, ["which", "label"]), "near-members")
    # of a text's copies one row is read again, so that no task gets them all
    chosen = texts.join(members.select("h").distinct(), "h").select("h", "row")
    found = docs.select(F.xxhash64("text").alias("h"), row_hash(docs).alias("row"), "text").join(chosen, ["h", "row"]).dropDuplicates(["h"])
    banded = stage(found.select("h", "text").mapInArrow(_banded, "h long, shingles binary, bands array<long>"), "near-banded")
    each = banded.select("h", F.posexplode("bands").alias("band", "key")).join(again(members), "h").withColumn("label", F.struct("which", "label"))
    least = each.groupBy("label", "band", "key").agg(F.min("h").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    pairs = each.join(least, ["label", "band", "key"]).where("h <> least").select("h", "least").distinct()
    one, two = banded.select("h", "shingles"), again(banded).select(F.col("h").alias("least"), F.col("shingles").alias("other"))
    alike = pairs.join(one, "h").join(two, "least").where(likeness("shingles", "other") >= LIKENESS)
    return components(alike.select(F.col("h").alias("a"), F.col("least").alias("b")))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of near-duplicates: equal texts, and what like_texts() chains. That of the smallest doc_id stays,
    null last (of equal ones, the one with the smallest text hash, then the smallest hash of all columns).

    Rows are known by both hashes, not by doc_id, so null and repeated ids lose nothing.
    """
    text, row = temp_name("text"), temp_name("row")
    tags = [F.xxhash64("text").alias(text), row_hash(docs).alias(row)]
    order = F.struct(F.isnull("doc_id").alias("no_id"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias(text), tags[1])
    kind = f"h long, fps array<long>, order struct<no_id:boolean,doc_id:long,{text}:long,{row}:long>"
    marked = docs.select("text", F.xxhash64("text").alias("h"), order.alias("order")).mapInArrow(word_fingerprints, kind)
    marked = stage(marked, "near-fingerprints")
    label = like_texts(docs, marked.select("h", "fps", F.col(f"order.{row}").alias("row"))).withColumnRenamed("node", "h")
    kept = marked.join(label, "h", "left").groupBy(F.coalesce("label", "h").alias("label")).agg(F.min("order").alias("order")).select(F.col(f"order.{text}"), F.col(f"order.{row}"))
    one = docs.select(*docs.columns, *tags).dropDuplicates([text, row])  # rows that are equal in all columns stand for each other
    return one.join(stage(kept, "simhash-kept"), [text, row], "left_semi").select(*docs.columns)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    def digests() -> DataFrame:
        found = near_duplicates(read_table(spark, sf_dir, "documents"))
        return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

    return settled(spark, "op7", digests)
