"""Best-fit packing of token pieces into sequences of at most SEQUENCE tokens.

Method: bulk-synchronous best fit. Pieces are sorted by length (longest first) and gaps by size. A sweep
sends all pieces of one length to their successor gaps (the smallest that hold them); pieces that want the
same gaps are resolved by rank within their length; gaps shrink; the next sweep follows. Equal lengths and
equal gaps are interchangeable, so both sorted lists are kept run-length coded: at most SEQUENCE lengths
and SEQUENCE gap sizes, however many pieces there are. Only those counts are on the driver; the pieces stay
distributed and find their place by (length, rank).

Defined results: null text is empty (its end token alone); ties go by a hash bucket, then doc_id and piece;
repeated rows are packed one by one; an empty table gives no pieces; other columns are not read.
"""

from __future__ import annotations

import json
import zlib
from array import array
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read_table, slices, stage, utf8

SEQUENCE = 1024
END_ID = 2
#: Ranks within a length are counted per hash bucket, so that the most common length is no hot key.
#: As many as there are shuffle partitions, within these bounds.
BUCKETS = (64, 1024)
#: Distinct chunks whose ids a worker remembers; it starts afresh beyond.
REMEMBERED = 250_000

PIECES = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def printable_bytes() -> dict[str, int]:
    """The characters by which byte-level vocabulary files write bytes: themselves where printable, else from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def merge_ranks(vocabulary: str) -> dict[bytes, int] | None:
    """Bytes -> id of a byte-level BPE file whose ids follow its merges, else None."""
    with open(vocabulary, encoding="utf-8") as f:
        file = json.load(f)
    model, special = file["model"], {x["content"] for x in file.get("added_tokens", [])}
    if model.get("type") != "BPE" or file.get("pre_tokenizer", {}).get("type") != "ByteLevel":
        return None
    byte = printable_bytes()
    ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    ids = [model["vocab"][a + b] for a, b in pairs]
    return ranks if ids == sorted(ids) and len(ranks) == len(ids) + 256 else None


class Ids(dict):
    """Text between single spaces -> its ids as little-endian unsigned 32-bit integers, the space before it included.

    The vocabulary's split rule always starts a new word at a single space between two other characters,
    so such chunks are encoded alone, by a faster merge over the same file's ranks where it allows that.
    A chunk that touches other white space is None: its text is encoded whole by tokenizers, as is one with an added token.
    """

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.chunk = self.encode
        if ranks := merge_ranks(vocabulary):
            import public_tokenizers
            import tiktoken

            fast = tiktoken.Encoding("chunks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.chunk = lambda text: array("I", fast.encode_ordinary(text)).tobytes()

    def encode(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, chunk: str) -> bytes | None:
        if len(self) >= REMEMBERED:
            self.clear()
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            ids = None
        elif chunk[-1] in ".,;:!?" and chunk[:-1].isalpha():  # a letter and a mark always part
            ids = self[chunk[:-1]] + self.chunk(chunk[-1])
        else:
            ids = self.chunk(f" {chunk}")
        if len(chunk) < 64:
            self[chunk] = ids
        return ids

    def text(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        if not rest or not first or first[-1].isspace() or any(x in text for x in self.added):
            return self.encode(text) if text else b""
        found = [self[x] for x in rest]
        return self.encode(text) if None in found else self.chunk(first) + b"".join(found)


def cut(n: int, most: int = SEQUENCE) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole sequences, but the first may be shorter."""
    head = n % most or min(n, most)
    return [(0, head), *((x, most) for x in range(head, n, most))] if n else []


_known: dict[str, Ids] = {}


def ids_of(vocabulary: str) -> Ids:
    """The worker's own Ids, kept from task to task."""
    if vocabulary not in _known:
        _known[vocabulary] = Ids(vocabulary)
    return _known[vocabulary]


def pieces(docs: DataFrame, vocabulary: str | None = None, sequence: int = SEQUENCE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every row of docs."""
    vocabulary = vocabulary or default_vocabulary()

    def tokenize(batches):
        ids, end = ids_of(vocabulary), np.asarray([END_ID], "<u4").tobytes()
        for whole in batches:
            for batch in slices(whole, "text"):
                rows = []
                for doc_id, raw in zip(batch.column("doc_id").to_pylist(), utf8(batch.column("text")), strict=True):
                    coded = ids.text(raw.decode()) + end
                    rows += [(doc_id, k, start, n, zlib.crc32(coded[4 * start : 4 * (start + n)])) for k, (start, n) in enumerate(cut(len(coded) // 4, sequence))]
                columns = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=PIECES.names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tokenize, PIECES)


def plan_sweeps(counts: dict[int, int], sequence: int = SEQUENCE) -> list[tuple[int, int, int, int, int]]:
    """counts: pieces of each length. Best fit by sweeps over run-length coded lists, longest pieces first.

    Returns (length, first rank, last rank + 1, first sequence, offset): pieces of a length with ranks of
    the interval go to consecutive sequences at the offset.
    """
    runs: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap size -> runs of sequences (first, number)
    sizes: list[int] = []
    plan, opened = [], 0

    def put(size: int, run: tuple[int, int]) -> None:
        if size:
            if not runs[size]:
                insort(sizes, size)
            runs[size].append(run)

    for length in sorted((x for x, n in counts.items() if n), reverse=True):
        rank, total = 0, counts[length]
        while rank < total:
            if (k := bisect_left(sizes, length)) < len(sizes):
                size = sizes[k]
                first, n = runs[size].pop()
                if not runs[size]:
                    sizes.pop(k)
                take = min(n, total - rank)
                if take < n:
                    put(size, (first + take, n - take))
            else:
                # As many new sequences as the rest fills to the end; their gaps take the rest in the next sweeps.
                size, first, take = sequence, opened, max(1, (total - rank) // (sequence // length))
                opened += take
            plan.append((length, rank, rank + take, first, sequence - size))
            rank += take
            put(size - length, (first, take))
    return plan


def pack(found: DataFrame, sequence: int = SEQUENCE) -> DataFrame:
    """Adds sequence_id and offset to the rows of pieces()."""
    spark = found.sparkSession
    buckets = min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), BUCKETS[0]), BUCKETS[1])
    found = stage(found.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int")), "pack-pieces")
    cells = {(r["length"], r["bucket"]): r["n"] for r in found.groupBy("length", "bucket").agg(F.count("*").alias("n")).collect()}  # at most sequence x buckets rows
    counts: dict[int, int] = defaultdict(int)
    before = {}
    for (length, bucket), n in sorted(cells.items()):
        before[length, bucket] = counts[length]
        counts[length] += n
    plan = plan_sweeps(counts, sequence)
    by_length: dict[int, list] = defaultdict(list)
    for length, lo, _, first, offset in plan:
        by_length[length].append((lo, first, offset))
    starts = {k: np.array(v, np.int64).reshape(-1, 3) for k, v in by_length.items()}
    shared = spark.sparkContext.broadcast((before, starts))  # bounded: sequence x buckets counts and the runs of the plan

    def place(batches):
        before, starts = shared.value
        held, seen = None, 0
        for batch in batches:
            length, bucket = (batch.column(x).to_numpy() for x in ("length", "bucket"))
            key = length * buckets + bucket
            edges = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.array([], int)
            seq, offset = np.empty(len(key), np.int64), np.empty(len(key), np.int64)
            for a, b in zip(edges, [*edges[1:], len(key)], strict=True):
                if key[a] != held:
                    held, seen = key[a], 0
                rank = before[int(length[a]), int(bucket[a])] + seen + np.arange(b - a)
                seen += b - a
                table = starts[int(length[a])]
                at = np.searchsorted(table[:, 0], rank, "right") - 1
                seq[a:b], offset[a:b] = table[at, 1] + rank - table[at, 0], table[at, 2]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in PIECES.names), pa.array(seq), pa.array(offset)], names=[*PIECES.names, "sequence_id", "offset"])

    schema = T.StructType([*PIECES.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    ordered = found.repartition("length", "bucket").sortWithinPartitions("length", "bucket", "doc_id", "piece")
    return ordered.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, vocabulary: str | None = None, sequence: int = SEQUENCE) -> DataFrame:
    return pack(pieces(docs, vocabulary, sequence), sequence)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"))
