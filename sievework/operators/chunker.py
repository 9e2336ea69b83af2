"""Chunking documents: fixed windows, packed sentences, packed paragraphs.

The splitters are Column expressions; packing depends on all that came before, so it runs in one UDF a text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ids import base_tag, suffixed_id
from .documents import carried, metered, strict

# White space as the word rule has it (Python adds U+001C to U+001F).
SPACE = "\t\n\x0b\x0c\r \x85\xa0                　"
# Fixed value: characters of the longest suffix of a chunk's id, `_` and a number of 31 bits.
MAX_SUFFIX = 11
_END = re.compile(rf"[.!?](?=[{SPACE}])|\n")
_BLANK = re.compile(rf"\n(?:[{SPACE}]*\n)+")


@dataclass(frozen=True)
class ChunkConfig:
    strategy: str = "sentence"
    chunk_size: int = 512
    overlap: int = 64
    min_chunk_size: int = 32
    keep_parent_fields: bool = True

    def __post_init__(self):
        if self.strategy not in ("fixed", "sentence", "paragraph"):
            raise ValueError(f"invalid config: strategy {self.strategy!r}")
        if self.chunk_size < 1 or not 0 <= self.overlap < self.chunk_size:
            raise ValueError("invalid config: chunk_size must be 1 or more and overlap less than chunk_size")

    @classmethod
    def parse(cls, config: dict) -> ChunkConfig:
        if unknown := set(config) - set(cls.__dataclass_fields__):
            raise ValueError(f"invalid config: unknown keys {sorted(unknown)}")
        return cls(**config)


def sentences(text: str) -> list[str]:
    out, at = [], 0
    for m in _END.finditer(text):
        out.append(text[at : m.end()])
        at = m.end()
    return [y for x in [*out, text[at:]] if (y := x.strip(SPACE))]


def paragraphs(text: str) -> list[str]:
    return [y for x in _BLANK.split(text.replace("\r\n", "\n")) if (y := x.strip(SPACE))]


def windows(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
    """Overlapping spans of at most `size` characters that end behind white space where there is some in the second half."""
    out, start = [], 0
    while len(text) - start > size:
        low, end = start + max(size // 2, overlap + 1), start + size
        cut = next((i for i in range(end, min(low, end) - 1, -1) if text[i - 1] in SPACE and i > start), end)
        out.append((start, cut))
        start = cut - overlap
    return [*out, (start, len(text))] if text else []


def tail(text: str, most: int) -> str:
    """The last words of a text in `most` characters."""
    if len(text) <= most or not most:
        return text if most else ""
    end = text[-most:]
    if text[-most - 1] not in SPACE:
        cut = next((i for i, c in enumerate(end) if c in SPACE), most)
        end = end[cut:]
    return end.lstrip(SPACE)


def pack(units: list[str], joint: str, size: int, overlap: int, least: int) -> list[str]:
    """Units joined up to `size`; each chunk begins with the end of the one before, as far as its first unit leaves room."""
    chunks: list[tuple[str, list[str]]] = []  # what is repeated, and units
    seed, held = "", []
    for unit in units:
        if held and len(joint.join([*filter(None, [seed]), *held, unit])) > size:
            chunks.append((seed, held))
            seed = tail(joint.join([*filter(None, [seed]), *held]), overlap)
            room = max(0, size - len(unit) - len(joint))
            seed, held = (tail(seed, room) if len(seed) > room else seed), []
        held = [*held, unit]
    if held:
        chunks.append((seed, held))
    texts = [joint.join([*filter(None, [s]), *u]) for s, u in chunks]
    if len(texts) > 1 and len(texts[-1]) < least:
        texts[-2:] = [joint.join([texts[-2], *chunks[-1][1]])]
    return texts


def chunk(text: str, config: ChunkConfig) -> list[str]:
    text, size = text.strip(SPACE), config.chunk_size
    if len(text) <= size:
        return [text] if text else []
    if config.strategy == "fixed":
        spans = windows(text, size, config.overlap)
        if len(spans) > 1 and spans[-1][1] - spans[-1][0] < config.min_chunk_size:
            spans[-2:] = [(spans[-2][0], spans[-1][1])]
        return [y for a, b in spans if (y := text[a:b].strip(SPACE))]
    split, joint = (sentences, " ") if config.strategy == "sentence" else (paragraphs, "\n\n")
    units = [y for x in split(text) for a, b in windows(x, size, 0) if (y := x[a:b].strip(SPACE))]
    return pack(units, joint, size, config.overlap, config.min_chunk_size)


def chunks(text: Column, config: ChunkConfig) -> Column:
    """Pickled, so that a batch is 100 texts of any size; an Arrow batch is 10,000."""
    return F.udf(lambda t: chunk(t, config) if t is not None else [], T.ArrayType(T.StringType()), useArrow=False)(text)


def chunked(docs: DataFrame, config: ChunkConfig | None = None) -> DataFrame:
    """Metered rows: docs (id, title, content, fields, meta columns) as one row a chunk with chunk_index, chunk_total and parent_id."""
    config, own = config or ChunkConfig(), carried(docs)
    kept = [c for c in docs.columns if c not in ("id", "content", "chunk_index", "chunk_total", "parent_id", "_n", "_error", "_ms", *own)] if config.keep_parent_fields else []
    before = [c for c in ("_error", "_ms") if c in docs.columns]
    made = docs.select(F.col("id").alias("parent_id"), base_tag(F.col("id"), MAX_SUFFIX).alias("__tag"), *kept, *own, *before, chunks(F.col("content"), config).alias("parts"))
    parts = made.withColumn("chunk_total", F.size("parts"))  # before they are taken apart, else each chunk's row carries them all
    rows = parts.select("parent_id", "__tag", *kept, *own, *before, "chunk_total", F.posexplode_outer("parts").alias("chunk_index", "content"))
    id_ = F.when(F.col("chunk_index").isNotNull(), suffixed_id(F.col("parent_id"), F.concat(F.lit("_"), F.col("chunk_index").cast("string")), F.col("__tag")))
    return metered(rows.select(id_.alias("id"), *kept, "content", "chunk_index", "chunk_total", "parent_id", *own, *before)).withColumn("_n", F.col("chunk_index"))


def chunk_documents(docs: DataFrame, config: ChunkConfig | None = None) -> DataFrame:
    """docs: id, title, content, fields, meta columns. One row a chunk with chunk_index, chunk_total and parent_id; empty documents give none."""
    return strict(chunked(docs, config))
