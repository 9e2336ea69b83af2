"""Secret scans: fixed patterns, and the token-efficiency test for random strings.

A run of 16 or more key characters is random when a tiktoken vocabulary needs many tokens for it: under
MOST_RATIO characters per token. Known digests (hex of MD5, SHA-1, SHA-2 length), UUIDs, numbers, timestamps and
identifiers (words of under 20 letters joined by _ - . : / in one case) are excluded first. Of a run that
overlaps fixed-pattern spans, each part outside them is tested by itself, however short. A run that is not
random as a whole is tested again between its . : / and = (each piece of 16 or more).

MOST_RATIO is calibrated: of random strings of 16 to 40 characters (base 62, base 64, base 32, letters of one case)
99 % have at most 2.0 characters a token by the default vocabulary, words of 20 or more letters nearly all over 2.1.

Defined results: null and empty text have no spans; every text is read whole; spans of the method never
overlap those of the fixed patterns; repeated rows are scanned one by one; other columns pass through.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read_table, slices, temp_name, utf8

# The base patterns, their kinds in order, and the least length of what they find.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

RUN = re.compile(r"[A-Za-z0-9+/_=.:-]{16,}")
PIECE = re.compile(r"[^.:/=]{16,}")
DIGEST = re.compile(r"(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128}|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12})\Z")
IDENTIFIER = re.compile(r"(?:[_/=+.:-]*(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4}))(?:[_/=+.:-]+(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4}))*[_/=+.:-]*\Z|[0-9_/=+.:-]+\Z")
#: A word of so many letters is no identifier by its case alone.
LONG_WORD = re.compile(r"[A-Za-z]{20}")
TIMESTAMP = re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9:.]+(?:Z|[+-][0-9:]+)?\Z")
#: Characters per token below which a run is random.
MOST_RATIO = 2.1

SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def load_vocabulary(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def base_spans(raw: bytes, text: str) -> list[tuple[int, int, str]]:
    found = []
    low = raw.lower()
    if any(x in low for x in ASSIGN_WORDS):
        found += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if b"AKIA" in raw:
        found += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def runs(text: str) -> Iterator[tuple[int, int]]:
    """Runs of key characters without full stops and colons at their ends."""
    for m in RUN.finditer(text):
        a, b = m.span()
        found = m[0]
        a, b = a + len(found) - len(found.lstrip(".:")), b - len(found) + len(found.rstrip(".:"))
        if b - a >= 16:
            yield a, b


def is_random(run: str, vocabulary) -> bool:
    if DIGEST.match(run) or TIMESTAMP.match(run) or IDENTIFIER.match(run) and not LONG_WORD.search(run):
        return False
    return len(run) < MOST_RATIO * len(vocabulary.encode_ordinary(run))


def outside(runs: Iterable[tuple[int, int]], spans: list[tuple[int, int, str]]) -> Iterator[tuple[int, int]]:
    """The parts of runs that no span covers; both in order."""
    covered: list[list[int]] = []
    for a, b, _ in spans:
        if covered and a <= covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], b)
        else:
            covered.append([a, b])
    k = 0
    for at, end in runs:
        while k < len(covered) and covered[k][1] <= at:
            k += 1
        i = k
        while i < len(covered) and covered[i][0] < end:
            if covered[i][0] > at:
                yield at, covered[i][0]
            at = covered[i][1]
            i += 1
        if at < end:
            yield at, end


def all_spans(raw: bytes, vocabulary) -> tuple[list, list]:
    """(spans of the fixed patterns, all spans), each (start, end, kind) in order."""
    text = raw.decode()
    base = base_spans(raw, text)
    more = []
    for a, b in outside(runs(text), base):
        if is_random(text[a:b], vocabulary):
            more.append((a, b, "random"))
        else:
            more += [(a + m.start(), a + m.end(), "random") for m in PIECE.finditer(text[a:b]) if m.end() - m.start() < b - a and is_random(m[0], vocabulary)]
    return base, sorted(base + more, key=lambda x: (x[0], KINDS.index(x[2])))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def scan_secrets(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, counts by base kind, digest of the base spans, and all spans."""
    vocabulary = vocabulary or default_vocabulary()
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long"

    def scan(batches):
        known = load_vocabulary(vocabulary)
        for whole in batches:
            for batch in slices(whole, "text"):
                rows = []
                for doc_id, raw in zip(batch.column("doc_id").to_pylist(), utf8(batch.column("text")), strict=True):
                    base, spans = all_spans(raw, known)
                    kinds = [x[2] for x in spans]
                    rows.append((doc_id, *(kinds.count(k) for k in KINDS[:3]), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), kinds.count("random")))
                types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                names = ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random")
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(list(zip(*rows, strict=True)) or [()] * 7, types, strict=True)], names=list(names))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, schema)


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """Each union of overlapping spans becomes [REDACTED]."""
    out, at = [], 0
    for a, b, _ in spans:
        if a >= at:
            out += [text[at:a], "[REDACTED]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """docs with every secret replaced by [REDACTED] and n_chars, where there is one, counted anew. Null stays null."""
    path, text = vocabulary or default_vocabulary(), temp_name("text")
    loaded: list = []

    @F.arrow_udf(T.StringType())
    def clean(column: pa.Array) -> pa.Array:
        if not loaded:
            loaded.append(load_vocabulary(path))
        out = []
        for raw, valid in zip(utf8(column), column.is_valid().to_pylist(), strict=True):
            spans = all_spans(raw, loaded[0])[1] if valid else []
            out.append(redact(raw.decode(), spans) if valid else None)
        return pa.array(out, pa.string())

    done = docs.withColumn(text, clean("text"))
    counted = {"n_chars": F.when(F.col(text).eqNullSafe(F.col("text")), F.col("n_chars")).otherwise(F.length(text).cast(docs.schema["n_chars"].dataType))} if "n_chars" in docs.columns else {}
    return done.withColumns(counted).withColumn("text", F.col(text)).select(*docs.columns)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(read_table(spark, sf_dir, "documents"))
