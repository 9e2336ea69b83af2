"""Delimited text to documents: charset, delimiter, column names, typed cells."""

from __future__ import annotations

import codecs
import csv
import io
import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ids import sanitize_id
from .json_records import InvalidConfig, free_name

# Candidate delimiters in order of preference, and how much of a file is looked at.
DELIMITERS, SAMPLE_BYTES, SAMPLE_RECORDS = ",;\t|", 64 << 10, 100
_INTEGER, _DECIMAL = re.compile(r"-?(?:0|[1-9][0-9]*)\Z"), re.compile(r"-?(?:0|[1-9][0-9]*)\.[0-9]+\Z")

ROWS = T.ArrayType(T.StructType([T.StructField("row", T.IntegerType()), T.StructField("id", T.StringType()), T.StructField("content", T.StringType()), T.StructField("fields", T.StringType())]))


def decode(data: bytes, declared: str | None = None, forced: str | None = None) -> str:
    """By the forced charset, a byte order mark, as UTF-8 where valid, by the declared charset, else windows-1252."""
    if forced:
        return data.decode(codecs.lookup(forced).name, "replace")
    for mark, name in ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be")):
        if data.startswith(mark):
            return data[len(mark) :].decode(name, "replace")
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        name = (declared or "").lower()
        return data.decode(name if name and name.replace("_", "-") not in ("utf-8", "utf8") else "cp1252", "replace")


def records(text: str, delimiter: str) -> list[list[str]]:
    return [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=delimiter) if r]


def sniff(text: str) -> str:
    """The candidate by which most records have one and the same number of fields; more fields, and fewer that begin with a space, decide ties."""
    sample, best = text[:SAMPLE_BYTES], (-1, -1, 0, "")
    for mark in DELIMITERS:
        found = records(sample, mark)
        if len(sample) < len(text):
            found = found[:-1]
        found = found[:SAMPLE_RECORDS]
        counts = [len(r) for r in found]
        if not counts:
            continue
        mode = max(set(counts), key=lambda n: (counts.count(n), n))
        if mode < 2:
            continue
        spaced = sum(x.startswith(" ") for r in found for x in r)
        score = (counts.count(mode) * 1000 // len(counts), mode, -spaced)
        if score > best[:3]:
            best = (*score, mark)
    return best[3] or ","


def column_names(header: list[str], width: int) -> list[str]:
    """Names of all columns: col_<n> for blank ones, later repeats with _2, _3, ...; real headers keep theirs."""
    real = {h.strip() for h in header if h.strip()}
    out, used = [], set()
    for n in range(width):
        name = header[n].strip() if n < len(header) else ""
        wanted = name or f"col_{n + 1}"
        if wanted in used or (not name and wanted in real):
            wanted = free_name(used | real, wanted)
        used.add(wanted)
        out.append(wanted)
    return out


def place_of(names: list[str], name: str, key: str, has_headers: bool) -> int:
    """A configured column's place. Headers must have it; without headers it is positional."""
    if not has_headers:
        if not (m := re.fullmatch(r"col_([1-9][0-9]*)", name)):
            raise InvalidConfig(f"invalid config: csv_parser: with has_headers false, {key} must be a positional name like col_1, not {name!r}")
        return int(m[1]) - 1
    if name not in names:
        raise InvalidConfig(f"invalid config: csv_parser: {key} names an unknown column {name!r} (available: {', '.join(names)})")
    return names.index(name)


def typed(cell: str):
    """An integer in 64 bits, a decimal number or a boolean where it is one beyond doubt; else the text."""
    if _INTEGER.match(cell) and -(1 << 63) <= int(cell) < 1 << 64:
        return int(cell)
    if _DECIMAL.match(cell):
        return float(cell)
    return {"true": True, "false": False}.get(cell.lower(), cell)


def rows(text: str, delimiter: str | None = None, has_headers: bool = True, id_column: str | None = None, content_columns: list[str] | None = None, max_rows: int | None = None, trim: bool = True) -> list[dict]:
    """A dict (row, id or null, content, fields) for each record with a cell that is not empty. `_row` is the record's number, or `_row_2` beside a column `_row`."""
    found = records(text, delimiter or sniff(text))
    header, body = (found[0], found[1:]) if has_headers and found else ([], found)
    named = column_names(header, len(header))
    id_at = place_of(named, id_column, "id_column", has_headers) if id_column else None
    content_at = None if content_columns is None else {place_of(named, c, "content_columns", has_headers) for c in content_columns}
    names = column_names(header, max(map(len, found), default=0))
    number, out = free_name(names, "_row"), []
    for n, cells in enumerate(body[:max_rows], 1):
        cells = [c.strip() for c in cells] if trim else cells
        fields = {k: typed(c) for k, c in zip(names, cells, strict=False) if c}
        if not fields:
            continue
        content = " ".join(c for k, c in enumerate(cells) if c and (content_at is None or k in content_at))
        given = cells[id_at] if id_at is not None and id_at < len(cells) and cells[id_at] else None
        out.append({"row": n, "id": given, "content": content, "fields": json.dumps(fields | {number: n}, ensure_ascii=False, separators=(",", ":"), sort_keys=True)})
    return out


def documents(data: bytes, charset: str | None = None, encoding: str | None = None, **config) -> list[dict]:
    """A file's records as documents, whose ids are the id column's or else `<stem>_r<n>`."""
    return [{"id": d["id"], "suffix": f"_r{d['row']}", "content": d["content"], "fields": d["fields"]} for d in rows(decode(data, charset, encoding), **config)]


def parse_csv(blobs: DataFrame, data: str = "data", stem: str = "stem", **config) -> DataFrame:
    """blobs: stem and text. One document for each row with a cell that is not empty: id, content, fields."""
    found = blobs.select(stem, F.explode(F.udf(lambda t: rows(t, **config), ROWS, useArrow=True)(F.col(data))).alias("d"))
    return found.select(stem, F.coalesce(sanitize_id(F.col("d.id")), F.concat(F.col(stem), F.lit("_r"), F.col("d.row").cast("string"))).alias("id"), "d.content", "d.fields", "d.row")
