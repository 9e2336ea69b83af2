"""Parquet files to documents by Spark's own scan: splits of a file in tasks of their own, only the named columns read, no Python.

Rows are those of parquet.parquet_documents() on the same files, with these differences: a file has no limit of rows or
bytes, since nothing is held whole; times with a zone are told in UTC (the zone's name is not the file's); numbers in JSON are
written as the JVM writes them.
"""

from __future__ import annotations

from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ids import MAX_STEM, filename_id_stem, id_stem, sanitize_id
from .documents import DOC_SCHEMA
from .json_records import FlattenConfig, InvalidConfig
from .parquet import NUMERIC_DIGITS


def _json(value: Column, kind: T.DataType) -> Column:
    """A value as JSON text (a number that is none as null); null for null."""
    if isinstance(kind, T.StringType):
        return _quoted(value)
    if isinstance(kind, T.BooleanType | T.IntegralType):
        return value.cast("string")
    if isinstance(kind, T.DecimalType):
        if kind.precision > NUMERIC_DIGITS:
            return _quoted(value.cast("string"))
        return value.cast("long").cast("string") if kind.scale <= 0 else value.cast("double").cast("string")
    if isinstance(kind, T.FractionalType):
        return F.when(F.isnan(value) | (F.abs(value) == float("inf")), F.lit("null")).otherwise(value.cast("string"))
    if isinstance(kind, T.DateType):
        return _quoted(value.cast("string"))
    if isinstance(kind, T.TimestampType | T.TimestampNTZType):
        return _quoted(_moment(value, isinstance(kind, T.TimestampType)))
    if isinstance(kind, T.BinaryType):
        return _quoted(F.lower(F.hex(value)))
    if isinstance(kind, T.ArrayType):
        items = F.transform(value, lambda x: F.coalesce(_json(x, kind.elementType), F.lit("null")))
        return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), _object(F.array(*(_entry(F.lit(f.name), _json(value[f.name], f.dataType)) for f in kind))))
    if isinstance(kind, T.MapType):
        return F.when(value.isNotNull(), _object(F.transform(F.map_entries(value), lambda e: _entry(e["key"].cast("string"), _json(e["value"], kind.valueType)))))
    raise InvalidConfig(f"invalid input: column type {kind.simpleString()} is not supported")


def _quoted(text: Column) -> Column:
    """A JSON string: to_json() of an array of it, without the brackets."""
    return F.when(text.isNotNull(), F.regexp_extract(F.to_json(F.array(text)), r"(?s)^\[(.*)\]$", 1))


def _moment(value: Column, zoned: bool) -> Column:
    """ISO date and time, with 3 or 6 digits of a second where there are any."""
    local = F.to_utc_timestamp(value, F.current_timezone()) if zoned else value  # shown in the session's zone below
    micros = F.date_format(local, "SSSSSS")
    part = F.when(micros == "000000", F.lit("")).when(micros.endswith("000"), F.concat(F.lit("."), F.left(micros, F.lit(3)))).otherwise(F.concat(F.lit("."), micros))
    return F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), part, F.lit("Z" if zoned else ""))


def _entry(key: Column, text: Column) -> Column:
    return F.struct(key.alias("k"), text.alias("v"))


def _object(entries: Column) -> Column:
    known = F.array_sort(F.filter(entries, lambda e: e["v"].isNotNull()))
    return F.concat(F.lit("{"), F.array_join(F.transform(known, lambda e: F.concat(_quoted(e["k"]), F.lit(":"), e["v"])), ","), F.lit("}"))


def _said(kind: T.DataType) -> bool:
    """Whether a value of this type is a string in JSON."""
    return isinstance(kind, T.StringType | T.BinaryType | T.DateType | T.TimestampType | T.TimestampNTZType) or (isinstance(kind, T.DecimalType) and kind.precision > NUMERIC_DIGITS)


def _string(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.BinaryType):
        return F.lower(F.hex(value))
    return _moment(value, isinstance(kind, T.TimestampType)) if isinstance(kind, T.TimestampType | T.TimestampNTZType) else value.cast("string")


def _strings(value: Column, kind: T.DataType, apart: bool = False) -> Column:
    """The strings of a field: its own, or those of its list."""
    none = F.array().cast("array<string>")
    if _said(kind):
        return F.coalesce(F.when(value.isNotNull(), F.array(_string(value, kind))), none)
    if isinstance(kind, T.ArrayType) and _said(kind.elementType):
        return F.coalesce(F.filter(F.transform(value, lambda x: _string(x, kind.elementType)), lambda x: x.isNotNull()), none)
    if apart and isinstance(kind, T.MapType) and _said(kind.valueType):
        return F.coalesce(F.transform(F.array_sort(F.map_entries(value)), lambda e: _string(e["value"], kind.valueType)), none)
    return none


#: A field of the flattened row: its dotted name, value, type, and whether a map is taken apart.
Leaf = tuple[str, Column, T.DataType, bool]


def _leaves(name: str, value: Column, kind: T.DataType, config: FlattenConfig, depth: int = 1) -> tuple[list[Leaf], list[tuple[str, Column]]]:
    """The parts of a column, and the structs that are empty objects if no part of theirs is there; arrays and what lies max_depth deep stay whole."""
    if not isinstance(kind, T.StructType) or not len(kind) or depth >= config.max_depth:
        return [(name, value, kind, depth < config.max_depth)], []
    empty = reduce(lambda a, b: a & b, (value[f.name].isNull() for f in kind), value.isNotNull())
    leaves, bare = [], [(name, empty)]
    for f in kind:
        below = _leaves(f"{name}.{f.name}", value[f.name], f.dataType, config, depth + 1)
        leaves, bare = leaves + below[0], bare + below[1]
    return leaves, bare


def scan(spark: SparkSession, path: str, columns: list[str] | None = None, max_rows: int | None = None, **flatten) -> DataFrame:
    """id, title, content, fields of every row of the Parquet files at path; ids are the id field's or else `<stem>_r<n>` by the row's place in its file."""
    return _scanned(spark, path, columns, max_rows, **flatten).drop("filename")


def documents(spark: SparkSession, path: str, **config) -> DataFrame:
    """The rows and columns that the operator gives for the files at path as blobs (documents.read_blobs()), for files of any size."""
    none = {f.name: F.lit(None).cast(f.dataType) for f in DOC_SCHEMA} | {"mime": F.lit(None).cast("string")}
    made = _scanned(spark, path, **config)
    return made.select(*((F.col(c) if c in made.columns else none[c]).alias(c) for c in (*DOC_SCHEMA.names, "filename", "mime")))


def _scanned(spark: SparkSession, path: str, columns: list[str] | None = None, max_rows: int | None = None, **flatten) -> DataFrame:
    config = FlattenConfig(**flatten)
    if (max_rows is not None and max_rows < 1) or (columns is not None and not columns):
        raise InvalidConfig("invalid config: max_rows must be 1 or more and columns, when set, not empty")
    read = spark.read.parquet(path)
    for c in columns or []:
        try:
            read.select(c)
        except Exception:  # noqa: BLE001
            raise InvalidConfig(f"invalid config: columns refers to unknown column {c!r} (available: {', '.join(read.columns)})") from None
    files = [unquote(x.rsplit("/", 1)[-1]) for x in read.inputFiles()]
    plain = all(x.isascii() and len(x) <= MAX_STEM for x in files)  # else stems have tags, which Python makes
    name = F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))
    rows = read.select(*(columns or read.columns), name.alias("__name"), (filename_id_stem(name, ascii_only=True) if plain else id_stem(name, F.lit(None).cast("string"))).alias("__stem"), (F.col("_metadata.row_index") + 1).alias("__n"))
    if max_rows:
        rows = rows.where(F.col("__n") <= max_rows)
    kinds = {f.name: f.dataType for f in rows.schema if f.name not in ("__name", "__stem", "__n")}
    parts = [_leaves(c, F.col(f"`{c}`"), kind, config) for c, kind in kinds.items()]
    leaves = {n: (v, t, apart) for found, _ in parts for n, v, t, apart in found}
    text = lambda n: _text(*leaves[n][:2]) if n in leaves else F.lit(None).cast("string")
    used = [config.id_field, config.title_field, *(config.content_fields or ())]
    fields = {n: x for n, x in leaves.items() if n not in used}
    dotted = {n for n, (_, t, apart) in fields.items() if apart and isinstance(t, T.MapType)}  # their keys are names too
    whole = [_entry(F.lit(n), _json(v, t)) for n, (v, t, _) in fields.items() if n not in dotted]
    whole += [_entry(F.lit(n), F.when(empty, F.lit("{}"))) for _, bare in parts for n, empty in bare]
    entries = [F.array(*whole) if whole else F.array().cast("array<struct<k:string,v:string>>"), *(_dotted(n, *fields[n][:2]) for n in sorted(dotted))]
    every = reduce(F.concat, entries)
    if config.content_fields is None:
        found = [_strings(v, t, apart) for _, (v, t, apart) in sorted(fields.items(), key=lambda x: x[0])]
        content = F.array_join(F.filter(F.concat(*found) if found else F.array().cast("array<string>"), lambda x: x != ""), " ")
    else:
        content = F.concat_ws(" ", *(F.nullif(text(n), F.lit("")) for n in config.content_fields)) if config.content_fields else F.lit("")
    given = F.nullif(text(config.id_field), F.lit(""))
    made = F.concat("__stem", F.lit("_r"), F.col("__n").cast("string"))
    title = F.nullif(text(config.title_field), F.lit("")) if config.title_field else F.lit(None).cast("string")
    return rows.select(F.coalesce(F.when(given.isNotNull(), sanitize_id(given)), made).alias("id"), title.alias("title"), content.alias("content"), _object(every).alias("fields"), F.col("__name").alias("filename"))


def _dotted(name: str, value: Column, kind: T.MapType) -> Column:
    none = F.array().cast("array<struct<k:string,v:string>>")
    each = lambda e: _entry(F.concat(F.lit(f"{name}."), e["key"].cast("string")), _json(e["value"], kind.valueType))
    # an empty object stays as it is
    return F.coalesce(F.when(F.size(value) > 0, F.transform(F.map_entries(value), each)).when(F.size(value) == 0, F.array(_entry(F.lit(name), F.lit("{}")))), none)


def _text(value: Column, kind: T.DataType) -> Column:
    """A value as the text of an id, title or content."""
    if isinstance(kind, T.ArrayType):
        return F.array_join(_strings(value, kind), " ")
    return _string(value, kind) if _said(kind) else _json(value, kind)
