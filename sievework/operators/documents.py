"""The row shape of documents, and the step from files to documents that all extractors share.

Steps of a pipeline come in two forms. As *metered rows*, every input row leaves at least one row behind: `_n` numbers
what a row became (null: nothing), `_error` says why, `_ms` is the time that Python spent; other columns whose names begin
with `_` are the caller's and pass through, and so do rows that are nothing already. strict() makes plain documents of them:
rows that are nothing go, an error fails the query.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ids import id_stem, sanitize_id

# A document's columns; fields is a JSON object.
DOC_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("title", T.StringType()),
        T.StructField("content", T.StringType(), False),
        T.StructField("fields", T.StringType()),
        T.StructField("section", T.StringType()),
        T.StructField("page", T.IntegerType()),
        T.StructField("language", T.StringType()),
    ]
)
BLOB_SCHEMA = T.StructType([T.StructField("data", T.BinaryType())] + [T.StructField(x, T.StringType()) for x in ("mime", "filename", "origin", "charset")])
_DOC = T.StructType([T.StructField("id", T.StringType()), T.StructField("suffix", T.StringType()), *DOC_SCHEMA.fields[1:]])
_MADE = T.StructType([T.StructField("docs", T.ArrayType(_DOC)), T.StructField("error", T.StringType()), T.StructField("ms", T.DoubleType())])
KEYS = _DOC.names

#: (bytes, charset that was declared) -> dicts of suffix (behind the file's stem) or an id of its own, title, content, fields (JSON text), section, page, language.
Kernel = Callable[[bytes, str | None], list[dict]]


def read_blobs(spark, path: str) -> DataFrame:
    """Files below a path as blobs."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("content").alias("data"), F.lit(None).cast("string").alias("mime"), F.element_at(F.split("path", "/"), -1).alias("filename"), F.lit(None).cast("string").alias("origin"), F.lit(None).cast("string").alias("charset"))


def carried(df: DataFrame) -> list[str]:
    """The caller's own columns."""
    return [c for c in df.columns if c.startswith("_") and c not in ("_n", "_error", "_ms")]


def said(e: Exception) -> str:
    """An error as a message: what is no text is invalid input, other errors name their kind."""
    if isinstance(e, UnicodeDecodeError):
        return f"invalid input: not valid {e.encoding} text at byte {e.start}"
    text = str(e)
    return text if text.startswith(("invalid ", "upstream")) else f"{type(e).__name__}: {text}"


def made_of(make: Callable[..., list[dict]]) -> Callable[..., dict]:
    """make(...) as a value with its error and its time."""

    def run(*args) -> dict:
        start = time.perf_counter()
        docs, error = [], None
        try:
            docs = [{k: d.get(k, "" if k in ("suffix", "content") else None) for k in KEYS} for d in make(*args)]
        except Exception as e:  # noqa: BLE001  a file's error is its row's
            error = said(e)
        return {"docs": docs, "error": error, "ms": (time.perf_counter() - start) * 1000}

    return run


def extracted(blobs: DataFrame, kernel: Kernel) -> DataFrame:
    """blobs: BLOB_SCHEMA. Metered rows: documents of DOC_SCHEMA with filename and mime; ids are pure functions of filename, origin and position."""
    one = made_of(kernel)
    run = F.udf(lambda data, charset: one(bytes(data), charset) if data is not None else None, _MADE, useArrow=True)
    charset = F.col("charset") if "charset" in blobs.columns else F.lit(None).cast("string")
    own = carried(blobs)
    made = blobs.select(*own, "filename", "mime", id_stem(F.col("filename"), F.col("origin")).alias("stem"), run("data", charset).alias("m"))
    rows = made.select(*own, "filename", "mime", "stem", F.col("m.error").alias("_error"), F.col("m.ms").alias("_ms"), F.posexplode_outer("m.docs").alias("_n", "d"))
    return rows.select(F.when(F.col("_n").isNotNull(), F.coalesce(sanitize_id(F.col("d.id")), F.concat("stem", "d.suffix"))).alias("id"), *(f"d.{c}" for c in DOC_SCHEMA.names[1:]), "filename", "mime", *own, "_n", "_error", "_ms")


def metered(rows: DataFrame, live: str = "id") -> DataFrame:
    """Rows of a step that makes one of one: `_n` is 0 but for what is nothing."""
    none = {"_error": F.lit(None).cast("string"), "_ms": F.lit(0.0)}
    return rows.withColumns({"_n": F.when(F.col(live).isNotNull(), F.lit(0))} | {k: v for k, v in none.items() if k not in rows.columns})


def strict(rows: DataFrame) -> DataFrame:
    """The documents of metered rows; an error among them fails the query."""
    ok = F.when(F.col("_error").isNull(), F.col("_n").isNotNull()).otherwise(F.raise_error(F.col("_error")).cast("boolean"))
    return rows.where(ok).drop("_n", "_error", "_ms")


def extract(blobs: DataFrame, kernel: Callable[[bytes], list[dict]]) -> DataFrame:
    return strict(extracted(blobs, lambda data, charset: kernel(data)))
