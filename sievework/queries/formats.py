"""Queries of the file formats: every event becomes a small file, which the operator of its format reads back."""

from __future__ import annotations

import gzip
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audio, csv, enrich, html, json_records
from ..plans.catalog import OPERATORS
from ..sources import url
from . import files
from .base import query, scalar, table


def _files(spark: SparkSession, d: str, made: Column | None = None, build=None, ext: str = "bin") -> DataFrame:
    """event_id and a blob row for each event; the file's name tells the event."""
    data = made if made is not None else F.udf(build, "binary", useArrow=True)("event_id", "event_type")
    none = F.lit(None).cast("string")
    return table(spark, d, "events").select(data.alias("data"), none.alias("mime"), F.concat(F.lit("f"), F.col("event_id").cast("string"), F.lit("." + ext)).alias("filename"), none.alias("origin"), none.alias("charset"))


_event = lambda: F.regexp_extract("filename", r"\d+", 0).cast("long").alias("event_id")
_field = lambda key: F.get_json_object("fields", f"$.{key}")


def _msgpack() -> Column:
    n = F.unhex(F.lpad(F.hex("event_id"), 8, "0"))
    return F.concat(F.unhex(F.lit("82A16BCE")), n, F.unhex(F.lit("A174")), F.unhex(F.hex(160 + F.length("event_type"))), F.encode("event_type", "UTF-8"))


query("msgpack_parse", "SELECT event_id, event_id AS k, event_type AS t FROM events")(lambda spark, d: OPERATORS["msgpack_parser"](_files(spark, d, _msgpack()), {}).select(_event(), _field("k").cast("long").alias("k"), _field("t").alias("t")))
query("avro_parse", "SELECT event_id, event_id - 500 AS n, event_type AS s FROM events UNION ALL SELECT event_id, event_id, NULL FROM events")(
    lambda spark, d: OPERATORS["avro_parser"](_files(spark, d, build=files.avro_file, ext="avro"), {}).select(_event(), _field("n").cast("long").alias("n"), _field("s").alias("s"))
)
query("xlsx_extract", "SELECT event_id, 2 AS row, event_type AS name, event_id::DOUBLE AS n FROM events UNION ALL SELECT event_id, 4, NULL, event_id / 2 FROM events")(
    lambda spark, d: OPERATORS["xlsx_extractor"](_files(spark, d, build=files.xlsx_file, ext="xlsx"), {}).select(_event(), _field("_row").cast("int").alias("row"), _field("name").alias("name"), _field("n").cast("double").alias("n"))
)
query("docx_extract", "SELECT event_id, event_type || chr(10) || chr(10) || 'second ' || event_id || chr(10) || chr(10) || event_id || chr(9) || 'b' AS content FROM events")(
    lambda spark, d: OPERATORS["docx_extractor"](_files(spark, d, build=files.docx_file, ext="docx"), {}).select(_event(), "content")
)
query("pptx_extract", "SELECT event_id, event_type || chr(10) || 'body ' || event_id AS content, 'f' || event_id || '_s1' AS id FROM events UNION ALL SELECT event_id, 'last ' || event_id, 'f' || event_id || '_s2' FROM events")(
    lambda spark, d: OPERATORS["pptx_extractor"](_files(spark, d, build=files.pptx_file, ext="pptx"), {}).select(_event(), "content", "id")
)
query("markdown_extract", "SELECT event_id, 'One ' || event_id AS title, 'body ' || event_type AS content FROM events UNION ALL SELECT event_id, 'Two', 'a b' FROM events")(
    lambda spark, d: OPERATORS["markdown_extractor"](_files(spark, d, F.encode(F.concat(F.lit("# One "), F.col("event_id").cast("string"), F.lit("\n\nbody *"), F.col("event_type"), F.lit("*\n\n# Two\n\n[a b](https://x)\n")), "UTF-8"), ext="md"), {}).select(_event(), "title", "content")
)
query("archive_expand", "SELECT event_id, 'a/one.txt' AS path, 'file' AS status, event_type AS text FROM events WHERE event_id % 2 = 1 UNION ALL SELECT event_id, '../out', 'skipped', NULL FROM events WHERE event_id % 2 = 1 UNION ALL SELECT event_id, 'two.txt.gz', 'file', '' FROM events WHERE event_id % 2 = 1 UNION ALL SELECT event_id, 'in.txt', 'file', event_id::VARCHAR FROM events WHERE event_id % 2 = 0")(
    lambda spark, d: OPERATORS["archive_expander"](_files(spark, d, build=files.archive_file, ext="zip"), {}).select(_event(), "path", "status", F.decode("data", "UTF-8").alias("text"))
)
query("gunzip", "SELECT event_id, event_type AS text FROM events")(
    lambda spark, d: table(spark, d, "events").select("event_id", F.decode(url.maybe_gunzip(F.when(F.col("event_id") % 3 == 0, F.encode("event_type", "UTF-8")).otherwise(F.udf(lambda t: gzip.compress(t.encode(), mtime=0), "binary", useArrow=True)("event_type"))), "UTF-8").alias("text"))
)
query("wav_duration", "SELECT event_id, (event_id % 7)::DOUBLE AS secs FROM events")(lambda spark, d: _files(spark, d, build=files.wav_file, ext="wav").select(_event(), F.udf(lambda b: audio.duration(bytes(b)), "double", useArrow=True)("data").alias("secs")))
query("html_decode", "SELECT event_id, 'é' || event_id AS text FROM events")(
    lambda spark, d: _files(spark, d, F.when(F.col("event_id") % 2 == 0, F.encode(F.concat(F.lit('<meta charset="iso-8859-1"><p>é'), F.col("event_id").cast("string")), "ISO-8859-1")).otherwise(F.encode(F.concat(F.lit("<p>é"), F.col("event_id").cast("string")), "UTF-8"))).select(_event(), F.regexp_extract(F.udf(lambda b: html.decode_html(bytes(b)), "string", useArrow=True)("data"), "<p>(.*)$", 1).alias("text"))
)
query("csv_decode", "SELECT event_id, 'naïve,é ' || event_id AS text FROM events")(
    lambda spark, d: _files(spark, d, F.when(F.col("event_id") % 3 == 0, F.concat(F.unhex(F.lit("EFBBBF")), F.encode(F.concat(F.lit("naïve,é "), F.col("event_id").cast("string")), "UTF-8"))).when(F.col("event_id") % 3 == 1, F.encode(F.concat(F.lit("naïve,é "), F.col("event_id").cast("string")), "ISO-8859-1")).otherwise(F.encode(F.concat(F.lit("naïve,é "), F.col("event_id").cast("string")), "UTF-8"))).select(_event(), F.udf(lambda b: csv.decode(bytes(b)), "string", useArrow=True)("data").alias("text"))
)
query("csv_columns", """SELECT event_id, n, CASE n WHEN 4 THEN event_type ELSE name END AS name FROM events, (VALUES (0, 'a'), (1, 'a_2'), (2, 'col_3'), (3, '_row'), (4, ''), (5, 'col_6')) t(n, name)""")(
    lambda spark, d: table(spark, d, "events").select("event_id", F.posexplode(F.udf(lambda kind: csv.column_names(["a", "a", "", "_row", kind], 6), "array<string>", useArrow=True)("event_type")).alias("n", "name"))
)
scalar("key_collision", ['{"a": {"b": #}, "a.b": 1}', '{"a.b": #}', '{"x": {"y": {"z": "#"}}}'], lambda x: F.udf(lambda t: json_records.dumps(json_records.flatten(json.loads(t), json_records.FlattenConfig())), "string", useArrow=True)(x), """CASE event_id % 3 WHEN 0 THEN '{{"a.b":' || event_id || ',"a.b_2":1}}' WHEN 1 THEN '{{"a.b":' || event_id || '}}' ELSE '{{"x.y.z":"' || event_id || '"}}' END""")
query("html_links", "SELECT page_id, 0 AS n, '/a/' || page_id AS href FROM pages UNION ALL SELECT page_id, 1, 'https://x.org/?q=1&r=2' FROM pages")(
    lambda spark, d: html.extract_pages(table(spark, d, "pages").select("page_id", F.concat(F.lit('<nav><a href="/nav">n</a></nav><main><h1>T</h1><p>see <a href="/a/'), F.col("page_id").cast("string"), F.lit('">one</a> and <a href="https://x.org/?q=1&amp;r=2">two</a></p></main>')).alias("html"))).select("page_id", F.posexplode("links").alias("n", "href"))
)


query("declined", "SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE upper(event_type) END AS title, CASE WHEN event_type <> 'error' THEN length(event_type) END AS n, CASE WHEN event_id % 2 = 0 THEN 'old' WHEN event_type <> 'error' THEN 'new' END AS kind, 'en' AS language FROM events")(
    lambda spark, d: enrich.enrich(table(spark, d, "events").select("event_id", F.lit(None).cast("string").alias("title"), F.col("event_type").alias("content"), F.lit("en").alias("language"), F.when(F.col("event_id") % 2 == 0, F.lit('{"kind":"old"}')).otherwise(F.lit("{}")).alias("fields")), files.stub).select("event_id", "title", F.get_json_object("fields", "$.n").cast("int").alias("n"), F.get_json_object("fields", "$.kind").alias("kind"), "language")
)
_ASKED = {"tone": {"kind": "choice", "options": ["click", "view", "error", "signup", "purchase"]}, "odd": {"kind": "yesno", "threshold": 0.5}, "level": {"kind": "score", "levels": 5}}
query("jev_answers", "SELECT event_id, event_type AS tone, (event_id % 4) / 4.0 >= 0.5 AS odd, event_id % 5 AS level, ((event_id % 4) / 4.0)::DOUBLE AS confidence FROM events")(
    lambda spark, d: (lambda answered: table(spark, d, "events").select("event_id", F.from_json(answered("event_id", "event_type"), "tone string, odd boolean, level long, tone_confidence double").alias("a")).select("event_id", "a.tone", "a.odd", "a.level", F.col("a.tone_confidence").alias("confidence")))(
        F.udf(lambda n, t: json.dumps(enrich.answer_fields(_ASKED, {"tone": {"value": t, "confidence": n % 4 / 4}, "odd": {"confidence": n % 4 / 4}, "level": {"value": n % 5, "confidence": 1.0}})), "string", useArrow=True)
    )
)
