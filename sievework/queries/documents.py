"""Queries of extraction, chunking, routing, scripts and streams."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import mime
from ..operators import chunker, csv, csv_scan, enrich, html, json_records, route, script, sink
from ..plans.builtin import BUILTIN
from ..plans.catalog import OPERATORS
from ..sources import url
from ..streaming import usage_stream
from .base import query, scalar, shared_folder, sql_text, table


def _docs(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.lit(None).cast("string").alias("title"), F.col("text").alias("content"), F.lit("{}").alias("fields"), "lang")


def _chunked(strategy: str, **config):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return chunker.chunk_documents(_docs(spark, d), chunker.ChunkConfig(strategy, **config)).select("id", "content", "chunk_index", "chunk_total", "parent_id")

    return run


query("chunk_fixed", r"""WITH RECURSIVE src AS (SELECT doc_id, t, length(t) AS n FROM (SELECT doc_id, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS t FROM documents)),
 r AS (SELECT doc_id, t, n, 0 AS k, 0 AS st, CASE WHEN n <= 2000 THEN n ELSE coalesce(999 + nullif(length(regexp_extract(substr(t, 1000, 1001), '(?s)^.*\s')), 0), 2000) END AS cut FROM src WHERE n > 0
  UNION ALL SELECT doc_id, t, n, k + 1, cut - 200, CASE WHEN n - (cut - 200) <= 2000 THEN n ELSE (cut - 200) + coalesce(999 + nullif(length(regexp_extract(substr(t, (cut - 200) + 1000, 1001), '(?s)^.*\s')), 0), 2000) END FROM r WHERE cut < n),
 m AS (SELECT *, max(k) OVER (PARTITION BY doc_id) AS mk, lead(cut - st) OVER (PARTITION BY doc_id ORDER BY k) AS nl, lead(cut) OVER (PARTITION BY doc_id ORDER BY k) AS nc FROM r),
 z AS (SELECT doc_id, k, t, st, CASE WHEN k = mk - 1 AND nl < 232 THEN nc ELSE cut END AS cut FROM m WHERE NOT (k = mk AND mk > 0 AND cut - st < 232))
 SELECT doc_id || '_' || k AS id, trim(substr(t, st + 1, cut - st), ' ' || chr(9) || chr(10) || chr(13)) AS content, k AS chunk_index, (count(*) OVER (PARTITION BY doc_id))::INT AS chunk_total, doc_id::VARCHAR AS parent_id FROM z""")(_chunked("fixed", chunk_size=2000, overlap=200, min_chunk_size=232))
_WS = "' ' || chr(9) || chr(10) || chr(13)"


def _tail_sql(text: str, most: str) -> str:
    """The last words of a text in so many characters."""
    return f"""CASE WHEN {most} <= 0 THEN '' WHEN length({text}) <= {most} THEN {text} ELSE ltrim(CASE WHEN regexp_matches(substr({text}, length({text}) - {most}, 1), '[ \\t\\n\\r]') THEN right({text}, {most})
  ELSE regexp_replace(right({text}, {most}), '(?s)^[^ \\t\\n\\r]*', '') END, {_WS}) END"""


def _packed_sql(split: str, joint: str, size: int, overlap: int, least: int) -> str:
    """Units of texts packed into chunks, unit by unit; `split` gives a text's units as a list. Units over the size are cut as chunk_fixed cuts, without overlap."""
    half = size // 2
    cut = f"CASE WHEN length(u) - {{st}} <= {size} THEN length(u) ELSE coalesce({{st}} + {half - 1} + nullif(length(regexp_extract(substr(u, ({{st}}) + {half}, {size - half + 1}), '(?s)^.*[ \\t\\n\\r]')), 0), {{st}} + {size}) END"
    return f"""WITH RECURSIVE src AS (SELECT doc_id, trim(text, {_WS}) AS t FROM documents),
 whole AS (SELECT doc_id, unnest(range(len(l))) AS k, unnest(l) AS u FROM (SELECT doc_id, {split} AS l FROM src WHERE length(t) > {size})),
 w AS (SELECT doc_id, k, u, 0 AS st, {cut.format(st="0")} AS e FROM whole UNION ALL SELECT doc_id, k, u, e, {cut.format(st="e")} FROM w WHERE e < length(u)),
 units AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k, st) AS k, trim(substr(u, st + 1, e - st), {_WS}) AS u FROM w WHERE trim(substr(u, st + 1, e - st), {_WS}) <> ''),
 p AS (SELECT doc_id, k, 0 AS n, '' AS seed, u AS held FROM units WHERE k = 1
  UNION ALL SELECT doc_id, k, n + opens::INT, CASE WHEN opens THEN {_tail_sql("tail", f"least({overlap}, greatest(0, {size} - length(u) - length({joint})))")} ELSE seed END, CASE WHEN opens THEN u ELSE held || {joint} || u END
  FROM (SELECT *, length(said || {joint} || u) > {size} AS opens, {_tail_sql("said", str(overlap))} AS tail FROM
   (SELECT p.doc_id, units.k, n, seed, held, units.u, CASE WHEN seed = '' THEN held ELSE seed || {joint} || held END AS said FROM p JOIN units ON units.doc_id = p.doc_id AND units.k = p.k + 1))),
 c AS (SELECT doc_id, n, arg_max(CASE WHEN seed = '' THEN held ELSE seed || {joint} || held END, k) AS text, arg_max(held, k) AS held FROM p GROUP BY 1, 2),
 m AS (SELECT *, max(n) OVER (PARTITION BY doc_id) AS last, lead(text) OVER (PARTITION BY doc_id ORDER BY n) AS next, lead(held) OVER (PARTITION BY doc_id ORDER BY n) AS next_held FROM c),
 out AS (SELECT doc_id, n, CASE WHEN n = last - 1 AND length(next) < {least} THEN text || {joint} || next_held ELSE text END AS text FROM m WHERE NOT (n = last AND n > 0 AND length(text) < {least}) UNION ALL SELECT doc_id, 0, t FROM src WHERE length(t) BETWEEN 1 AND {size})
 SELECT doc_id || '_' || n AS id, text AS content, n AS chunk_index, (count(*) OVER (PARTITION BY doc_id))::INT AS chunk_total, doc_id::VARCHAR AS parent_id FROM out"""


_SENTENCES = f"""list_filter(list_transform(string_split(regexp_replace(t, '([.!?])[ \\t\\n\\r]', '\\1' || chr(10), 'g'), chr(10)), lambda x: trim(x, {_WS})), lambda x: x <> '')"""
_PARAGRAPHS = f"""list_filter(list_transform(string_split(regexp_replace(replace(t, chr(13) || chr(10), chr(10)), '\\n([ \\t\\r]*\\n)+', chr(1), 'g'), chr(1)), lambda x: trim(x, {_WS})), lambda x: x <> '')"""
query("chunk_sentence", _packed_sql(_SENTENCES, "' '", 512, 64, 32))(_chunked("sentence"))
query("chunk_paragraph", _packed_sql(_PARAGRAPHS, "chr(10) || chr(10)", 800, 80, 32))(_chunked("paragraph", chunk_size=800, overlap=80))
query("chunk_meta", """WITH a AS (SELECT conv_id, turn, role, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS t FROM conversations) SELECT conv_id || '-' || turn || '_0' AS id, t AS content, 0 AS chunk_index, 1 AS chunk_total, conv_id || '-' || turn AS parent_id, role FROM a WHERE t <> ''""")(
    lambda spark, d: chunker.chunk_documents(table(spark, d, "conversations").select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), F.col("text").alias("content"), "role"), chunker.ChunkConfig(chunk_size=1_000_000)).select("id", "content", "chunk_index", "chunk_total", "parent_id", "role")
)
query("html_extract")(lambda spark, d: html.extract_pages(table(spark, d, "pages")))


# the registry's step: ids, language, and description and links among the fields
query("html_step")(lambda spark, d: OPERATORS["html_extractor"](_page_files(spark, d), {"extract_links": True}).select("id", "title", "content", "language", "fields"))
def _page_files(spark, d) -> DataFrame:
    none = F.lit(None).cast("string")
    return table(spark, d, "pages").select(F.col("html").cast("binary").alias("data"), none.alias("mime"), F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit(".html")).alias("filename"), none.alias("origin"), none.alias("charset"))


# of all pages; references in titles are followed by SQL as far as pages have them
_NAMED = {"lt": "<", "gt": ">", "quot": '"', "#39": "''", "amp": "&"}
_TITLE = r"regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"
for _name, _char in _NAMED.items():
    _TITLE = f"regexp_replace({_TITLE}, '&{_name};?', '{_char}', 'g')"
_TITLES = rf"SELECT page_id, trim(regexp_replace({_TITLE}, '\s+', ' ', 'g')) AS title FROM pages"
query("html_title", _TITLES)(lambda spark, d: html.extract_pages(table(spark, d, "pages")).select("page_id", "title"))
query("html_title_all", _TITLES)(lambda spark, d: OPERATORS["html_extractor"](_page_files(spark, d), {}).select(F.regexp_extract("id", r"^p(\d+)$", 1).cast("long").alias("page_id"), "title"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Pages to index documents: extract, chunk, and the index's JSON."""
    pages = html.extract_pages(table(spark, d, "pages")).select(F.concat(F.lit("page_"), F.col("page_id").cast("string")).alias("id"), "title", "content", "language")
    chunks = chunker.chunk_documents(pages)
    meta = F.struct("language", "chunk_index", "chunk_total", "parent_id")
    return chunks.select("id", sink.index_json(F.col("id"), F.col("title"), F.col("content"), {}, meta).alias("json"))


query("html_pipeline")(flagship)
# text files through the step that reads them
query("text_scan", "SELECT 't' || doc_id || '_0' AS id, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS content FROM documents WHERE trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> ''")(
    lambda spark, d: OPERATORS["chunker"](
        table(spark, d, "documents").select(F.col("text").cast("binary").alias("data"), F.lit("text/plain").alias("mime"), F.concat(F.lit("t"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"), F.lit(None).cast("string").alias("origin"), F.lit(None).cast("string").alias("charset")),
        {"chunk_size": 1_000_000},
    ).select("id", "content")
)

def _files(spark, d, text: str, ending: str) -> DataFrame:
    """A file of each event; # stands for its number."""
    data = F.replace(F.lit(text), F.lit("#"), F.col("event_id").cast("string")).cast("binary")
    none = F.lit(None).cast("string")
    return table(spark, d, "events").select("event_id", data.alias("data"), none.alias("mime"), F.concat(F.lit("f"), F.col("event_id").cast("string"), F.lit(ending)).alias("filename"), none.alias("origin"), none.alias("charset"))



# JSON
def _payloads(spark, d) -> DataFrame:
    none = F.lit(None).cast("string")
    return table(spark, d, "events").select(F.col("props").cast("binary").alias("data"), none.alias("mime"), F.concat(F.lit("ev"), F.col("event_id").cast("string"), F.lit(".json")).alias("filename"), none.alias("origin"), none.alias("charset"))


query("json_flatten", """SELECT 'ev' || event_id || '_0' AS id, event_id, json_extract_string(props, '$.k')::BIGINT AS k, '' AS content FROM events""")(
    lambda spark, d: OPERATORS["json_flattener"](_payloads(spark, d), {}).select("id", F.regexp_extract("filename", r"-?\d+", 0).cast("long").alias("event_id"), F.get_json_object("fields", "$.k").cast("long").alias("k"), "content")
)
# ids that the records have
query("json_ids", """SELECT json_extract_string(props, '$.k') AS id, '{}' AS fields FROM events""")(lambda spark, d: OPERATORS["json_flattener"](_payloads(spark, d), {"id_field": "k"}).select("id", "fields"))
query("reflatten", "SELECT event_id, event_type AS content, json_extract_string(props, '$.k') AS k FROM events")(
    lambda spark, d: json_records.reflatten(table(spark, d, "events").select("event_id", F.concat(F.lit("ev"), F.col("event_id").cast("string")).alias("id"), F.lit(None).cast("string").alias("title"), F.col("event_type").alias("content"), F.col("props").alias("fields")))
    .select("event_id", "content", F.get_json_object("fields", "$.k").alias("k"))
)
_WRAPPED = ['{"documents": [{"id": #}, {"id": 1}]}', '{"data": [1, 2, 3]}', '[{"id": 1}]', '{"data": 3, "items": [{"x": #}]}', '{"hits": {}}', '{"results": []}']
query("json_roots", f"SELECT event_id, n::INT AS n FROM (SELECT event_id, unnest(range(CASE event_id % 6 WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 1 WHEN 3 THEN 1 WHEN 4 THEN 1 ELSE 0 END)) AS n FROM events)")(
    lambda spark, d: json_records.flatten_payloads(table(spark, d, "events").select(F.col("event_id").alias("stem"), F.replace(F.get(F.array(*map(F.lit, _WRAPPED)), (F.col("event_id") % 6).cast("int")), F.lit("#"), F.col("event_id").cast("string")).alias("data"))).select(F.col("stem").alias("event_id"), "n")
)
scalar("json_wrapper_key", _WRAPPED, json_records.wrapper_key, "CASE event_id % 6 WHEN 0 THEN 'documents' WHEN 1 THEN 'data' WHEN 3 THEN 'items' WHEN 5 THEN 'results' END")
# records below a pointer
query("json_pointer", """SELECT 'f' || event_id || '_' || n AS id, '{"v":' || CASE n WHEN 0 THEN event_id ELSE 7 END || '}' AS fields FROM events, (VALUES (0), (1)) t(n)""")(
    lambda spark, d: OPERATORS["json_flattener"](_files(spark, d, '{"a": {"b/c": [{"v": #}, {"v": 7}]}, "data": [1]}', ".json"), {"root": "/a/b~1c"}).select("id", "fields")
)
scalar("inline_docs", ['{"id": "a b#", "content": "c#"}', '{"id": #, "text": "t"}', '{"id": "z", "body": "b#"}', '{"id": "q#", "content": "c", "text": "t"}'], lambda x: F.to_json(json_records.inline_documents(x)), """'{{"id":"' || regexp_replace(json_extract_string({x}, '$.id'), '[^A-Za-z0-9_-]', '_', 'g') || '","content":"' || coalesce(json_extract_string({x}, '$.content'), json_extract_string({x}, '$.text'), json_extract_string({x}, '$.body')) || '"}}'""")
_BODIES = ['[{"a": 1}]', '{"url": "u#"}', '{"s3": {"k": 1}}', '{"documents": []}', '{"items": [1]}', '{"x": #}', '{"url": "u", "documents": []}']
scalar("payload_dispatch", _BODIES, json_records.payload_kind, "CASE event_id % 7 WHEN 0 THEN 'array' WHEN 1 THEN 'url' WHEN 2 THEN 's3' WHEN 3 THEN 'documents' WHEN 4 THEN 'items' WHEN 5 THEN 'document' ELSE 'url' END")
# a record's values as the text of its content
query("value_text", """SELECT 'f' || event_id || '_0' AS id, 'x' || event_id || ' 1.5 true [{"k":[' || event_id || ']}]' AS content FROM events""")(
    lambda spark, d: OPERATORS["json_flattener"](_files(spark, d, '{"s": "x#", "n": 1.5, "b": true, "z": null, "o": [{"k": [#]}]}', ".json"), {"content_fields": ["s", "n", "b", "z", "o"]}).select("id", "content")
)
query("ndjson_sniff", f"SELECT event_id, event_id % 3 = 0 AS y FROM events")(lambda spark, d: table(spark, d, "events").select("event_id", mime.sniff_ndjson(F.get(F.array(F.lit('{"a":1}\n{"b":2}'), F.lit('{"a":1}'), F.lit("x\ny")), (F.col("event_id") % 3).cast("int"))).alias("y")))

# CSV
_FILE = "a;b;a\n1;x y;true\n\n;;\n007;-2.5;"
query(
    "csv_parse",
    """SELECT 'f' || event_id || '_r1' AS id, '1 x y true' AS content, '{"_row":1,"a":1,"a_2":true,"b":"x y"}' AS fields FROM events
 UNION ALL SELECT 'f' || event_id || '_r3', '007 -2.5', '{"_row":3,"a":"007","b":-2.5}' FROM events""",
)(lambda spark, d: OPERATORS["csv_parser"](_files(spark, d, _FILE, ".csv"), {}).select("id", "content", "fields"))
# ids from a column, which move with their records; a record without one is known by its place
query(
    "csv_ids",
    """SELECT 'k_' || event_id AS id, 'Hat' AS content, '{"_row":1,"key":"k ' || event_id || '","t":"Hat"}' AS fields FROM events
 UNION ALL SELECT 'f' || event_id || '_r2', 'Cap', '{"_row":2,"t":"Cap"}' FROM events UNION ALL SELECT event_id || '-b', 'Sock', '{"_row":3,"key":"' || event_id || '-b","t":"Sock"}' FROM events""",
)(lambda spark, d: OPERATORS["csv_parser"](_files(spark, d, "key,t\nk #,Hat\n,Cap\n#-b,Sock\n", ".csv"), {"id_column": "key", "content_columns": ["t"]}).select("id", "content", "fields"))
_DIALECTS = [("a,b\n1,2\n", ","), ("a;b\n1;2\n", ";"), ("a\tb\n1\t2\n", "\t"), ('"x,y"|b\n1|2\n', "|"), ("just text\nmore\n", ","), ("one, two\nthree, four\n", ",")]
query("csv_sniff", f"SELECT event_id, ([{', '.join(sql_text(m) for _, m in _DIALECTS)}])[event_id % 6 + 1] AS y FROM events")(
    lambda spark, d: table(spark, d, "events").select("event_id", F.udf(csv.sniff, "string", useArrow=True)(F.get(F.array(*(F.lit(t) for t, _ in _DIALECTS)), (F.col("event_id") % 6).cast("int"))).alias("y"))
)

# scripts
query("script_map", "SELECT doc_id, upper(lang) AS language, source || ':' || n_chars AS title, n_chars * 2 AS twice FROM documents")(
    lambda spark, d: script.run(table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars"), {"lang": F.upper("lang"), "title": F.concat_ws(":", "source", F.col("n_chars").cast("string")), "twice": F.col("n_chars") * 2}, rename={"lang": "language"}, drop=["source", "n_chars"])
)
query("script_filter", "SELECT doc_id FROM documents WHERE lang = 'en' AND n_chars > 500")(lambda spark, d: script.run(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), keep=(F.col("lang") == "en") & (F.col("n_chars") > 500)).select("doc_id"))
query("script_on_error", "SELECT event_id, CASE WHEN value > 50 THEN value * 2 ELSE value END AS value FROM events")(lambda spark, d: script.run(table(spark, d, "events").select("event_id", "value"), {"value": F.col("value") * 2}, valid=F.col("value") > 50, on_error="keep"))
query("script_skip", "SELECT event_id, value * 2 AS value FROM events WHERE value > 50")(lambda spark, d: script.run(table(spark, d, "events").select("event_id", "value"), {"value": F.col("value") * 2}, valid=F.col("value") > 50, on_error="skip"))
query("script_nonfinite", "SELECT event_id, event_id % 4 NOT IN (0, 1) AS y FROM events")(
    lambda spark, d: table(spark, d, "events").select("event_id", script.finite(F.when(F.col("event_id") % 4 == 0, F.lit(float("nan"))).when(F.col("event_id") % 4 == 1, F.lit(float("inf"))).otherwise(F.col("value"))).alias("y"))
)

# routing
_FILES = [("application/pdf", "a.pdf"), ("text/html; charset=x", "b.html"), ("audio/x-wav", "c.wav"), ("text/x-csv", "d#.csv"), ("application/x-ndjson", "e.ndjson"), ("application/zip", "f.zip"), ("image/jpg", "g.jpg"), ("text/plain", "notes_#.txt")]


def _blobs(spark, d):
    pick = lambda k: F.get(F.array(*(F.lit(f[k]) for f in _FILES)), (F.col("event_id") % len(_FILES)).cast("int"))
    return table(spark, d, "events").select(F.col("event_id").alias("blob_id"), pick(0).alias("mime"), F.replace(pick(1), F.lit("#"), F.col("event_id").cast("string")).alias("filename"))


def _route(spark, d):
    own = spark.createDataFrame([("mine.notes", "t1", False, "text/*", "notes_*1.txt", 0), ("all.text", None, False, "text/*", None, 0)], route.RULES)
    return route.route(_blobs(spark, d), route.builtin_rules(spark).unionByName(own), F.lit("t1"))


query("route", "SELECT event_id AS blob_id, CASE event_id % 8 WHEN 0 THEN 'builtin.pdf' WHEN 1 THEN 'all.text' WHEN 2 THEN 'builtin.audio' WHEN 3 THEN 'all.text' WHEN 4 THEN 'builtin.json' WHEN 6 THEN 'builtin.image' ELSE CASE WHEN 'notes_' || event_id || '.txt' LIKE 'notes\\_%1.txt' ESCAPE '\\' THEN 'mine.notes' ELSE 'all.text' END END AS uid FROM events WHERE event_id % 8 <> 5")(_route)
query("trigger_names_type", "SELECT event_id AS blob_id, event_id % 8 = 4 AS y FROM events")(lambda spark, d: _blobs(spark, d).select("blob_id", route.trigger_names_type(F.array(*map(F.lit, BUILTIN["builtin.json"][0])), F.col("mime")).alias("y")))
query("archive_plan", "SELECT event_id AS blob_id, CASE WHEN event_id % 8 = 5 THEN 'expand' ELSE 'pipeline' END AS y FROM events")(lambda spark, d: _blobs(spark, d).select("blob_id", route.archive_plan(F.col("mime"), F.lit(False), F.lit(False)).alias("y")))

# enrichment with a stub client
def _reply(prompt: str, text: str) -> str:
    """A reply with fields, a language and a reserved key."""
    return json.dumps({"title": "T" + text, "topic": "new", "language": "xx", "_x": 1, "n": len(text)})


def _replied(strategy: str, reserved: tuple = ()):
    """Documents that differ in what they have already, through the enricher."""

    def run(spark, d):
        n = F.col("doc_id")
        docs = table(spark, d, "documents").select(
            "doc_id", F.when(n % 2 == 1, F.lit("old")).alias("title"), n.cast("string").alias("content"), F.when(n % 3 == 1, F.lit("en")).alias("language"), F.when(n % 5 < 2, F.lit('{"topic":"old"}')).otherwise(F.lit("{}")).alias("fields")
        )
        return enrich.enrich(docs, _reply, enrich.EnrichConfig(prompt="p", merge_strategy=strategy, allow_reserved=reserved)).select("doc_id", "title", "language", "fields")

    return run


query(
    "apply_reply",
    """SELECT doc_id, CASE WHEN doc_id % 2 = 1 THEN 'old' ELSE 'T' || doc_id END AS title, CASE WHEN doc_id % 3 = 1 THEN 'en' ELSE 'xx' END AS language,
 '{"n":' || length(doc_id::VARCHAR) || ',"topic":"' || CASE WHEN doc_id % 5 < 2 THEN 'old' ELSE 'new' END || '"}' AS fields FROM documents""",
)(_replied("merge"))
query("apply_reply_replace", """SELECT doc_id, 'T' || doc_id AS title, 'xx' AS language, '{"_x":1,"n":' || length(doc_id::VARCHAR) || ',"topic":"new"}' AS fields FROM documents""")(_replied("replace", ("_x",)))


def _words(prompt: str, text: str) -> str:
    return json.dumps({"title": text[:20], "spaces": text.count(" "), "language": "xx"})


query("llm_enrich", f"""SELECT doc_id, left(text, 20) AS title, lang AS language, '{{"spaces":' || (length(x) - length(replace(x, ' ', ''))) || '}}' AS fields FROM (SELECT *, left(text, {enrich.EnrichConfig().max_input_chars}) AS x FROM documents)""")(
    lambda spark, d: enrich.enrich(table(spark, d, "documents").select("doc_id", F.lit(None).cast("string").alias("title"), F.col("text").alias("content"), F.col("lang").alias("language"), F.lit("{}").alias("fields")), _words).select("doc_id", "title", "language", "fields")
)
query("resume", "SELECT doc_id FROM documents WHERE doc_id % 3 <> 0")(lambda spark, d: enrich.resume(table(spark, d, "documents").select("doc_id"), table(spark, d, "documents").where("doc_id % 3 = 0"), ["doc_id"]))

# sources
query("state_commit", "SELECT user_id AS source_id, CASE WHEN bool_and(event_type <> 'error') THEN 'new' ELSE 'old' END AS hash FROM events GROUP BY 1")(
    lambda spark, d: (lambda e: url.commit(e.select("source_id", F.lit("old").alias("hash")).distinct(), e))(table(spark, d, "events").select(F.col("user_id").alias("source_id"), F.lit("new").alias("hash"), (F.col("event_type") != "error").alias("ok")))
)


# streams: what is available now, to a Parquet table
def _stream(spark: SparkSession, d: str, dedup: bool) -> DataFrame:
    source = f"{d}/events.parquet"
    batch = spark.read.parquet(source)
    folder, _, name = source.rpartition("/")
    events = spark.readStream.schema(batch.schema).option("pathGlobFilter", "*.parquet").parquet(source if len(batch.inputFiles()) > 1 else f"{folder}/[{name[0]}]{name[1:]}")
    shaped = events.select("ts", F.col("event_id"), F.concat(F.lit("t"), (F.col("user_id") % 5).cast("string")).alias("project_id"), F.col("event_type").alias("kind"), F.floor("value").alias("value"))
    made = usage_stream.dedup(shaped, "60 days") if dedup else usage_stream.daily_counts(usage_stream.with_event_time(shaped, "1 day"))
    path = shared_folder(spark, "stream")
    writer = made.writeStream.outputMode("append" if dedup else "complete").option("checkpointLocation", f"{path}/check").trigger(availableNow=True)
    if dedup:
        writer.format("parquet").start(f"{path}/out").awaitTermination()
    else:  # every batch has the whole result, which replaces the table
        writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{path}/out")).start().awaitTermination()
    return spark.read.schema(made.schema).parquet(f"{path}/out")


query("stream_dedup", "SELECT event_id, 't' || (user_id % 5) AS project_id, event_type AS kind FROM events")(lambda spark, d: _stream(spark, d, True).select("event_id", "project_id", "kind"))
query("stream_daily", "SELECT ts::DATE AS day, 't' || (user_id % 5) AS project_id, event_type AS kind, count(*) AS n, sum(floor(value)::BIGINT)::BIGINT AS value FROM events GROUP BY ALL")(lambda spark, d: _stream(spark, d, False))


# files that Spark wrote, read by splits
def _csv_scan(spark: SparkSession, d: str) -> DataFrame:
    path = shared_folder(spark, "csv") + "/t"
    name = F.when(F.col("c_custkey") % 3 == 0, F.concat("c_name", F.lit(', "the\nthird"'))).otherwise(F.col("c_name"))
    table(spark, d, "customer").select(F.col("c_custkey").alias("key"), name.alias("name"), F.col("c_nationkey").alias("nation")).write.option("header", "true").option("escape", '"').csv(path)
    made = csv_scan.scan_csv(spark, path, id_column="key", content_columns=["name"])
    return made.select("id", "content", F.get_json_object("fields", "$.nation").cast("int").alias("nation"))


query("csv_scan", """SELECT c_custkey::VARCHAR AS id, c_name || CASE WHEN c_custkey % 3 = 0 THEN ', "the' || chr(10) || 'third"' ELSE '' END AS content, c_nationkey AS nation FROM customer""")(_csv_scan)


def _ndjson_scan(spark: SparkSession, d: str) -> DataFrame:
    path = shared_folder(spark, "ndjson") + "/t"
    table(spark, d, "events").select(F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("t"), F.struct("user_id").alias("u"))).alias("value")).write.text(path)
    return csv_scan.scan_ndjson(spark, path).select("id", "content", "fields")


query("ndjson_scan", """SELECT event_id::VARCHAR AS id, event_type AS content, '{"t":"' || event_type || '","u.user_id":' || user_id || '}' AS fields FROM events""")(_ndjson_scan)
