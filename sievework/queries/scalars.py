"""Queries of the scalar functions, over sample texts for every event and over whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import errors, ids, mime, text
from ..operators import control
from .base import query, sample, sample_sql, scalar, sql_text, table

NAMES = ["report #.pdf", "/docs/a b/report.v#.tar.gz", "C:\\Users\\x\\file#.TXT", "dir/.hidden", "noext#", "a/b/c#.jpeg", "..", "x#.", "data-#_1.csv", "folder/sub.dir/name#"]
_LAST = r"regexp_replace(regexp_extract({x}, '[^\\]*$'), '^/+', '')"
_STEM = rf"regexp_replace({_LAST}, '([^/])\.[^./]*$', '\1')"

scalar("sanitize_id", ["a b#", "ünï#cödé", "ok-_#", "日本#", "x/y\\z #!"], ids.sanitize_id, "left(regexp_replace({x}, '[^A-Za-z0-9_-]', '_', 'g'), 511)")
scalar("filename_id_stem", NAMES, lambda x: ids.filename_id_stem(x, ascii_only=True), rf"CASE WHEN {_LAST} NOT LIKE '%/' AND length({_STEM}) > 0 THEN regexp_replace({_STEM}, '[^A-Za-z0-9_-]', '_', 'g') END")
# The tags of these origins.
_ORIGINS = {"https://example.org/a.csv": "d8e053229284", "s3://bucket/k": "4049cab18104", "é": "46d0ec742cea"}
query(
    "tag_id",
    f"SELECT event_id, x, concat_ws('_', regexp_replace(x, '[^A-Za-z0-9_-]', '_', 'g'), ([NULL, {', '.join(map(sql_text, _ORIGINS.values()))}, NULL])[event_id // 2 % 5 + 1]) AS y FROM (SELECT event_id, {sample_sql(['stem#', 'a b#'], 'event_id')} AS x FROM events)",
)(
    lambda spark, d: table(spark, d, "events")
    .select("event_id", sample(["stem#", "a b#"], F.col("event_id")).alias("x"), F.get(F.array(F.lit(None), *map(F.lit, _ORIGINS), F.lit("")), (F.floor(F.col("event_id") / 2) % 5).cast("int")).alias("origin"))
    .select("event_id", "x", ids.tag_id(F.col("x"), F.col("origin")).alias("y"))
)
scalar("suffixed_id", ["base#", "other_#"], lambda x: ids.suffixed_id(x, F.lit("_7")), "{x} || '_7'")
scalar("truncate_chars", ["short#", "éèê a longer text with number # in it", "日本語のテキスト#"], lambda x: text.truncate_chars(x, 8), "left({x}, 8)")
scalar("collapse_ws", ["  a \t b\n\nc # ", "x#", "\n", "a  b"], text.collapse_ws, r"trim(regexp_replace({x}, '\s+', ' ', 'g'))")
scalar("normalize_ws", ["a  b\n\n\n\nc\fd #", "\n\nx #\n", "p\t\tq\n \nr #"], text.normalize_ws, r"trim(regexp_replace(array_to_string(list_transform(string_split(replace({x}, chr(12), chr(10)), chr(10)), lambda l: trim(regexp_replace(l, '\s+', ' ', 'g'))), chr(10)), '\n\n\n+', chr(10) || chr(10), 'g'), chr(10))")
scalar("squeeze_blank", ["a  \n\n\n\nb#\t\n", "x \ny#", "\n\nq #"], text.squeeze_blank, r"trim(regexp_replace(array_to_string(list_transform(string_split({x}, chr(10)), lambda l: rtrim(l, ' ' || chr(9) || chr(13))), chr(10)), '\n\n\n+', chr(10) || chr(10), 'g'), chr(10))")
scalar("split_front_matter", ["---\ntitle: a#\n---\nbody", "no front #", "---\nk: v#\n...\nrest", "---\nopen #"], lambda x: F.coalesce(text.front_matter(x), F.lit("none")), r"CASE WHEN regexp_matches({x}, '(?s)^---\n(.*?)\n(---|\.\.\.)(\n|$)') THEN regexp_extract({x}, '(?s)^---\n(.*?\n)(---|\.\.\.)(\n|$)', 1) ELSE 'none' END")
scalar("strip_code_fences", ['```json\n{{"a": #}}\n```'.replace("{{", "{").replace("}}", "}"), "plain #", "```\nx#\n```", "  spaced # "], text.strip_code_fences, r"CASE WHEN trim({x}) LIKE '```%' THEN trim(regexp_replace(regexp_replace(trim({x}), '^```[A-Za-z0-9_+-]*\n', ''), '\n```$', '')) ELSE trim({x}) END")
_CELLS = ["#", "007", "+5", "1e5", "-3.25", "0.5", "00.5", "TRUE", "false", "18446744073709551615", "18446744073709551616", "-9223372036854775808", "", " 7", "NaN", "12abc", 'q"x', "-0.0", "3."]
scalar("typed_cell", _CELLS, text.typed_cell, r"CASE WHEN regexp_matches({x}, '^-?(0|[1-9][0-9]*)$') AND {x} <> '-0' AND length({x}) <= 20 AND try_cast({x} AS HUGEINT) BETWEEN -9223372036854775808 AND 18446744073709551615 THEN {x} WHEN regexp_matches({x}, '^-?(0|[1-9][0-9]*)\.[0-9]+$') THEN {x} WHEN lower({x}) IN ('true', 'false') THEN lower({x}) ELSE to_json({x})::VARCHAR END")

MESSAGES = ["", "\u00a0\n\t ", "\nTIMEOUT\u2003", "ELAPSED \u0130 #", "\u212aEY CANCEL", "Request timed out after #s", "job cancelled by user", "LLM_API_KEY not set (#)", "HTTP 401 unauthorized", "invalid input: malformed #", "upstream 503", "connection refused", "something else #", "Deadline Exceeded", "bad api key", "rate limit: too many requests"]


def _kind_sql(x: str) -> str:
    rules = " ".join(f"WHEN {' OR '.join(f'contains(m, {sql_text(p)})' for p in phrases)} THEN '{kind}'" for kind, phrases in errors.ERROR_KINDS.items())
    return f"(SELECT CASE WHEN m = '' THEN '' {rules} ELSE 'internal' END FROM (SELECT translate(trim({x}, chr(160) || chr(8195) || chr(10) || chr(9) || ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS m))"


scalar("classify_error", MESSAGES, errors.classify_error, _kind_sql("{x}"))
FAILURES = ["invalid config: x#", "invalid pipeline y", "invalid input: z#", "team has no lab credits", "gateway budget is exhausted", "team has no gateway in the lab", "search index: http 401 #", "timed out waiting for search index", "search index task # failed", "index_sink: connection c# not found", "http 401 elsewhere", "boom #"]
_FAIL = """(SELECT CASE WHEN contains(m, 'invalid config: ') OR m LIKE 'invalid pipeline %' THEN 'invalid_config' WHEN contains(m, 'invalid input: ') THEN 'invalid_input'
 WHEN contains(m, 'no lab credits') OR contains(m, 'insufficient_credits') OR contains(m, 'source run refused') THEN 'insufficient_credits' WHEN contains(m, 'gateway budget is exhausted') THEN 'gateway_budget_exhausted'
 WHEN contains(m, 'has no gateway in the lab') OR contains(m, '(no_gateway)') OR contains(m, '(token_required)') OR contains(m, 'serves no lab gateway target without') THEN 'no_gateway'
 WHEN s AND (contains(m, 'authentication failed') OR contains(m, 'check the api key') OR contains(m, 'http 401') OR contains(m, 'http 403')) THEN 'destination_auth'
 WHEN s AND (contains(m, 'network error talking to search index') OR contains(m, 'timed out waiting for search index') OR contains(m, 'unexpected http 5')) THEN 'destination_unreachable'
 WHEN s AND ((contains(m, 'search index task') AND contains(m, 'failed')) OR contains(m, 'search index returned [') OR contains(m, 'auto_create_index is false') OR contains(m, 'cannot be sent in any batch')) THEN 'destination_rejected'
 WHEN s AND contains(m, 'connection ') AND contains(m, ' not found') THEN 'invalid_config' ELSE 'internal' END FROM (SELECT lower({x}) AS m, contains(lower({x}), 'search index') OR contains(lower({x}), 'index_sink') AS s))"""
scalar("failure_reason", FAILURES, lambda x: errors.failure_reason(F.lit(None).cast("string"), x), _FAIL)
SOURCE_FAILURES = ["fetch rejected: GET u: status 404 Not Found", "fetch rejected: status 403", "fetch rejected: status 402 pay", "fetch rejected: odd", "fetch: reset #", "dns: no host", "no lab credits", "job # failed: invalid input: q", "2 of 3 jobs failed; first: invalid config: z", "other #"]
scalar("source_failure_reason", SOURCE_FAILURES, errors.source_failure_reason, f"""CASE WHEN contains(lower({{x}}), 'no lab credits') OR contains(lower({{x}}), 'source run refused') THEN 'insufficient_credits'
 WHEN contains(lower({{x}}), 'fetch rejected: ') THEN CASE WHEN regexp_extract({{x}}, 'status ([0-9]{{{{3}}}})', 1) IN ('401', '403') THEN 'source_auth' WHEN regexp_extract({{x}}, 'status ([0-9]{{{{3}}}})', 1) IN ('404', '410') THEN 'source_not_found' WHEN regexp_extract({{x}}, 'status ([0-9]{{{{3}}}})', 1) = '402' THEN 'insufficient_credits' ELSE 'internal' END
 WHEN contains({{x}}, 'fetch: ') OR contains({{x}}, 'dns: ') THEN 'source_unreachable' WHEN {{x}} LIKE 'job %' OR contains({{x}}, ' jobs failed; first: ') THEN {_FAIL} ELSE 'internal' END""".replace("{{{{3}}}}", "{{3}}"))
query("http_failure_class", "SELECT event_id, CASE WHEN s = 429 OR s BETWEEN 500 AND 599 THEN 'retryable' ELSE 'permanent' END AS y FROM (SELECT event_id, 400 + event_id % 230 AS s FROM events)")(
    lambda spark, d: table(spark, d, "events").select("event_id", errors.http_failure_class(400 + F.col("event_id") % 230).alias("y"))
)
TYPES = ["text/csv; charset=UTF-8", "AUDIO/MP3", "application/x-zip", "image/jpg", "application/jsonl", "text/plain", "video/matroska ; x=1", "application/x-tgz", "avro/binary", "application/json", 'text/html; charset="Latin1"', "audio/x-wav"]
_ESSENCE = "lower(trim(split_part({x}, ';', 1)))"
_CANON = "coalesce((MAP {{" + ", ".join(f"{sql_text(a)}: {sql_text(k)}" for k, v in mime.ALIASES.items() for a in v) + "}})[" + _ESSENCE + "], " + _ESSENCE + ")"
_EXT = r"lower(regexp_extract(regexp_extract({x}, '[^/\\]*$'), '\.([^.]*)$', 1))"
_EXT_SQL = "(MAP {{" + ", ".join(f"{sql_text(a)}: {sql_text(k)}" for k, v in mime.EXTENSIONS.items() for a in v) + "}})[" + _EXT + "]"
scalar("canonical_mime", TYPES, lambda x: mime.canonical_mime(mime.essence(x)), _CANON)
scalar("canonical_content_type", TYPES, mime.canonical_content_type, _CANON)
scalar("content_type_charset", TYPES, mime.content_type_charset, r"nullif(lower(regexp_extract({x}, '(?i);\s*charset\s*=\s*\"?([^\";\s]+)', 1)), '')")
scalar("ext_map", [*NAMES, "r#.md", "x.JSONL", "y.parquet", "z.yml"], mime.extension_mime, _EXT_SQL)
_SOURCE_EXT = r"lower(regexp_extract({x}, '\.([^.]*)$', 1))"
scalar("source_ext_mime", ["r#.md", "x.JSONL", "y.parquet", "z.yml", "q#.zzz", "a.xml", "b.TSV", "c.htm", "d.avro", "e.tar.gz", "noext#", "m.msgpack", "t.txt", "p.csv.json"], mime.source_extension_mime, "(MAP {{" + ", ".join(f"{sql_text(a)}: {sql_text(k)}" for k, v in {"application/json": ["json"], "application/x-ndjson": ["ndjson", "jsonl"], "text/csv": ["csv"], "text/tab-separated-values": ["tsv"], "application/xml": ["xml"], "text/markdown": ["md"], "text/html": ["html", "htm"], "application/vnd.apache.parquet": ["parquet"], "application/vnd.apache.avro": ["avro"], "application/pdf": ["pdf"], "text/plain": ["txt"]}.items() for a in v) + "}})[" + _SOURCE_EXT + "]")
_INDEX = "CASE WHEN {m} LIKE 'video/%' THEN 'videos' WHEN {m} LIKE 'audio/%' THEN 'audio' WHEN {m} LIKE 'image/%' THEN 'images' WHEN {m} = 'text/html' THEN 'pages' WHEN {m} IN ('text/csv', 'application/vnd.apache.parquet', 'application/vnd.apache.avro') THEN 'datasets' ELSE 'documents' END"
scalar("default_index", TYPES, mime.default_index, _INDEX.replace("{m}", _ESSENCE))
scalar("is_archive", TYPES, lambda x: mime.is_archive(mime.canonical_content_type(x)), f"{_CANON} IN ('application/zip', 'application/gzip', 'application/x-tar')")
scalar("gunzipped_name", ["a#.tgz", "b#.tar.gz", "c#.GZ", "d#.txt"], mime.gunzipped_name, r"regexp_replace(regexp_replace({x}, '(?i)\.tgz$', '.tar'), '(?i)\.gz$', '')")
scalar("is_noise", ["__MACOSX/a#", "d/._x#", ".DS_Store", "a/Thumbs.db", "desktop.ini", "ok#.txt", "x/.DS_Store2"], mime.is_noise, r"regexp_matches({x}, '(^|/)__MACOSX(/|$)') OR regexp_matches(regexp_extract({x}, '[^/\\]*$'), '^(\._.*|\.DS_Store|Thumbs\.db|desktop\.ini)$')")
scalar("ext_refine", ["a#.docx", "b#.xlsx", "c#.txt", "d#.doc", "e.html"], lambda x: mime.extension_refines(F.lit(mime.ZIP), mime.extension_mime(x)), f"coalesce({_EXT_SQL} LIKE 'application/vnd.openxmlformats-officedocument.%' OR {_EXT_SQL} LIKE 'application/vnd.oasis.opendocument.%', false)")

PATTERNS = ["*", "*/*", "text/*", "audio/mpeg", "IMAGE/*", "application/json; q=1"]
query("mime_match", f"""SELECT event_id, p, x, pe IN ('*', '*/*') OR pe = xe OR (pe LIKE '%/*' AND starts_with(xe, left(pe, length(pe) - 1))) AS y FROM (SELECT event_id, p, x, lower(trim(split_part(p, ';', 1))) AS pe, lower(trim(split_part(x, ';', 1))) AS xe
 FROM (SELECT event_id, {sample_sql(PATTERNS, "event_id")} AS p, {sample_sql(TYPES + ["text/html"], "(event_id // 6)")} AS x FROM events))""")(
    lambda spark, d: table(spark, d, "events").select("event_id", sample(PATTERNS, F.col("event_id")).alias("p"), sample([*TYPES, "text/html"], F.floor(F.col("event_id") / 6)).alias("x")).select("event_id", "p", "x", mime.mime_matches(F.col("p"), F.col("x")).alias("y"))
)
GLOBS = ["*.pdf", "report*", "?ile*.txt", "*", "data-*_?.csv", "*.tar.*", "a[1].txt"]
query("glob_match", rf"""SELECT event_id, g, x, regexp_matches(regexp_extract(x, '[^/\\]*$'), '(?is)^' || replace(regexp_replace(regexp_replace(g, '([\\.\[\]{{}}()+^$|])', '\\\1', 'g'), '\*+', '.*', 'g'), '?', '.') || '$') AS y
 FROM (SELECT event_id, {sample_sql(GLOBS, "event_id")} AS g, {sample_sql(NAMES, "(event_id // 7)")} AS x FROM events)""")(
    lambda spark, d: table(spark, d, "events").select("event_id", sample(GLOBS, F.col("event_id")).alias("g"), sample(NAMES, F.floor(F.col("event_id") / 7)).alias("x")).select("event_id", "g", "x", mime.glob_match(F.col("g"), F.col("x")).alias("y"))
)
query("resolve_index", f"""SELECT event_id, coalesce(nullif(trim(p), ''), nullif(trim(r), ''), CASE WHEN {_INDEX.replace("{m}", _ESSENCE.format(x="t"))} = 'documents' THEN 'main' ELSE {_INDEX.replace("{m}", _ESSENCE.format(x="t"))} END) AS y
 FROM (SELECT event_id, {sample_sql(["", " ", "pat#"], "event_id")} AS p, {sample_sql(["", "req#"], "(event_id // 3)")} AS r, {sample_sql(TYPES, "(event_id // 6)")} AS t FROM events)""")(
    lambda spark, d: table(spark, d, "events").select("event_id", mime.resolve_index(sample(["", " ", "pat#"], F.col("event_id")), sample(["", "req#"], F.floor(F.col("event_id") / 3)), sample(TYPES, F.floor(F.col("event_id") / 6)), F.lit("main")).alias("y"))
)
_CHOICES = {"locked": (["", " ", "lock#", "", ""], 1), "fixed": (["", "fix#", ""], 2), "pattern": (["pat#", ""], 3), "requested": (["", "req#", " "], 5)}
_CHOSEN = ", ".join(f"{sample_sql(texts, f'(event_id // {by})')} AS {name}" for name, (texts, by) in _CHOICES.items())
_FIRST = ", ".join(f"nullif(trim({name}), '')" for name in _CHOICES)


def _chosen() -> dict:
    return {name: sample(texts, F.floor(F.col("event_id") / by)) for name, (texts, by) in _CHOICES.items()}


query("file_index", f"""SELECT event_id, coalesce({_FIRST}, CASE WHEN m = 'documents' THEN 'main' ELSE m END) AS y FROM (SELECT *, {_INDEX.replace("{m}", _ESSENCE.format(x="t"))} AS m FROM (SELECT event_id, {_CHOSEN}, {sample_sql(TYPES, "(event_id // 6)")} AS t FROM events))""")(
    lambda spark, d: table(spark, d, "events").select("event_id", mime.file_index(**_chosen(), mime=sample(TYPES, F.floor(F.col("event_id") / 6)), default=F.lit("main")).alias("y"))
)
_FORCED = ", ".join(f"nullif(trim({name}), '')" for name in list(_CHOICES)[1:])
query("archive_target_index", f"SELECT event_id, coalesce(nullif(trim(locked), ''), CASE WHEN event_id % 4 < 3 THEN coalesce({_FORCED}) END, '*') AS y FROM (SELECT event_id, {_CHOSEN} FROM events)")(
    lambda spark, d: table(spark, d, "events").select("event_id", mime.archive_target_index(**_chosen(), forced=F.col("event_id") % 4 < 3).alias("y"))
)
BODIES = ['{"a": #}', '[1, 2]', '{"a": 1}\n{"b": 2}\n', "<!DOCTYPE html><p>#", " <html>", "plain # text", "{broken", "[1]\nx"]
query("classify_text", f"""SELECT event_id, CASE WHEN o AND json_valid(x) THEN 'application/json' WHEN o AND len(l) >= 2 AND len(list_filter(l[1:5], lambda s: NOT (regexp_matches(s, '^[\\[{{]') AND json_valid(s)))) = 0 THEN 'application/x-ndjson'
 WHEN lower(ltrim(x)) LIKE '<!doctype html%' OR lower(ltrim(x)) LIKE '<html%' THEN 'text/html' ELSE 'text/plain' END AS y FROM (SELECT event_id, x, regexp_matches(x, '^[\\[{{]') AS o, list_filter(string_split(x, chr(10)), lambda s: trim(s) <> '') AS l FROM (SELECT event_id, {sample_sql(BODIES, "event_id")} AS x FROM events))""".replace("\\\\[", "\\["))(
    lambda spark, d: table(spark, d, "events").select("event_id", mime.classify_text(sample(BODIES, F.col("event_id"))).alias("y"))
)
_CASES = [("255044462D312E34", "a.txt", mime.PDF), ("504B030414", "b.docx", mime.DOCX), ("504B030414", "c.bin", mime.ZIP), ("1F8B08", "d.tgz", mime.GZIP), ("4F626A01", "e", mime.AVRO), ("504152310000000050415231", "f", mime.PARQUET), ("89504E470D0A1A0A", "g.txt", "image/png"), ("68656C6C6F", "h.md", mime.MARKDOWN), ("68656C6C6F", "i", mime.TEXT), ("00010203", "j", "application/octet-stream"), ("D0CF11E0A1B11AE1", "k.doc", mime.DOC)]
query("detect_mime", f"SELECT event_id, ([{', '.join(sql_text(m) for _, _, m in _CASES)}])[event_id % {len(_CASES)} + 1] AS y FROM events")(
    lambda spark, d: table(spark, d, "events").select("event_id", mime.detect_mime(F.unhex(sample([h for h, _, _ in _CASES], F.col("event_id"))), sample([n for _, n, _ in _CASES], F.col("event_id")), F.lit("")).alias("y"))
)
query("magic_record", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'application/vnd.apache.parquet' WHEN 1 THEN 'application/vnd.apache.avro' END AS y FROM events")(
    lambda spark, d: table(spark, d, "events").select("event_id", mime.magic_mime(F.unhex(sample(["504152310000000050415231", "4F626A0100", "5041523150415200"], F.col("event_id")))).alias("y"))
)
query("pages_mime", "SELECT page_id, 'text/html' AS y FROM pages")(lambda spark, d: table(spark, d, "pages").select("page_id", mime.detect_mime(F.encode("html", "UTF-8"), F.lit("p.html"), F.lit("")).alias("y")))
query("utf8_sniff", "SELECT doc_id, length(text) > 0 AND NOT regexp_matches(left(text, 512), '[\\x00-\\x08\\x0B\\x0E-\\x1F\\x7F]') AS y FROM documents")(lambda spark, d: table(spark, d, "documents").select("doc_id", mime.looks_like_text(F.encode("text", "UTF-8")).alias("y")))
query("outbox_backoff", "SELECT event_id, least(power(2.0, least(event_id % 12 + 1, 9)), 300.0) AS y FROM events")(lambda spark, d: table(spark, d, "events").select("event_id", control.outbox_backoff(F.col("event_id") % 12).alias("y")))
query("retry_delay", "SELECT event_id, least(1.0 * power(2.0, event_id % 8), 20.0)::DOUBLE AS y FROM events")(lambda spark, d: table(spark, d, "events").select("event_id", control.retry_delay(F.col("event_id") % 8 + 1, 1.0, 20.0).alias("y")))
query("sentence_split", r"""WITH a AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s', '\1' || chr(10), 'g'), chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '') AS l FROM documents)
 SELECT doc_id, unnest(range(len(l)))::INT AS k, unnest(l) AS sentence FROM a""")(lambda spark, d: table(spark, d, "documents").select("doc_id", F.posexplode(text.sentence_split(F.col("text"))).alias("k", "sentence")))
query("paragraph_split", r"""WITH a AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '\n[ \t\r]*\n', chr(1), 'g'), chr(1)), lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(10))), lambda x: x <> '') AS l FROM documents)
 SELECT doc_id, unnest(range(len(l)))::INT AS k, unnest(l) AS paragraph FROM a""")(lambda spark, d: table(spark, d, "documents").select("doc_id", F.posexplode(text.paragraph_split(F.col("text"))).alias("k", "paragraph")))
_TENANTS = ["t#", "bad id", "", "x/y", "a.b:c-#_", "line\n", "é", "a" * 128, "a" * 129]
query("validate_tenant_id", f"SELECT event_id, length(x) BETWEEN 1 AND 128 AND regexp_full_match(x, '[A-Za-z0-9._:-]*') AS y FROM (SELECT event_id, {sample_sql(_TENANTS, 'event_id')} AS x FROM events)")(
    lambda spark, d: table(spark, d, "events").select("event_id", ids.valid_tenant_id(sample(_TENANTS, F.col("event_id"))).alias("y"))
)
_DAYS = ["2024-05-01", "2024-5-1", "2024-13-45", "20240501", "2024-05-01\n", "", "2024/05/01", "x024-05-01"]
scalar("validate_date", _DAYS, ids.valid_date, "CASE event_id % 8 WHEN 0 THEN true WHEN 2 THEN true ELSE false END")