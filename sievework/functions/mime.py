"""Content types: aliases, matching, detection, default indexes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_OOXML = "application/vnd.openxmlformats-officedocument."
PDF, HTML, TEXT, CSV, JSON, NDJSON, MARKDOWN, YAML = "application/pdf", "text/html", "text/plain", "text/csv", "application/json", "application/x-ndjson", "text/markdown", "application/yaml"
DOCX, XLSX, PPTX, DOC, XLS, PPT = f"{_OOXML}wordprocessingml.document", f"{_OOXML}spreadsheetml.sheet", f"{_OOXML}presentationml.presentation", "application/msword", "application/vnd.ms-excel", "application/vnd.ms-powerpoint"
PARQUET, AVRO, MSGPACK, ZIP, GZIP, TAR = "application/vnd.apache.parquet", "application/vnd.apache.avro", "application/vnd.msgpack", "application/zip", "application/gzip", "application/x-tar"
OLE, OCTETS = "application/x-ole-storage", "application/octet-stream"

# Canonical content types with their other spellings.
ALIASES = {
    "audio/wav": ["audio/x-wav", "audio/wave", "audio/vnd.wave", "audio/x-pn-wav", "audio/wav-x"],
    "audio/mpeg": ["audio/mp3", "audio/x-mpeg", "audio/mpeg3", "audio/x-mp3"],
    "audio/mp4": ["audio/m4a", "audio/x-m4a", "audio/mp4a-latm", "audio/aac", "audio/x-aac"],
    "audio/flac": ["audio/x-flac"],
    "audio/ogg": ["audio/vorbis", "audio/x-ogg", "application/ogg"],
    "video/quicktime": ["video/x-quicktime"],
    "video/x-matroska": ["video/matroska", "video/x-mkv"],
    "image/jpeg": ["image/jpg"],
    CSV: ["text/x-csv", "application/csv"],
    NDJSON: ["application/jsonl", "application/x-jsonlines", "application/jsonlines", "application/ndjson"],
    PARQUET: ["application/x-parquet", "application/parquet", "application/vnd.apache.parquet1"],
    AVRO: ["application/avro", "avro/binary", "application/x-avro", "application/avro-binary"],
    MSGPACK: ["application/x-msgpack", "application/msgpack", "application/x-messagepack"],
    ZIP: ["application/x-zip-compressed", "application/x-zip", "multipart/x-zip"],
    GZIP: ["application/x-gzip", "application/gzip-compressed", "application/x-gtar", "application/x-tgz", "application/x-compressed"],
    TAR: ["application/tar"],
}
# Content types of filename extensions.
EXTENSIONS = {
    MARKDOWN: ["md", "markdown"], YAML: ["yaml", "yml"], JSON: ["json"], NDJSON: ["ndjson", "jsonl"], CSV: ["csv"], PARQUET: ["parquet"], AVRO: ["avro"], MSGPACK: ["msgpack", "mpk"],
    TEXT: ["txt", "text", "log"], HTML: ["htm", "html"], PDF: ["pdf"], DOCX: ["docx"], XLSX: ["xlsx"], PPTX: ["pptx"], DOC: ["doc"], XLS: ["xls"], PPT: ["ppt"], ZIP: ["zip"], GZIP: ["gz", "tgz"], TAR: ["tar"],
    "text/tab-separated-values": ["tsv"], "text/xml": ["xml"], "image/svg+xml": ["svg"], "image/png": ["png"], "image/jpeg": ["jpg", "jpeg"], "image/gif": ["gif"], "image/webp": ["webp"],
    "audio/mpeg": ["mp3"], "audio/wav": ["wav"], "audio/ogg": ["ogg"], "audio/mp4": ["m4a"], "audio/flac": ["flac"], "video/mp4": ["mp4"], "video/quicktime": ["mov"], "video/webm": ["webm"], "video/x-matroska": ["mkv"],
}
# Content types that a source takes from a filename, a smaller table of its own.
SOURCE_EXTENSIONS = {
    JSON: ["json"], NDJSON: ["ndjson", "jsonl"], CSV: ["csv"], "text/tab-separated-values": ["tsv"], "application/xml": ["xml"], MARKDOWN: ["md"], HTML: ["html", "htm"], PARQUET: ["parquet"], AVRO: ["avro"], PDF: ["pdf"], TEXT: ["txt"],
}
# Signatures at the start of a file, as hex.
SIGNATURES = {
    "255044462D": PDF, "504B0304": ZIP, "504B0506": ZIP, "1F8B": GZIP, "D0CF11E0A1B11AE1": OLE, "89504E470D0A1A0A": "image/png", "FFD8FF": "image/jpeg", "474946383761": "image/gif", "474946383961": "image/gif",
    "494433": "audio/mpeg", "FFFB": "audio/mpeg", "664C6143": "audio/flac", "4F676753": "audio/ogg", "1A45DFA3": "video/x-matroska", "4F626A01": AVRO,
}


def _lookup(table: dict[str, list[str]], key: Column) -> Column:
    pairs = [F.lit(x) for value, keys in table.items() for k in keys for x in (k, value)]
    return F.create_map(*pairs)[key]


def essence(content_type: Column) -> Column:
    """Parameters dropped, trimmed, lower case."""
    return F.lower(F.trim(F.split_part(content_type, F.lit(";"), F.lit(1))))


def canonical_mime(mime: Column) -> Column:
    return F.coalesce(_lookup(ALIASES, mime), mime)


def canonical_content_type(content_type: Column) -> Column:
    return canonical_mime(essence(content_type))


def mime_matches(pattern: Column, mime: Column) -> Column:
    p, m = essence(pattern), essence(mime)
    prefix = F.substring(p, F.lit(1), F.length(p) - 1)
    return p.isin("*", "*/*") | (p == m) | (p.endswith("/*") & F.startswith(m, prefix))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/\\]*$", 0)


def glob_to_regex(pattern: str) -> str:
    """A glob's `*` and `?` as an anchored, case-insensitive regular expression. What stands between two stars matches where
    it first can and is not tried again (an atomic group), so that many stars cost no more than the name's length each."""
    first, *more = ["".join("." if c == "?" else re.escape(c) for c in x) for x in re.split(r"\*+", pattern)]
    return "(?is)^" + first + "".join(f"(?>.*?{x})" for x in more[:-1]) + (f".*{more[-1]}" if more else "") + "$"


def glob_regex(pattern: Column) -> Column:
    """glob_to_regex() of a column."""
    literal = F.replace(F.regexp_replace(pattern, r"([\\.\[\]{}()+^$|])", r"\\$1"), F.lit("?"), F.lit("."))
    parts = F.split(literal, r"\*+")
    n = F.size(parts)
    inner = F.array_join(F.transform(F.slice(parts, 2, F.greatest(n - 2, F.lit(0))), lambda x: F.concat(F.lit("(?>.*?"), x, F.lit(")"))), "")
    end = F.when(n > 1, F.concat(inner, F.lit(".*"), F.element_at(parts, -1))).otherwise(F.lit(""))
    return F.concat(F.lit("(?is)^"), F.get(parts, F.lit(0)), end, F.lit("$"))


def glob_match(pattern: Column, name: Column) -> Column:
    """`*` and `?` against a name's last part, whatever the case; names over 1024 bytes never match."""
    return (F.octet_length(name) <= 1024) & F.regexp_like(base_name(name), glob_regex(pattern))


def extension_mime(filename: Column) -> Column:
    ext = F.lower(F.regexp_extract(base_name(filename), r"\.([^.]*)$", 1))
    return _lookup(EXTENSIONS, F.when(ext != "", ext))


def source_extension_mime(filename: Column) -> Column:
    """What a source takes a fetched file for by its name, where the server told nothing."""
    return _lookup(SOURCE_EXTENSIONS, F.when(F.contains(filename, F.lit(".")), F.lower(F.substring_index(filename, ".", -1))))


def magic_mime(data: Column) -> Column:
    """The content type that a file's signature tells; null without one."""
    head = F.hex(F.substring(data, 1, 8))
    parquet = (F.octet_length(data) >= 8) & head.startswith("50415231") & (F.hex(F.substring(data, -4, 4)) == "50415231")
    wave = head.startswith("52494646") & (F.hex(F.substring(data, 9, 4)) == "57415645")
    webp = head.startswith("52494646") & (F.hex(F.substring(data, 9, 4)) == "57454250")
    mp4 = F.hex(F.substring(data, 5, 4)) == "66747970"
    out = F.when(parquet, F.lit(PARQUET)).when(wave, F.lit("audio/wav")).when(webp, F.lit("image/webp")).when(mp4, F.lit("video/mp4")).when(F.hex(F.substring(data, 258, 5)) == "7573746172", F.lit(TAR))
    for sign, mime in SIGNATURES.items():
        out = out.when(head.startswith(sign), F.lit(mime))
    text = F.lower(F.decode(F.substring(F.regexp_replace(F.decode(F.substring(data, 1, 64), "ISO-8859-1"), r"^[ \t\r\n]+", "").cast("binary"), 1, 32), "UTF-8"))
    return out.when(text.startswith("<?xml"), F.lit("text/xml")).when(text.startswith("#!"), F.lit("text/x-shellscript")).when(text.rlike("^<(!doctype html|html|head|body|p|div|h1|table|a|br|style|script|!--)"), F.lit(HTML))


def is_text_format(mime: Column) -> Column:
    return mime.startswith("text/") | mime.endswith("+xml") | mime.endswith("+json") | mime.isin(JSON, YAML, "application/xml")


def extension_refines(magic: Column, ext: Column) -> Column:
    """Whether the type of the extension is a closer name for what the signature says."""
    office = ext.isin(DOCX, XLSX, PPTX) | ext.startswith(_OOXML) | ext.startswith("application/vnd.oasis.opendocument.")
    ok = F.when(magic == ZIP, office).when(magic == OLE, ext.isin(DOC, XLS, PPT)).when(magic.isin(HTML, "text/xml", "text/x-shellscript"), is_text_format(ext))
    return F.coalesce(ok, F.lit(False))


def looks_like_text(data: Column) -> Column:
    """The first 512 bytes are UTF-8 (the last character may be cut) without control characters but tab, line ends and form feed."""
    head = F.substring(data, 1, 512)
    cut = F.regexp_replace(F.hex(head), "(C[2-9A-F]|D[0-9A-F]|E[0-9A-F]([89AB][0-9A-F])?|F[0-4]([89AB][0-9A-F]){0,2})$", "")
    known = F.coalesce(F.try_validate_utf8(F.when(F.octet_length(data) > 512, F.unhex(cut)).otherwise(head)).isNotNull(), F.lit(False))
    return (F.octet_length(data) > 0) & known & ~F.decode(head, "ISO-8859-1").rlike(r"[\x00-\x08\x0B\x0E-\x1F\x7F]")


def valid_json(text: Column) -> Column:
    """Exactly one JSON value. The parser stops behind the first value, so the text is tried inside an array and inside an object."""
    wrap = lambda a, b: F.try_parse_json(F.concat(F.lit(a), text, F.lit(b))).isNotNull()
    return wrap("[", "]") & wrap('{"v":', "}")


def sniff_ndjson(text: Column) -> Column:
    """Two or more lines with something on them, of which the first five are JSON objects or arrays."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\r"))), lambda x: x != "")
    return (F.size(lines) >= 2) & F.forall(F.slice(lines, 1, 5), lambda x: x.rlike(r"^[{\[]") & valid_json(x))


def classify_text(text: Column) -> Column:
    start = F.regexp_replace(text, "^[﻿ \t\n\r]+", "")
    low = F.lower(F.left(start, F.lit(32)))
    opens = start.rlike(r"^[{\[]")
    return (
        F.when(opens & valid_json(text), F.lit(JSON))
        .when(opens & sniff_ndjson(text), F.lit(NDJSON))
        .when(low.startswith("<!doctype html") | low.startswith("<html"), F.lit(HTML))
        .otherwise(F.lit(TEXT))
    )


def detect_mime(data: Column, filename: Column, hint: Column) -> Column:
    """Signature, closer named by the extension; else the extension; else sniffed text; else the hint; else octets."""
    magic, ext, told = magic_mime(data), extension_mime(filename), canonical_content_type(hint)
    text = F.when(looks_like_text(data), classify_text(F.decode(data, "UTF-8")))
    found = F.when(extension_refines(magic, ext), ext).otherwise(F.coalesce(magic, ext, text, F.when(told != "", told), F.lit(OCTETS)))
    return canonical_mime(found)


def is_archive(mime: Column) -> Column:
    return mime.isin(ZIP, GZIP, TAR)


def default_index(mime: Column) -> Column:
    m = essence(mime)
    return (
        F.when(m.startswith("video/"), F.lit("videos"))
        .when(m.startswith("audio/"), F.lit("audio"))
        .when(m.startswith("image/"), F.lit("images"))
        .when(m == HTML, F.lit("pages"))
        .when(m.isin(CSV, PARQUET, AVRO), F.lit("datasets"))
        .otherwise(F.lit("documents"))
    )


def resolve_index(pattern: Column, requested: Column, mime: Column, default: Column) -> Column:
    """The trigger's pattern, else the request's index, else the content type's (the caller's default for `documents`)."""
    given = lambda x: F.nullif(F.trim(x), F.lit(""))
    by_type = default_index(mime)
    return F.coalesce(given(pattern), given(requested), F.when(by_type == "documents", F.coalesce(given(default), by_type)).otherwise(by_type))


def _given(x: Column) -> Column:
    return F.nullif(F.trim(x), F.lit(""))


def file_index(locked: Column, fixed: Column, pattern: Column, requested: Column, mime: Column, default: Column) -> Column:
    """The index of an archive's file: the key's own, the one that its pipeline names, else as resolve_index()."""
    return F.coalesce(_given(locked), _given(fixed), resolve_index(pattern, requested, mime, default))


def archive_target_index(locked: Column, forced: Column, fixed: Column, pattern: Column, requested: Column) -> Column:
    """The one index that all of an archive goes to: the key's own, or with a forced pipeline the one that it names, its pattern's, the request's; else `*`: the files decide."""
    return F.coalesce(_given(locked), F.when(forced, F.coalesce(_given(fixed), _given(pattern), _given(requested))), F.lit("*"))


def content_type_charset(content_type: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(content_type, r'(?i);\s*charset\s*=\s*"?([^";\s]+)', 1)), F.lit(""))


def gunzipped_name(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(name, r"(?i)\.tgz$", ".tar"), r"(?i)\.gz$", "")


def is_noise(path: Column) -> Column:
    """What systems leave in archives."""
    return path.rlike(r"(^|/)__MACOSX(/|$)") | base_name(path).rlike(r"^(\._.*|\.DS_Store|Thumbs\.db|desktop\.ini)$")
