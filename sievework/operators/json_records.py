"""JSON and NDJSON to documents: record selection, flattening, ids, titles, content."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ids import sanitize_id
from .documents import metered, strict

# Keys under which a wrapper object holds its records, in order.
WRAPPERS = ("documents", "items", "data", "results", "hits")
#: Rows and decoded bytes of one payload at most; beyond, the step fails.
MAX_ROWS, MAX_BYTES = 1_000_000, 512 << 20

DOCUMENTS = T.ArrayType(T.StructType([T.StructField(x, T.StringType()) for x in ("id", "title", "content", "fields")]))


class InvalidInput(ValueError):
    pass


class InvalidConfig(ValueError):
    pass


@dataclass(frozen=True)
class FlattenConfig:
    id_field: str = "id"
    title_field: str | None = None
    content_fields: tuple[str, ...] | None = None
    flatten_arrays: bool = False
    max_depth: int = 8
    root: str | None = None


def dumps(value) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"), sort_keys=True)


def free_name(taken, name: str) -> str:
    """name, or else the first of name_2, name_3, ... that is free."""
    if name not in taken:
        return name
    k = 2
    while f"{name}_{k}" in taken:
        k += 1
    return f"{name}_{k}"


def scalar(value) -> bool:
    return not isinstance(value, dict | list)


def flatten(value, config: FlattenConfig) -> dict:
    """Dotted keys; arrays of scalars, empty objects and what lies max_depth deep stay as they are."""
    out: dict = {}
    todo = [(k, v, 1) for k, v in sorted(value.items())] if isinstance(value, dict) else [("value", value, 1)]
    while todo:
        key, v, depth = todo.pop(0)
        if isinstance(v, dict) and v and depth < config.max_depth:
            todo[:0] = [(f"{key}.{k}", x, depth + 1) for k, x in sorted(v.items())]
        elif isinstance(v, list) and config.flatten_arrays and depth < config.max_depth and not all(map(scalar, v)):
            todo[:0] = [(f"{key}.{k}", x, depth + 1) for k, x in enumerate(v)]
        else:
            out[free_name(out, key)] = v
    return out


def value_text(value) -> str:
    if value is None:
        return ""
    if isinstance(value, str):
        return value
    if isinstance(value, list) and all(map(scalar, value)):
        return " ".join(filter(None, map(value_text, value)))
    return dumps(value)


def string_leaves(fields: dict) -> list[str]:
    return [x for _, v in sorted(fields.items()) for x in (v if isinstance(v, list) else [v]) if isinstance(x, str) and x]


def roots(value, config_root: str | None = None, line: bool = False) -> list:
    """The records in a payload: an array's elements, those of a wrapper object, or the value itself.

    root `none` never unwraps objects; a JSON Pointer names the array; NDJSON lines are records as they are.
    """
    if config_root and config_root != "none":
        for part in config_root.split("/")[1:]:
            part = part.replace("~1", "/").replace("~0", "~")
            try:
                value = value[int(part)] if isinstance(value, list) else value[part]
            except (KeyError, IndexError, ValueError, TypeError):
                raise InvalidInput(f"invalid input: nothing at {config_root}") from None
        if not isinstance(value, list):
            raise InvalidInput(f"invalid input: no array at {config_root}")
        return value
    if line:
        return [value]
    if isinstance(value, list):
        return value
    if isinstance(value, dict) and not config_root:
        return next((value[k] for k in WRAPPERS if isinstance(value.get(k), list)), [value])
    return [value]


def parse(text: str, config: FlattenConfig) -> list:
    try:
        return roots(json.loads(text), config.root)
    except InvalidInput:
        raise
    except ValueError as whole:
        found, lines = [], 0
        for n, line in enumerate(text.split("\n"), 1):
            if line.strip():
                try:
                    found += roots(json.loads(line), config.root, True)
                except InvalidInput:
                    raise
                except ValueError as e:
                    raise InvalidInput(f"invalid input: neither JSON ({whole}) nor NDJSON (line {n}: {e})") from None
                lines += 1
        if not lines:
            raise InvalidInput(f"invalid input: {whole}") from None
        return found


def document(record, generated: str, config: FlattenConfig, upstream: dict | None = None) -> dict:
    upstream, fields = upstream or {}, flatten(record, config)
    given = value_text(fields.pop(config.id_field, None))
    title = value_text(fields.pop(config.title_field, None)) if config.title_field else ""
    if config.content_fields is not None:
        content = " ".join(filter(None, (value_text(fields.pop(k)) for k in config.content_fields if k in fields))) or upstream.get("content") or ""
    else:
        content = upstream.get("content") or " ".join(string_leaves(fields))
    return {"id": given or None, "title": title or upstream.get("title"), "content": content, "fields": dumps(fields), "generated": upstream.get("id") or generated}


def decoded_size(value) -> int:
    """Nodes at 32 bytes each, and their text."""
    total, todo = 0, [value]
    while todo:
        v = todo.pop()
        total += 32 + (len(v) if isinstance(v, str) else 0)
        if isinstance(v, dict):
            total += sum(map(len, v))
        if not scalar(v):
            todo += v.values() if isinstance(v, dict) else v
    return total


def check_limits(records: list, most_rows: int = MAX_ROWS, most_bytes: int = MAX_BYTES) -> list:
    if len(records) > most_rows or sum(map(decoded_size, records)) > most_bytes:
        raise InvalidInput(f"invalid input: over {most_rows} records or {most_bytes} bytes; nothing is cut off")
    return records


def flatten_payloads(blobs: DataFrame, config: FlattenConfig | None = None, data: str = "data", stem: str = "stem") -> DataFrame:
    """blobs: stem and JSON or NDJSON text. stem, n and id, title, content, fields of each record."""
    config = config or FlattenConfig()

    def run(text: str) -> list[dict]:
        made = [document(r, f"_{k}", config) for k, r in enumerate(check_limits(parse(text, config)))]
        return [{"id": d["id"], "title": d["title"], "content": d["content"], "fields": d["fields"]} for d in made]

    rows = blobs.select(stem, F.posexplode(F.udf(run, DOCUMENTS, useArrow=True)(F.col(data))).alias("n", "d"))
    given, made = sanitize_id(F.col("d.id")), F.concat_ws("_", F.col(stem), F.col("n").cast("string"))
    return rows.select(stem, "n", F.coalesce(F.when(F.col("d.id").isNotNull(), given), made).alias("id"), "d.title", "d.content", "d.fields")


def documents(data: bytes, config: FlattenConfig) -> list[dict]:
    """A payload's records as documents, whose ids are the id field's or else `<stem>_<n>`."""
    made = (document(r, f"_{k}", config) for k, r in enumerate(check_limits(parse(data.decode(), config))))
    return [{"id": d["id"], "suffix": d["generated"], "title": d["title"], "content": d["content"], "fields": d["fields"]} for d in made]


_ANEW = T.StructType([*DOCUMENTS.elementType.fields, T.StructField("error", T.StringType())])


def reflattened(docs: DataFrame, config: FlattenConfig | None = None) -> DataFrame:
    """Metered rows: docs (id, title, content, fields as a JSON object, and others) with fields flattened anew; id, title and content stay where fields name none."""
    config = config or FlattenConfig()

    @F.udf(_ANEW, useArrow=True)
    def run(id_, title, content, fields):
        if id_ is None:
            return None
        try:
            d = document(json.loads(fields) if fields else {}, "", config, {"id": id_, "title": title, "content": content})
        except ValueError as e:
            return dict.fromkeys(_ANEW.names) | {"error": str(e) if str(e).startswith("invalid ") else f"invalid input: {e}"}
        return {"id": d["id"], "title": d["title"], "content": d["content"], "fields": d["fields"], "error": None}

    made = docs.withColumn("_made", run("id", "title", "content", "fields"))
    ok = F.col("_made").isNotNull() & F.col("_made.error").isNull()
    new = {"id": F.when(ok, F.coalesce(sanitize_id(F.col("_made.id")), F.col("id"))), "title": F.col("_made.title"), "content": F.col("_made.content"), "fields": F.col("_made.fields")}
    return metered(made.select(*(new[c].alias(c) if c in new else F.col(c) for c in docs.columns), F.col("_made.error").alias("_error")))


def reflatten(docs: DataFrame, config: FlattenConfig | None = None) -> DataFrame:
    """reflattened() as plain documents."""
    return strict(reflattened(docs, config))


def wrapper_key(payload: Column) -> Column:
    """The key under which a JSON object's records are; null for none."""
    v = F.try_parse_json(payload)
    return F.coalesce(*(F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant")).startswith("ARRAY"), F.lit(k)) for k in WRAPPERS))


def inline_documents(payload: Column) -> Column:
    """A request's document: content from content, text or body, and its id; other keys are fields."""
    get = lambda k: F.get_json_object(payload, f"$.{k}")
    return F.struct(sanitize_id(F.nullif(F.trim(get("id")), F.lit(""))).alias("id"), F.coalesce(get("content"), get("text"), get("body")).alias("content"))


def payload_kind(payload: Column) -> Column:
    """How a request's body is read: an array, a url, an s3 reference, documents, items, or one document."""
    has = lambda k: F.get_json_object(payload, f"$.{k}").isNotNull()
    out = F.when(F.ltrim(payload).startswith("["), F.lit("array"))
    for k in ("url", "s3", "documents", "items"):
        out = out.when(has(k), F.lit(k))
    return out.otherwise(F.lit("document"))
