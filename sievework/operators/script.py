"""Per-document scripts as Column expressions: map, filter, promote, rename, drop, and what an error does."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import sanitize_id
from .documents import strict

#: set: columns to expressions; keep: a predicate; rename: old to new; drop: columns.
ON_ERROR = ("fail", "skip", "keep")


def finite(value: Column) -> Column:
    """Whether a double is neither NaN nor infinite (null is neither)."""
    return F.coalesce(~F.isnan(value) & (F.abs(value) != float("inf")), F.lit(True))


def rows(docs: DataFrame, set_: dict[str, Column] | None = None, keep: Column | None = None, rename: dict[str, str] | None = None, drop: list[str] | None = None, valid: Column | None = None, on_error: str = "fail", live: Column | None = None) -> DataFrame:
    """One pass over documents, as metered rows: keep's rows (all without it), with set_'s columns computed from the document as it came.

    valid tells which documents the script can handle: others are errors, go, or stay untouched. set_ is atomic: a
    document is changed wholly or not at all. Expressions have no loops, so every document ends. live: which rows are documents.
    """
    if on_error not in ON_ERROR:
        raise ValueError(f"invalid config: on_error {on_error!r}")
    set_, live = set_ or {}, F.lit(True) if live is None else live
    ok = F.coalesce(valid, F.lit(False)) if valid is not None else F.lit(True)
    failed = live & ~ok if on_error == "fail" else F.lit(False)
    stays = live if on_error == "keep" else live & ok
    if keep is not None:
        stays &= F.coalesce(keep, F.lit(False)) | ~ok
    marked = docs.withColumns({"_n": F.when(stays, F.lit(0)), "_error": F.when(failed, F.lit("invalid input: the script failed for a document")), "_ms": F.lit(0.0), "_ok": live & ok})
    columns = [F.when(F.col("_ok"), set_[c]).otherwise(F.col(c)).alias(c) if c in set_ else F.col(c) for c in marked.columns if c != "_ok"]
    out = marked.select(*columns, *(F.when(F.col("_ok"), e).alias(c) for c, e in set_.items() if c not in docs.columns))
    return out.withColumnsRenamed(rename or {}).drop(*(drop or []))


def run(docs: DataFrame, set_: dict[str, Column] | None = None, keep: Column | None = None, rename: dict[str, str] | None = None, drop: list[str] | None = None, valid: Column | None = None, on_error: str = "fail") -> DataFrame:
    """rows() as plain documents: what on_error=fail is for fails the query."""
    return strict(rows(docs, set_, keep, rename, drop, valid, on_error))


def promote(fields: Column, names: dict[str, str]) -> dict[str, Column]:
    """Keys of the JSON fields as columns: name -> type."""
    return {k: F.try_variant_get(F.try_parse_json(fields), f"$.{k}", t) for k, t in names.items()}


# Nesting of an expression, bytes that a script may add to a document, and operations and milliseconds at most.
MOST_DEPTH, MOST_ADDED, MOST_OPS, MOST_MS = 64, 512 << 10, 100_000_000, 30_000
#: Characters of an expression, so that it names a document's columns a bounded number of times.
MOST_LENGTH = 16 << 10
#: Columns that a script reads and does not write.
READ_ONLY = ("filename", "mime", "parent_id", "chunk_index", "chunk_total")
#: Functions that an expression may call: each gives at most a few times what it takes.
ALLOWED = set(
    "abs ceil floor round sqrt power ln exp greatest least coalesce nullif nvl if isnull isnotnull isnan cast try_cast upper lower initcap trim ltrim rtrim btrim length char_length octet_length "
    "left right substring substr split_part split concat concat_ws contains startswith endswith replace regexp_replace regexp_extract regexp_like translate reverse instr locate "
    "to_date to_timestamp try_to_timestamp date_format year month day date_add date_sub datediff get_json_object to_json named_struct struct map array array_join element_at size array_contains array_distinct sort_array "
    "try_parse_json try_variant_get md5 sha2 crc32 try_add try_subtract try_multiply try_divide try_to_number in and or not when then else between like rlike case end as".split()
)
_CALL = re.compile(r"([A-Za-z_]\w*)\s*\(")
_QUOTED = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"")


class ScriptError(ValueError):
    pass


def _closing(text: str, start: int) -> int:
    """Where the bracket closes that is open at `start`."""
    depth = 1
    for k in range(start, len(text)):
        depth += (text[k] == "(") - (text[k] == ")")
        if not depth:
            return k
    return len(text)


def expression(text: str) -> Column:
    """A checked SQL expression over a document's columns: no loops, queries or windows, bounded in length and nesting."""
    bare = _QUOTED.sub("''", text)
    if len(text) > MOST_LENGTH:
        raise ScriptError(f"invalid config: an expression is longer than {MOST_LENGTH} characters")
    depth = most = 0
    for c in bare:
        depth += (c in "([") - (c in ")]")
        most = max(most, depth)
    if most > MOST_DEPTH:
        raise ScriptError(f"invalid config: an expression is nested deeper than {MOST_DEPTH}")
    if unknown := sorted({f.lower() for f in _CALL.findall(bare)} - ALLOWED):
        raise ScriptError(f"invalid config: a script cannot call {', '.join(unknown)}")
    if re.search(r"(?i)\b(select|over|from)\b|--|/\*|`", bare):
        raise ScriptError("invalid config: a script is no query")
    for call in re.finditer(r"(?i)\breplace\s*\(|\bregexp_replace\s*\(", bare):
        if not re.search(r",\s*''\s*$", bare[call.end() : _closing(bare, call.end())]):
            raise ScriptError("invalid config: replace puts in quoted texts alone")
    return F.expr(text)


def configured(docs: DataFrame, config: dict, live: Column | None = None) -> DataFrame:
    """The script step of a pipeline, as metered rows. config: set (column to expression), keep, valid (expressions), rename, drop, on_error, max_ops, timeout_ms.

    A document's id stays an index id, its columns of origin stay as they are, and what a script makes of a document has at
    most MOST_ADDED bytes more than the document; a larger result is that document's error. Expressions end by
    themselves, so max_ops (each column of `set` and each predicate counts as one) and timeout_ms are checked, not measured.
    valid tells which documents on_error is for; an expression that raises (a cast, say, where try_cast would not) fails the step.
    """
    if unknown := set(config) - {"set", "keep", "valid", "rename", "drop", "on_error", "max_ops", "timeout_ms"}:
        raise ScriptError(f"invalid config: unknown {', '.join(sorted(unknown))}")
    writes, rename, drop = dict(config.get("set") or {}), dict(config.get("rename") or {}), list(config.get("drop") or [])
    if not (writes or rename or drop or config.get("keep")):
        raise ScriptError("invalid config: the script must not be empty")
    for name in ("max_ops", "timeout_ms"):
        if int(config.get(name, 1)) < 1:
            raise ScriptError(f"invalid config: {name} must be at least 1")
    if len(writes) + 2 > min(int(config.get("max_ops", 100_000)), MOST_OPS):
        raise ScriptError("invalid config: the script has more operations than max_ops")
    if fixed := sorted({*writes, *rename, *drop} & set(READ_ONLY)):
        raise ScriptError(f"invalid config: {', '.join(fixed)} cannot be written")
    made = {c: expression(e) for c, e in writes.items()}
    if "id" in made:
        made["id"] = sanitize_id(made["id"].cast("string"))
    size = lambda cols: sum((F.coalesce(F.octet_length(c.cast("string")), F.lit(0)) for c in cols), F.lit(0))
    texts = [F.col(f.name) for f in docs.schema if f.dataType.simpleString() == "string"]
    valid = expression(config["valid"]) if config.get("valid") else F.lit(True)
    if made:
        valid &= size(made.values()) <= size(texts) + MOST_ADDED
    keep = expression(config["keep"]) if config.get("keep") else None
    return rows(docs, made, keep, rename, drop, valid if made or config.get("valid") else None, config.get("on_error", "fail"), live)


def run_config(docs: DataFrame, config: dict) -> DataFrame:
    """configured() as plain documents."""
    return strict(configured(docs, config))
