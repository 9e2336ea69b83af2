"""Document ids: pure functions of a filename, an origin and a position, so that ingesting again upserts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blake3 import blake3_hex

# The index's limit on an id, the longest generated stem, and the digits of an origin's tag.
MAX_ID, MAX_STEM, TAG_DIGITS = 511, 400, 12


@F.udf(T.StringType(), useArrow=True)
def origin_tag(origin: str) -> str | None:
    """The first digits of the origin's BLAKE3; null for a null or empty origin."""
    return blake3_hex(origin.encode())[:TAG_DIGITS] if origin else None


def sanitize_id(raw: Column) -> Column:
    """Each code point outside [A-Za-z0-9_-] becomes `_`; an empty one becomes a random UUID."""
    safe = F.left(F.regexp_replace(raw, "[^A-Za-z0-9_-]", "_"), F.lit(MAX_ID))
    return F.when(F.length(raw) > 0, safe).otherwise(F.when(raw.isNotNull(), F.uuid()))


def _cut(stem: Column, raw: Column) -> Column:
    """A stem over MAX_STEM bytes is cut and ends with a tag of the whole."""
    short = F.concat_ws("_", F.left(stem, F.lit(MAX_STEM - TAG_DIGITS - 1)), origin_tag(F.when(F.length(stem) > MAX_STEM, raw)))
    return F.when(F.length(stem) > MAX_STEM, short).otherwise(stem)


def bare_stem(filename: Column) -> Column:
    """A path without what precedes its last backslash, without leading slashes and the last extension; null if nothing is left."""
    name = F.regexp_replace(F.substring_index(filename, "\\", -1), "^/+", "")
    stem = F.regexp_replace(name, r"(?<=[^/])\.[^./]*$", "")
    return F.when(~name.endswith("/") & (F.length(stem) > 0), stem)


def filename_id_stem(filename: Column, ascii_only: bool = False) -> Column:
    """The stem that a file's ids begin with. ascii_only leaves out the tags, which ASCII names of ordinary length never get."""
    stem = bare_stem(filename)
    safe = F.regexp_replace(stem, "[^A-Za-z0-9_-]", "_")
    if ascii_only:
        return safe
    other = stem.rlike(r"[^\x00-\x7F]")
    part = F.when(other, F.concat_ws("_", F.left(safe, F.lit(MAX_ID - TAG_DIGITS - 1)), origin_tag(F.when(other, stem)))).otherwise(safe)
    return _cut(part, stem)


def tag_id(stem: Column, origin: Column) -> Column:
    """`<stem>_<tag>` for content with an origin, else the stem."""
    return F.concat_ws("_", _cut(sanitize_id(stem), stem), origin_tag(origin))


def id_stem(filename: Column, origin: Column, fallback: str = "doc") -> Column:
    return tag_id(F.coalesce(filename_id_stem(filename), F.lit(fallback)), origin)


def base_tag(base: Column, most: int) -> Column:
    """The tag of a base that a suffix of up to `most` characters may not fit behind, so that it is made once for all its suffixes. Pickled, so that it runs beside other pickled functions."""
    return F.udf(origin_tag.func, T.StringType(), useArrow=False)(F.when(F.length(base) + most > MAX_ID, base))


def suffixed_id(base: Column, suffix: Column, tag: Column | None = None) -> Column:
    """base and suffix; where they are too long together, base is cut and tagged so that the suffix stays whole. tag: its base_tag(), if made before."""
    fits = F.length(base) + F.length(suffix) <= MAX_ID
    short = F.left(base, F.lit(MAX_ID - TAG_DIGITS - 1) - F.length(suffix))
    return F.when(fits, F.concat(base, suffix)).otherwise(F.concat(short, F.lit("_"), origin_tag(F.when(~fits, base)) if tag is None else tag, suffix))


def valid_tenant_id(tenant: Column) -> Column:
    """1 to 128 characters of A-Z a-z 0-9 . _ : and -."""
    return F.coalesce(tenant.rlike(r"\A[A-Za-z0-9._:-]{1,128}\z"), F.lit(False))


def valid_date(day: Column) -> Column:
    """YYYY-MM-DD by its form; whether there is such a day is not asked."""
    return F.coalesce(day.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), F.lit(False))


def fnv1a64(text: str) -> int:
    """FNV-1a of the UTF-8 bytes, 64 bits, by its published constants."""
    h = 0xCBF29CE484222325
    for b in text.encode():
        h = (h ^ b) * 0x100000001B3 % (1 << 64)
    return h
