"""Scalar text functions, all Column expressions."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def collapse_ws(text: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, r"[\s\p{Z}\u0085]+", " "))


def normalize_ws(text: Column) -> Column:
    """Page text: lines (form feeds end lines too) collapsed, blank lines at most one in a row, none at the ends."""
    lines = F.transform(F.split(text, "[\n\f]"), collapse_ws)
    return F.regexp_replace(F.regexp_replace(F.array_join(lines, "\n"), "\n{3,}", "\n\n"), "^\n+|\n+$", "")


def squeeze_blank(text: Column) -> Column:
    """Section text: lines without white space at their end, blank lines at most one in a row, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"(?m)[ \t\r]+$", ""), "\n{3,}", "\n\n"), "^\n+|\n+$", "")


_FRONT = r"(?s)^﻿?---[ \t]*\r?\n(.*?)(?:^|(?<=\n))(?:---|\.\.\.)[ \t]*(?:\r?\n|$)(.*)$"


def front_matter(text: Column) -> Column:
    """The YAML between a leading `---` line and the next `---` or `...` line; null without one."""
    return F.when(text.rlike(_FRONT), F.regexp_extract(text, _FRONT, 1))


def after_front_matter(text: Column) -> Column:
    return F.when(text.rlike(_FRONT), F.regexp_extract(text, _FRONT, 2)).otherwise(text)


def truncate_chars(text: Column, most: int) -> Column:
    """At most so many code points."""
    return F.left(text, F.lit(most))


def strip_code_fences(text: Column) -> Column:
    """A reply without the ``` fence around it and the fence's language."""
    inner = F.regexp_replace(F.trim(text), r"^```[A-Za-z0-9_+-]*[ \t]*\r?\n?", "")
    return F.when(F.trim(text).startswith("```"), F.btrim(F.regexp_replace(inner, r"\s*```\s*$", ""), F.lit(" \t\r\n"))).otherwise(F.btrim(text, F.lit(" \t\r\n")))


def sentence_split(text: Column) -> Column:
    """Sentences: cut at line ends and after . ! or ? before white space; trimmed, none empty."""
    marked = F.regexp_replace(text, r"([.!?])\s", "$1\n")
    return F.filter(F.transform(F.split(marked, "\n"), lambda x: F.btrim(x, F.lit(" \t\r"))), lambda x: x != "")


def paragraph_split(text: Column) -> Column:
    """Paragraphs: cut at blank lines; trimmed, none empty."""
    return F.filter(F.transform(F.split(text, r"\n[ \t\r]*\n"), lambda x: F.btrim(x, F.lit(" \t\r\n"))), lambda x: x != "")


def typed_cell(cell: Column) -> Column:
    """A cell as JSON text: integer, finite decimal number or boolean where it is one beyond doubt, else a string.

    Leading zeros and plus signs, exponents and integers over 64 bits stay text.
    """
    whole = cell.rlike(r"^-?(0|[1-9][0-9]*)$") & ~cell.rlike("^-0$")
    decimal = F.try_to_number(F.when(whole & (F.length(cell) <= 20), cell), F.lit("MI" + "9" * 20))
    fits = whole & (F.length(cell) <= 20) & decimal.between(F.lit("-9223372036854775808").cast("decimal(20,0)"), F.lit("18446744073709551615").cast("decimal(20,0)"))
    broken = cell.rlike(r"^-?(0|[1-9][0-9]*)\.[0-9]+$")
    flag = F.lower(cell).isin("true", "false")
    text = F.to_json(F.struct(cell.alias("v")))
    quoted = F.substring(text, 6, F.length(text) - 6)
    return F.when(fits, cell).when(broken, cell).when(flag, F.lower(cell)).otherwise(quoted)


def format_scaled(unscaled: Column, scale: int) -> Column:
    """A whole number with its last `scale` digits behind the point."""
    return (unscaled.cast("decimal(20,0)") * F.lit(Decimal(1).scaleb(-scale))).cast(f"decimal(38,{scale})").cast("string")
