"""Scheduled sources: URL templates, incremental state, host rules, ids of a run's jobs."""

from __future__ import annotations

import ipaddress
import re
import uuid
from datetime import datetime, timedelta
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\{\{(.*?)\}\}", re.S)
_DATE = re.compile(r"date\s*(?:([+-])(\d+)([dhm]))?\s*:\s*(.+)", re.S)
_UNITS = {"d": "days", "h": "hours", "m": "minutes"}


class TemplateError(ValueError):
    pass


def render(template: str, scheduled_at: datetime, timezone: str = "UTC") -> str:
    """{{ date:FMT }}, {{ date-1d:FMT }} (d, h, m) and {{ timestamp }} at the scheduled time in the time zone; anything else is an error."""
    try:
        zone = ZoneInfo(timezone)
    except (ZoneInfoNotFoundError, ValueError):
        raise TemplateError(f"unknown time zone {timezone!r}") from None

    def expand(m: re.Match) -> str:
        token = m[1].strip()
        if token == "timestamp":
            return str(int(scheduled_at.timestamp()))
        found = _DATE.fullmatch(token)
        if not found:
            raise TemplateError(f"unknown token {token!r}")
        sign, n, unit, form = found.groups()
        try:
            moved = scheduled_at + timedelta(**{_UNITS[unit]: int(sign + n)}) if n else scheduled_at
        except OverflowError:
            raise TemplateError(f"{token!r} is outside of all dates") from None
        if re.search(r"%(?![A-Za-z%])", form):
            raise TemplateError(f"{form!r} is no date format")
        return moved.astimezone(zone).strftime(form.strip())

    out = _TOKEN.sub(expand, template)
    if "{{" in _TOKEN.sub("", template):
        raise TemplateError("a token has no end")
    return out


def host_allowed(host: str, allowed: list[str] | None = None) -> bool:
    """Whether a host is on the list (`*.example.org` for those below it), or without a list, not a private address."""
    host = host.lower().rstrip(".")
    if allowed is not None:
        return any(host == a or (a.startswith("*.") and host.endswith(a[1:])) for a in map(str.lower, allowed))
    try:
        return ipaddress.ip_address(host.strip("[]")).is_global
    except ValueError:
        return host != "localhost" and not host.endswith((".localhost", ".local", ".internal"))


def object_allowed(uri: str, buckets: list[str]) -> bool:
    """Whether an s3, gs, az or abfss URI is in a listed bucket."""
    m = re.fullmatch(r"(s3|gs|az|abfss)://(?:([^@/]+)@)?([^/]+)(/.*)?", uri)
    return bool(m) and ".." not in uri.split("/") and (m[2] or m[3]) in buckets


def source_job_id(run_id: uuid.UUID, source_id: uuid.UUID, scheduled_at: datetime, ordinal: int) -> uuid.UUID:
    return uuid.uuid5(run_id, f"source-item/{source_id}/{scheduled_at.isoformat()}/{ordinal}")


def file_job_id(job_id: uuid.UUID, ordinal: int) -> uuid.UUID:
    return uuid.uuid5(job_id, f"archive-file-{ordinal}")


def blake3(data: Column) -> Column:
    from ..functions.blake3 import blake3_hex

    return F.udf(lambda d: None if d is None else blake3_hex(bytes(d)), "string", useArrow=True)(data.cast("binary"))


def changed(fetched: DataFrame, state: DataFrame, digest=blake3) -> DataFrame:
    """fetched: source_id, content. Those whose hash is not the stored one, with it."""
    return fetched.withColumn("hash", digest(F.col("content"))).join(state.select("source_id", "hash"), ["source_id", "hash"], "left_anti")


def commit(state: DataFrame, run: DataFrame) -> DataFrame:
    """run: source_id, hash, ok (of each of its jobs). The state moves on where every job succeeded."""
    new = run.groupBy("source_id").agg(F.max("hash").alias("new"), F.bool_and("ok").alias("ok")).where("ok").select("source_id", "new")
    both = state.join(new, "source_id", "full_outer")
    return both.select("source_id", F.coalesce("new", "hash").alias("hash"))


def maybe_gunzip(data: Column) -> Column:
    from ..operators.archives import gunzip

    unpack = F.udf(lambda d: gunzip(bytes(d), 512 << 20) if d is not None else None, "binary", useArrow=True)
    packed = F.hex(F.substring(data, 1, 2)) == "1F8B"
    return F.coalesce(unpack(F.when(packed, data)), data)  # a Python function sees all rows, whatever stands around it
