"""Schedules: the times of cron expressions, and the runs that are due."""

from __future__ import annotations

import re
from datetime import date, datetime, timedelta, timezone
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The fields of an expression with their ranges, and the names that months and days may have.
_RANGES = ((0, 59), (0, 23), (1, 31), (1, 12), (0, 7))
_NAMES = {3: ["JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC"], 4: ["SUN", "MON", "TUE", "WED", "THU", "FRI", "SAT"]}


class CronError(ValueError):
    pass


def parse(cron: str) -> list[set[int]]:
    """The minutes, hours, days of the month, months and days of the week (0 is Sunday) of an expression of five fields."""
    fields = cron.split()
    if len(fields) != len(_RANGES):
        raise CronError(f"invalid cron {cron!r}: it has {len(fields)} fields")
    out = []
    for k, (text, (low, high)) in enumerate(zip(fields, _RANGES, strict=True)):
        number = lambda x, k=k: _NAMES[k].index(x.upper()) + (k == 3) if x.upper() in _NAMES.get(k, ()) else int(x)
        chosen: set[int] = set()
        for part in text.split(","):
            found = re.fullmatch(r"(\*|\w+)(?:-(\w+))?(?:/(\d+))?", part)
            try:
                first, last, step = found.groups()
                start = low if first == "*" else number(first)
                end = high if first == "*" or (step and last is None) else number(last or first)
                if (first == "*" and last) or not (low <= start <= end <= high) or step == "0":
                    raise ValueError
                chosen.update(range(start, end + 1, int(step or 1)))
            except (AttributeError, ValueError):
                raise CronError(f"invalid cron {cron!r}: {part!r}") from None
        out.append({x % 7 for x in chosen} if k == 4 else chosen)
    return out


def times(cron: str, zone: str, since: datetime, until: datetime) -> list[datetime]:
    """The times in (since, until], in UTC. All five fields must fit; a local time that a clock change leaves out does not occur."""
    minutes, hours, days, months, weekdays = parse(cron)
    try:
        tz = ZoneInfo(zone)
    except (ZoneInfoNotFoundError, ValueError):
        raise CronError(f"unknown time zone {zone!r}") from None
    utc = timezone.utc
    since, until = since.replace(tzinfo=utc), until.replace(tzinfo=utc)
    day, last, out = since.astimezone(tz).date(), until.astimezone(tz).date(), []
    while day <= last:
        if day.month in months and day.day in days and day.isoweekday() % 7 in weekdays:
            out += [t for t in _at(day, hours, minutes, tz) if since < t <= until]
        day += timedelta(days=1)
    return [t.replace(tzinfo=None) for t in sorted(out)]


def _at(day: date, hours: set[int], minutes: set[int], tz: ZoneInfo):
    for h in hours:
        for m in minutes:
            local = datetime(day.year, day.month, day.day, h, m, tzinfo=tz)
            there = local.astimezone(timezone.utc)
            if there.astimezone(tz).replace(tzinfo=None) == local.replace(tzinfo=None):
                yield there


def due(sources: DataFrame, runs: DataFrame, since: datetime, until: datetime) -> DataFrame:
    """sources: source_id, cron, timezone, paused; runs: source_id, started_at, finished_at (null while it runs). source_id and scheduled_at of the runs to start.

    A run carries its scheduled time, not the clock's. A time at which the source's last run was still going on is left
    out, as are paused sources. An expression that cannot be read fails the query.
    """
    tick = F.udf(lambda cron, zone: times(cron, zone, since, until), "array<timestamp_ntz>", useArrow=True)
    ticks = sources.where(~F.col("paused")).select("source_id", F.explode(tick("cron", "timezone")).alias("scheduled_at"))
    begin, end = (F.lit(x).cast("timestamp_ntz") for x in (since, until))
    going = runs.where((F.col("started_at") <= end) & (F.col("finished_at").isNull() | (F.col("finished_at") > begin))).select(F.col("source_id").alias("s"), "started_at", "finished_at")
    in_flight = (F.col("source_id") == F.col("s")) & (F.col("started_at") < F.col("scheduled_at")) & (F.col("finished_at").isNull() | (F.col("finished_at") > F.col("scheduled_at")))
    return ticks.join(going, in_flight, "left_anti")
