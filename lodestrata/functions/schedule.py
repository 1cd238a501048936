"""Next run times of cron expressions, for small tables of schedules."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from zoneinfo import ZoneInfo

import pyarrow as pa
from pyspark.sql import DataFrame

from lodestrata.runtime import extended, ship

_BOUNDS = ((0, 59), (0, 23), (1, 31), (1, 12), (0, 7))


def _field(text: str, low: int, high: int) -> set[int]:
    """The values of one field: lists of numbers, ranges and stars, each with a step."""
    out: set[int] = set()
    for part in text.split(","):
        span, _, step = part.partition("/")
        a, _, b = span.partition("-")
        first, last = (low, high) if span == "*" else (int(a), int(b) if b else (high if step else int(a)))
        if not low <= first <= last <= high or (step and int(step) < 1):
            raise ValueError(f"not a cron field: {text}")
        out |= set(range(first, last + 1, int(step or 1)))
    return out


def next_run(expression: str | None, after: dt.datetime, zone: str = "UTC") -> dt.datetime | None:
    """The first minute after a time (both in UTC) that an expression of five fields names in a zone.

    Where day and weekday are both given either will do. None for what is no expression, or
    never comes within five years.
    """
    try:
        minutes, hours, days, months, weekdays = (_field(x, *b) for x, b in zip((expression or "").split(), _BOUNDS, strict=True))
    except ValueError:
        return None
    weekdays = {d % 7 for d in weekdays}
    parts = expression.split()
    either = parts[2] != "*" and parts[4] != "*"
    local = after.replace(tzinfo=dt.timezone.utc).astimezone(ZoneInfo(zone))
    day = local.date()
    for _ in range(5 * 366):
        by_day, by_week = day.day in days, day.isoweekday() % 7 in weekdays
        if day.month in months and ((by_day or by_week) if either else (by_day and by_week)):
            for h in sorted(hours):
                for m in sorted(minutes):
                    at = dt.datetime(day.year, day.month, day.day, h, m, tzinfo=ZoneInfo(zone)).astimezone(dt.timezone.utc).replace(tzinfo=None)
                    if at > after:
                        return at
        day += dt.timedelta(days=1)
    return None


def scheduled(df: DataFrame, expression: str, after: str, zone: str = "UTC") -> DataFrame:
    """Adds ``next_run``."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column(expression).to_pylist(), batch.column(after).to_pylist())
            out = [None if t is None else next_run(e, t.replace(tzinfo=None), zone) for e, t in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.timestamp("us"))], [*batch.schema.names, "next_run"])

    return df.mapInArrow(run, extended(df.schema, "next_run timestamp_ntz"))
