"""Metadata filters: a mapping of keys to values or operators becomes one Column."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

Lookup = Callable[[str], Column]


def _number(x: Any) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def _compared(actual: Column, op: str, value: Any) -> Column:
    if not _number(value):
        return F.lit(False)
    have = actual.try_cast("double")
    found = {"$gt": have > value, "$gte": have >= value, "$lt": have < value, "$lte": have <= value}[op]
    return F.coalesce(found, F.lit(False))


def _one(actual: Column, op: str, value: Any) -> Column:
    match op:
        case "$eq":
            return actual.eqNullSafe(F.lit(value))
        case "$ne":
            return ~actual.eqNullSafe(F.lit(value))
        case "$gt" | "$gte" | "$lt" | "$lte":
            return _compared(actual, op, value)
        case "$in" | "$nin":
            if not isinstance(value, (list, tuple)):
                return F.lit(op == "$nin")
            inside = reduce(lambda a, b: a | b, (actual.eqNullSafe(F.lit(v)) for v in value), F.lit(False))
            return inside if op == "$in" else ~inside
    return F.lit(False)


def where(condition: Mapping[str, Any] | None, lookup: Lookup = F.col) -> Column:
    """All keys must match; a plain value means equality.

    A missing value passes $ne and $nin and fails all comparisons, which are numeric only.
    An unknown operator, or a key that begins with $, matches nothing.
    """
    parts: list[Column] = []
    for key, wanted in (condition or {}).items():
        if key.startswith("$"):
            return F.lit(False)
        ops = wanted if isinstance(wanted, Mapping) else {"$eq": wanted}
        parts += [_one(lookup(key), op, value) for op, value in ops.items()]
    return reduce(and_, parts, F.lit(True))


def ranges_overlap(low: Column, high: Column, least: float | None, most: float | None) -> Column:
    """Whether low..high meets least..most; an absent bound is open, a missing value fails."""
    out = F.lit(True)
    if least is not None:
        out = out & F.coalesce(high >= least, F.lit(False))
    if most is not None:
        out = out & F.coalesce(low <= most, F.lit(False))
    return out


def contains_either(a: Column, b: Column) -> Column:
    """Either text contains the other; an empty or missing one passes."""
    return F.coalesce(a.contains(b) | b.contains(a) | (a == "") | (b == ""), F.lit(True))


def years_fit(years: float | None, low: Column, high: Column) -> Column:
    """Years of experience within two years of a range; missing values pass."""
    if years is None:
        return F.lit(True)
    return F.coalesce((low - 2 <= years) & (high + 2 >= years), F.lit(True))


def expired(updated: Column, created: Column, ttl_days: Column, as_of: Column) -> Column:
    """Whether the last update, else the creation, lies ttl_days back; never without both."""
    return F.coalesce(as_of >= F.timestamp_add("DAY", ttl_days, F.coalesce(updated, created)), F.lit(False))


def fresh(day: Column, as_of: Column, days: int) -> Column:
    """Whether a day lies 0 to ``days`` days back; future days don't count."""
    return F.coalesce(F.datediff(as_of, day).between(0, days), F.lit(False))
