"""Upserts, deletes and diffs of snapshots.

A snapshot is replaced as a whole: each operator returns the new rows, which the caller
writes as a new version.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.operators.dedup import last_wins


def upsert(old: DataFrame, new: DataFrame, key: str, seq: str | None = None) -> DataFrame:
    """New rows replace old ones by key; of new rows with one key the last (by ``seq``) counts."""
    new = last_wins(new, [key], seq).drop(seq) if seq else new
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def merge(old: DataFrame, new: DataFrame, key: str, hash_column: str) -> DataFrame:
    """All rows of both with ``action``: insert, update, skip (equal hash) or keep (old only).

    Values that are null or empty in a new row leave the old ones in place.
    """
    columns = [c for c in old.columns if c != key]
    a = old.select(key, F.lit(True).alias("old_"), *(F.col(c).alias(f"o_{c}") for c in columns))
    b = new.select(key, F.lit(True).alias("new_"), *(F.col(c).alias(f"n_{c}") for c in columns))
    both = a.join(b, key, "full_outer")
    same = F.col(f"o_{hash_column}").eqNullSafe(F.col(f"n_{hash_column}"))
    action = F.when(F.col("old_").isNull(), "insert").when(F.col("new_").isNull(), "keep").when(same, "skip").otherwise("update")
    kinds = dict(old.dtypes)
    overlay = lambda c: F.coalesce(F.when(F.col(f"n_{c}") != "", F.col(f"n_{c}")) if kinds[c] == "string" else F.col(f"n_{c}"), F.col(f"o_{c}")).alias(c)
    return both.select(key, *(overlay(c) for c in columns), action.alias("action"))


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, *compared: str) -> DataFrame:
    """(key, change) of the rows that were added, removed or changed."""
    a = old.select(key, F.lit(True).alias("old_"), F.struct(*compared).alias("a_"))
    b = new.select(key, F.lit(True).alias("new_"), F.struct(*compared).alias("b_"))
    both = a.join(b, key, "full_outer")
    change = F.when(F.col("old_").isNull(), "added").when(F.col("new_").isNull(), "removed").when(~F.col("a_").eqNullSafe(F.col("b_")), "changed")
    return both.select(key, change.alias("change")).where("change IS NOT NULL")


def marked(df: DataFrame, condition: Column, column: str, value: str, frozen: str) -> DataFrame:
    """Rows that meet a condition get a value in a column, unless they have the frozen one."""
    return df.withColumn(column, F.when(condition & (F.col(column) != frozen), F.lit(value)).otherwise(F.col(column)))


def delete(df: DataFrame, ids: list | None = None, condition: Column | None = None, key: str = "id") -> DataFrame:
    """Without the rows of some ids, or else those that meet a condition; one of both is needed."""
    if ids is None and condition is None:
        raise ValueError("ids or a condition is needed")
    gone = F.col(key).isin(list(ids)) if ids is not None else condition
    return df.where(~F.coalesce(gone, F.lit(False)))


# The states of an application in order, and the one beside them.
STATES = ["已投递", "简历筛选中", "笔试", "一面", "二面", "HR面", "Offer", "已入职"]
REJECTED = "已拒绝"


def transition_allowed(now: Column, then: Column) -> Column:
    """Forward along ``STATES`` only; a rejection from any state that isn't final."""
    place = lambda c: F.array_position(F.array(*map(F.lit, STATES)), c)
    final = now.isin(STATES[-1], REJECTED)
    return F.when(final, False).when(then == REJECTED, True).otherwise(place(then) > place(now))
