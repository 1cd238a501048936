"""Interleaving, segmentation and other ordered operators on groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def round_robin(df: DataFrame, bucket: Column, order: list[Column], within: list[str]) -> DataFrame:
    """``round`` and ``first_seen``: one row of each bucket a round, buckets as they were first seen."""
    out = df.withColumn("bucket_", bucket)
    out = out.withColumn("round", F.row_number().over(W.partitionBy(*within, "bucket_").orderBy(*order)))
    return out.withColumn("first_seen", F.min(order[0]).over(W.partitionBy(*within, "bucket_"))).drop("bucket_")


def segments(df: DataFrame, starts: Column, by: list[str], order: list[str]) -> DataFrame:
    """``segment``: the number of starts up to a row, in order."""
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn("segment", F.count_if(starts).over(w))


def filled_forward(df: DataFrame, value: Column, by: list[str], order: list[str], default: str) -> DataFrame:
    """``section``: the last value seen, or the default."""
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn("section", F.coalesce(F.last(value, ignorenulls=True).over(w), F.lit(default)))


def latest(df: DataFrame, by: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each group in an order, with ``rank``; Spark limits groups before it shuffles."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= n)


def sessions(df: DataFrame, by: list[str], ts: str, gap: str) -> DataFrame:
    """(by, start, end, n) of runs of rows less than a gap apart."""
    w = F.session_window(ts, gap)
    return df.groupBy(*by, w).agg(F.count("*").alias("n"), F.max(ts).alias("last")).select(*by, F.col("session_window.start").alias("start"), "last", "n")
