"""Removal of repeated rows, by keys and in order."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_wins(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Of rows with equal keys the first in an order; of rows equal in that, the one with the smallest hash."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order, F.xxhash64(*df.columns)))
    return df.withColumn("rank_", rank).where("rank_ = 1").drop("rank_")


def last_wins(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Of rows with equal keys the last one."""
    return first_wins(df, keys, [F.col(seq).desc()])


def any_key(df: DataFrame, keys: list[str], seq: str, by: list[str]) -> DataFrame:
    """Rows none of whose keys an earlier kept row of the same batch has; null keys don't count.

    A dropped row's keys aren't remembered, so the order matters and each batch is a fold.
    ``by`` names the batch. Rows are streamed in order, and only the keys of the open batch
    are held.
    """

    def fold(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch: tuple | None = None
        seen: set[tuple[str, object]] = set()
        for part in parts:
            keep = []
            names = zip(*(part.column(c).to_pylist() for c in by))
            for name, values in zip(names, zip(*(part.column(c).to_pylist() for c in keys))):
                if name != batch:
                    batch, seen = name, set()
                own = {(k, v) for k, v in zip(keys, values) if v is not None}
                keep.append(not own & seen)
                if keep[-1]:
                    seen |= own
            yield part.filter(pa.array(keep, pa.bool_()))

    return df.repartition(*by).sortWithinPartitions(*by, seq).mapInArrow(fold, df.schema)


def merged_facts(facts: DataFrame, key: str, confidence: str, seq: str) -> DataFrame:
    """Of each key the most confident row, the newer of equals, at the place of the first."""
    w = W.partitionBy(key)
    best = F.row_number().over(w.orderBy(F.col(confidence).desc(), F.col(seq).desc()))
    return facts.withColumn("position", F.min(seq).over(w)).withColumn("rank_", best).where("rank_ = 1").drop("rank_")


def unseen(df: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Rows whose key the other table hasn't."""
    return df.join(seen.select(key), key, "left_anti")


def batches_of(df: DataFrame, rows: int) -> Iterator[DataFrame]:
    """A table in parts by row hash, for sinks that take bounded batches."""
    n = max(1, -(-df.count() // rows))
    key = F.pmod(F.xxhash64(*df.columns), F.lit(n))
    for i in range(n):
        yield df.where(key == i)
