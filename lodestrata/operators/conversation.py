"""Operators on tables of conversation turns."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.functions.text import char_estimate, excerpt
from lodestrata.operators.windows import segments

_TURNS = ["conv_id"]


def rounds(turns: DataFrame) -> DataFrame:
    """``segment``: a new round begins at each user turn that has text."""
    return segments(turns, (F.col("role") == "user") & (F.trim("text") != ""), _TURNS, ["turn"])


def without_oldest(turns: DataFrame, parts: int = 5) -> DataFrame:
    """Drops the oldest fifth of each conversation's rounds, one at least, and keeps one at least."""
    cut = rounds(turns).withColumn("rounds_", F.max("segment").over(W.partitionBy(*_TURNS)))
    drop = F.least(F.greatest(F.lit(1), F.floor(F.col("rounds_") / parts)), F.col("rounds_") - 1)
    return cut.where(F.col("segment") > drop).drop("segment", "rounds_")


def microcompacted(turns: DataFrame, eligible: Column, keep: int = 5, marker: str = "[cleared]") -> DataFrame:
    """All but the last ``keep`` eligible texts of a conversation become a marker; ``saved`` is what that saves."""
    rank = F.row_number().over(W.partitionBy(*_TURNS, "eligible_").orderBy(F.col("turn").desc()))
    out = turns.withColumn("eligible_", eligible).withColumn("gone_", F.col("eligible_") & (rank > keep))
    saved = F.when(F.col("gone_"), F.greatest(F.lit(0), char_estimate("text") - char_estimate(F.lit(marker)))).otherwise(0)
    return out.withColumn("saved", saved).withColumn("text", F.when(F.col("gone_"), marker).otherwise(F.col("text"))).drop("eligible_", "gone_")


def collapsed(turns: DataFrame, recent: int, limit: int = 2400, head: int = 900, tail: int = 500) -> DataFrame:
    """Long texts of older turns keep a head and a tail."""
    back = F.row_number().over(W.partitionBy(*_TURNS).orderBy(F.col("turn").desc()))
    text = F.col("text")
    short = F.concat(F.substr(text, F.lit(1), F.lit(head)), F.lit("\n...\n"), F.substr(text, F.length(text) - tail + 1, F.lit(tail)))
    return turns.withColumn("back_", back).withColumn("text", F.when((F.col("back_") > recent) & (F.length(text) > limit), short).otherwise(text)).drop("back_")


def summary_lines(turns: DataFrame, lines: int = 48, chars: int = 4000, width: int = 160) -> DataFrame:
    """One line for each turn, until a number of lines or characters is reached."""
    line = F.concat_ws(": ", "role", excerpt("text", width))
    told = turns.where(F.trim("text") != "").withColumn("line", line)
    w = W.partitionBy(*_TURNS).orderBy("turn")
    used = F.sum(F.length("line") + 1).over(w.rowsBetween(W.unboundedPreceding, 0))
    return told.withColumn("no", F.row_number().over(w)).withColumn("used", used).where((F.col("no") <= lines) & (F.col("used") <= chars)).select(*_TURNS, "turn", "line")


def over_threshold(turns: DataFrame, window: int, reserve: int) -> DataFrame:
    """For each conversation the first turn at which the running estimate reaches window less reserve."""
    total = F.sum(char_estimate("text")).over(W.partitionBy(*_TURNS).orderBy("turn").rowsBetween(W.unboundedPreceding, 0))
    return turns.withColumn("total", total).where(F.col("total") >= window - reserve).groupBy(*_TURNS).agg(F.min("turn").alias("turn"), F.min("total").alias("total"))


def sanitized(messages: DataFrame) -> DataFrame:
    """Conversations in which each call has its result.

    ``messages`` has conv_id, turn, role, text, calls and results (arrays of ids). Empty
    assistant turns go. An assistant turn with calls stays only if the next turn left is
    the user's and has all their results. Results without a call go, and a turn that is
    empty then goes too. What is left depends on what was dropped before, so each
    conversation is a fold. Turns are streamed in order, and of a conversation only a turn
    that waits for its results is held.
    """

    def fold(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_one: tuple | None = None
        pending: dict | None = None
        for part in parts:
            kept: list[dict] = []
            for row in part.to_pylist():
                name = tuple(row[c] for c in _TURNS)
                if name != open_one:
                    open_one, pending = name, None
                row["calls"], row["results"] = row["calls"] or [], row["results"] or []
                says = bool((row["text"] or "").strip())
                if row["role"] == "assistant":
                    pending = row if row["calls"] else None
                    if says and not row["calls"]:
                        kept.append(row)
                    continue
                answered = pending is not None and set(pending["calls"]) <= set(row["results"])
                row["results"] = [r for r in row["results"] if r in pending["calls"]] if answered else []
                kept += [pending] if answered else []
                pending = None
                if says or row["results"]:
                    kept.append(row)
            yield pa.RecordBatch.from_pylist(kept, schema=part.schema)

    ordered = messages.repartition(*_TURNS).sortWithinPartitions(*_TURNS, "turn")
    return ordered.mapInArrow(fold, messages.schema)
