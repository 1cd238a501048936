"""Streams of messages: bounded dedup, debounce, sessions, cursors and incremental collection."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestrata.runtime import ship


def first_seen(stream: DataFrame, keys: list[str], ts: str, delay: str) -> DataFrame:
    """Each key once, if it doesn't come again later than the delay."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def bounded_dedup(stream: DataFrame, by: str, key: str, order: str, cap: int = 2000) -> DataFrame:
    """Rows whose key isn't among the last ``cap`` new ones of the same ``by``; the oldest key is forgotten first.

    Rows of a micro-batch are taken by ``order`` and then by key, as a shuffle may bring
    them in any order.
    """
    ship(stream.sparkSession)

    def step(_: tuple, parts: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = dict.fromkeys(state.get[0]) if state.exists else {}
        rows = pd.concat(list(parts)).sort_values([order, key], kind="stable")  # one micro-batch of one key
        keep = []
        for value in rows[key].astype(str):
            keep.append(value not in known)
            if keep[-1]:
                known[value] = None
                if len(known) > cap:
                    del known[next(iter(known))]
        state.update((list(known),))
        yield rows[keep]

    return stream.groupBy(by).applyInPandasWithState(step, stream.schema, "known array<string>", "append", GroupStateTimeout.NoTimeout)


def debounced(stream: DataFrame, by: str, ts: str, text: str, mention: str, gap_ms: int, delay: str) -> DataFrame:
    """(by, body, n, first, last, why): the texts of a key joined by line feeds.

    The buffer is given out when no message came for the gap, or at once when a message
    mentions the receiver. Gaps are measured in event time, so replays give the same.
    """
    ship(stream.sparkSession)
    schema = T.StructType([stream.schema[by], *T.StructType.fromDDL("body string, n int, first timestamp, last timestamp, why string").fields])

    def step(name: tuple, parts: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, first, last = state.get if state.exists else ([], None, None)
        held = list(held)
        out: list[tuple] = []

        def flush(why: str) -> None:
            nonlocal held
            stamp = lambda ms: pd.Timestamp(ms, unit="ms")
            out.append((name[0], "\n".join(held), len(held), stamp(first), stamp(last), why))
            held = []

        if state.hasTimedOut:
            if held:
                flush("gap")
        else:
            rows = pd.concat(list(parts)).sort_values(ts, kind="stable")
            for at, body, named in zip(rows[ts], rows[text], rows[mention]):
                now = int(at.timestamp() * 1000)
                if held and now - last >= gap_ms:
                    flush("gap")
                first, last = (now if not held else first), now
                held.append(body or "")
                if named:
                    flush("mention")
        if held:
            state.update((held, first, last))
            state.setTimeoutTimestamp(max(last + gap_ms, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=[f.name for f in schema.fields])

    kept = stream.withWatermark(ts, delay)
    return kept.groupBy(by).applyInPandasWithState(step, schema, "held array<string>, first long, last long", "append", GroupStateTimeout.EventTimeTimeout)


def session_counts(stream: DataFrame, by: list[str], ts: str, gap: str, delay: str) -> DataFrame:
    """Sessions by a gap of inactivity; late rows beyond the delay are dropped."""
    return stream.withWatermark(ts, delay).groupBy(*by, F.session_window(ts, gap)).agg(F.count("*").alias("n"))


def cursors(stream: DataFrame, by: str, position: str) -> DataFrame:
    """The largest position of each key so far."""
    return stream.groupBy(by).agg(F.max(position).alias(position))


def new_items(batch: DataFrame, seen: DataFrame, mark: object, key: str, updated: str) -> tuple[DataFrame, object]:
    """Items whose key is unseen and whose time is after the mark, and the next mark."""
    fresh = batch.where(F.col(updated) > F.lit(mark)) if mark is not None else batch
    fresh = fresh.join(seen.select(key), key, "left_anti").dropDuplicates([key])
    most = fresh.agg(F.max(updated).alias("m")).first()["m"]
    return fresh, mark if most is None else most
