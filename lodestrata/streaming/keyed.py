"""Streams with keyed state: bounded dedup, cursors with a cold start, and queues that are paced.

State is kept entry by entry (``transformWithState``), so a message costs a few entries and
not a rewrite of all that its key holds. It needs the RocksDB state store, which the
functions here choose for the session. Rows of one key in a micro-batch are taken in a
stated order, as a shuffle may bring them in any.
"""

from __future__ import annotations

import pickle
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lodestrata.runtime import ship

#: Rows of a queue that are one entry of state.
BLOCK_ROWS = 1024
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _ready(spark: SparkSession) -> None:
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)


def _ordered(rows: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    """A micro-batch of one key."""
    parts = list(rows)
    batch = parts[0] if len(parts) == 1 else pd.concat(parts)
    return (batch if len(batch) == 1 else batch.sort_values(by, kind="stable")).reset_index(drop=True)


class _Held:
    """A map of state during one micro-batch of one key: an entry is read at most once, and written once at the end if it changed.

    ``none_from``: numbers from here on have no entry before this batch.
    """

    def __init__(self, state, none_from: int | None = None) -> None:
        self.state, self.none_from = state, none_from
        self.was, self.now = {}, {}

    def get(self, key):
        if key not in self.now:
            got = None
            if self.none_from is None or key < self.none_from:
                got = self.state.getValue((key,))
            self.was[key] = self.now[key] = got[0] if got is not None else None
        return self.now[key]

    def put(self, key, value) -> None:
        """Sets an entry that was read before; None removes it."""
        self.now[key] = value

    def write(self) -> None:
        for key, value in self.now.items():
            if value is None and self.was[key] is not None:
                self.state.removeKey((key,))
            elif value != self.was[key]:
                self.state.updateValue((key,), (value,))


class _Recent(StatefulProcessor):
    """``seen``: the number under which a key was noted last; ``notes``: keys by number; ``ends``: the first and next number, and how many keys there are.

    Each call of state is a message to the JVM, so a micro-batch reads an entry once and writes what has changed in the end.
    """

    def __init__(self, key: str, order: str, cap: int, refresh: bool, ttl_ms: int | None) -> None:
        self.key, self.order, self.cap, self.refresh, self.ttl_ms = key, order, cap, refresh, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "key string", "number long", self.ttl_ms)
        self.notes = handle.getMapState("notes", "number long", "key string", self.ttl_ms)
        self.ends = handle.getValueState("ends", "first long, next long, held long", None)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known_ends = self.ends.get()
        before = first, nxt, held = known_ends or (0, 0, 0)
        batch = _ordered(rows, [self.order, self.key])
        seen, notes, keep = _Held(self.seen), _Held(self.notes, nxt), []
        if not known_ends:
            seen = _Held(self.seen, "")  # nothing is known
        for value in batch[self.key].astype(str):
            known = seen.get(value)
            keep.append(known is None)
            if known is not None and not self.refresh:
                continue
            if known is not None:
                notes.get(known)
                notes.put(known, None)
            seen.put(value, nxt)
            notes.get(nxt)
            notes.put(nxt, value)
            nxt, held = nxt + 1, held + (known is None)
            while held > self.cap and first < nxt:
                oldest = notes.get(first)
                if oldest is not None:
                    seen.get(oldest)
                    seen.put(oldest, None)
                    notes.put(first, None)
                    held -= 1
                first += 1
            held = min(held, nxt - first)  # entries past their time are gone without being counted
        seen.write()
        notes.write()
        if (first, nxt, held) != before:
            self.ends.update((first, nxt, held))
        yield batch[keep]

    def close(self) -> None:
        pass


def recent_dedup(stream: DataFrame, by: str, key: str, order: str, cap: int = 1000, refresh: bool = False, ttl_ms: int | None = None) -> DataFrame:
    """Rows whose key isn't among the last ``cap`` of the same ``by``.

    The key noted first is forgotten first; with ``refresh`` a repeated key is noted anew, so
    that the one not met for longest is forgotten. ``ttl_ms`` also forgets what wasn't noted
    for so long; such a stream has processing time and runs until it is stopped, also with
    ``availableNow``. Rows are taken by ``order`` and then by key. A null key is a key.
    """
    _ready(stream.sparkSession)
    return stream.groupBy(by).transformWithStateInPandas(_Recent(key, order, cap, refresh, ttl_ms), stream.schema, "append", "processingTime" if ttl_ms else "none")


class _After(StatefulProcessor):
    def __init__(self, position: str) -> None:
        self.position = position

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.cursor = handle.getValueState("cursor", "position long", None)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.cursor.update((int(initialState[self.position].max()),))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = _ordered(rows, [self.position])
        known = self.cursor.get()[0] if self.cursor.exists() else None
        last = int(batch[self.position].max())
        self.cursor.update((last if known is None else max(known, last),))
        yield batch[batch[self.position] > known] if known is not None else batch[:0]

    def close(self) -> None:
        pass


def after_cursor(stream: DataFrame, by: str, position: str, start: DataFrame | None = None) -> DataFrame:
    """Rows beyond the cursor of their ``by``; the cursor then stands at the largest position.

    ``start`` has the cursors known before the stream begins, one row (by, position) each.
    A ``by`` without a cursor is cold: what its first micro-batch brings is a backlog that
    only sets the cursor.
    """
    _ready(stream.sparkSession)
    held = start.groupBy(by) if start is not None else None
    return stream.groupBy(by).transformWithStateInPandas(_After(position), stream.schema, "append", "none", initialState=held)


class _Paced(StatefulProcessor):
    """``blocks``: waiting rows, those of one micro-batch together, by number of block; ``ends``: the first waiting block and how many of its rows have left, the next block, and the last departure."""

    def __init__(self, by: str, order: str, body: str, gap_ms: int) -> None:
        self.by, self.order, self.body, self.gap = by, order, body, gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.blocks = handle.getMapState("blocks", "number long", "rows binary", None)
        self.ends = handle.getValueState("ends", "first long, left long, next long, last long", None)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        first, left, nxt, last = self.ends.get() or (0, 0, 0, -(1 << 62))
        waits, due = nxt > first, []
        for us, number, body in sorted(((r["us_"], r[self.order], r[self.body]) for r in rows), key=lambda r: r[:2]):
            came = us // 1000
            last = max(came, last + self.gap)
            due.append((number, came, last, body))
        for at in range(0, len(due), BLOCK_ROWS):
            self.blocks.updateValue((nxt,), (pickle.dumps(due[at : at + BLOCK_ROWS]),))
            nxt += 1
        if not waits:
            self.handle.registerTimer(due[0][2])
        self.ends.update((first, left, nxt, last))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        first, left, nxt, last = self.ends.get()
        now, later = timerValues.getCurrentWatermarkInMs(), None
        made = Row(self.by, "id", "arrived", "leaves", "body")
        while first < nxt and later is None:
            block = pickle.loads(self.blocks.getValue((first,))[0])
            end = bisect_right(block, now, left, key=lambda r: r[2])
            for number, came, leaves, body in block[left:end]:
                yield made(key[0], number, came, leaves, body)
            if end < len(block):
                left, later = end, block[end][2]
            else:
                self.blocks.removeKey((first,))
                first, left = first + 1, 0
        if later is not None:
            self.handle.registerTimer(later)
        self.ends.update((first, left, nxt, last))

    def close(self) -> None:
        pass


def paced(stream: DataFrame, by: str, ts: str, order: str, body: str, gap_ms: int, delay: str) -> DataFrame:
    """A queue for each ``by``: (by, id, arrived, leaves, body), first in, first out.

    A row leaves when it came, but no sooner than ``gap_ms`` after the one before it. It is
    given out once the watermark has passed that time, by a timer; a replay gives the same.
    ``order`` is a number that decides between rows of one time.
    """
    _ready(stream.sparkSession)
    schema = T.StructType([stream.schema[by], *T.StructType.fromDDL("id long, arrived long, leaves long, body string").fields])
    kept = stream.withWatermark(ts, delay).select(by, ts, F.col(order).cast("long").alias(order), F.col(body).cast("string").alias(body), F.unix_micros(ts).alias("us_"))
    out = kept.groupBy(by).transformWithState(_Paced(by, order, body, gap_ms), schema, "append", "eventTime")
    return out.select(by, "id", F.timestamp_millis("arrived").alias("arrived"), F.timestamp_millis("leaves").alias("leaves"), "body")
