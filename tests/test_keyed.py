from __future__ import annotations

import collections
import datetime as dt
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestrata.plans.streams import _in_parts
from lodestrata.sources import message_bus as B
from lodestrata.streaming import keyed as K


def plain(rows, cap, refresh):
    known = collections.defaultdict(collections.OrderedDict)
    out = []
    for who, n, key in rows:
        held = known[who]
        if key in held:
            if refresh:
                held.move_to_end(key)
            continue
        out.append((who, n, key))
        held[key] = None
        if len(held) > cap:
            held.popitem(last=False)
    return out


@pytest.mark.parametrize("refresh", [False, True])
def test_recent_keys_over_restarts(spark, refresh):
    rng = np.random.default_rng(8)
    rows = [(int(rng.integers(2)), i, None if k == 0 else f"k{k}") for i, k in enumerate(rng.integers(0, 7, 60))]
    parts = [spark.createDataFrame(rows[a : a + 20], "who long, n long, key string") for a in (0, 20, 40)]
    got = _in_parts(parts, lambda s: K.recent_dedup(s, "who", "key", "n", cap=3, refresh=refresh), "recent-test")
    want = plain([(w, n, str(k)) for w, n, k in rows], 3, refresh)
    assert sorted((r["who"], r["n"], str(r["key"])) for r in got.collect()) == sorted(want)


def test_keys_past_their_time_are_new(spark, tmp_path):
    folder, out, state = (f"file://{tmp_path}/{x}" for x in ("in", "out", "state"))
    for n in (1, 2):
        spark.createDataFrame([(1, n, "a"), (1, n, "a")], "who long, n long, key string").coalesce(1).write.mode("append").parquet(folder)
        stream = K.recent_dedup(spark.readStream.schema("who long, n long, key string").parquet(folder), "who", "key", "n", cap=5, ttl_ms=1000)
        run = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(processingTime="1 second").start()
        end, held = time.time() + 40, spark.createDataFrame([], stream.schema)
        while time.time() < end and held.count() < n:
            time.sleep(0.5)
            held = spark.read.schema(stream.schema).parquet(out) if (tmp_path / "out/_spark_metadata").exists() else held
        run.stop()
        time.sleep(1.2)
    assert sorted(r["n"] for r in spark.read.parquet(out).collect()) == [1, 2]


def test_queue_keeps_what_is_not_due(spark):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    parts = [spark.createDataFrame(rows, "who long, ts timestamp, n long, body string") for rows in ([(1, at(0), 1, "a"), (1, at(1), 2, None), (1, at(1), 3, "c"), (2, at(5), 4, "d")], [(2, at(22), 5, "e")])]
    got = _in_parts(parts, lambda s: K.paced(s, "who", "ts", "n", "body", 10_000, "0 seconds"), "paced-test").collect()
    assert sorted((r["id"], (r["leaves"] - at(0)).total_seconds(), r["body"]) for r in got) == [(1, 0, "a"), (2, 10, None), (3, 20, "c"), (4, 5, "d"), (5, 22, "e")]


def test_bus_is_read_once_and_in_order(spark, tmp_path):
    path, out = f"file://{tmp_path}/bus", f"file://{tmp_path}/out"
    put = lambda a, b: B.publish(spark.range(a, b), F.col("id"), F.concat(F.lit("m"), "id"), path)

    def drain():
        B.consume(spark, path, per_task=3).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
        return sorted(r["body"] for r in spark.read.schema("name string, body string").parquet(out).collect())

    put(0, 8)
    assert drain() == sorted(f"m{i}" for i in range(8)) == drain()
    put(8, 10)
    assert drain() == sorted(f"m{i}" for i in range(10))
    assert [r["body"] for r in B.waiting(spark, path).orderBy("name").collect()] == [f"m{i}" for i in range(10)]
    assert B.waiting(spark, f"file://{tmp_path}/none").count() == 0


class _Counted:
    """A state variable that counts calls of its methods."""

    def __init__(self, calls):
        self.held, self.calls = {}, calls

    def __getattr__(self, name):
        self.calls[name] += 1
        return {"get": lambda: self.held.get(()), "update": lambda v: self.held.update({(): v}), "getValue": self.held.get, "containsKey": self.held.__contains__, "updateValue": self.held.__setitem__, "removeKey": lambda k: self.held.pop(k, None), "exists": lambda: () in self.held}[name]


class _Handle:
    def __init__(self):
        self.calls, self.timers = collections.Counter(), []

    def getMapState(self, *args):
        return _Counted(self.calls)

    getValueState = getMapState

    def registerTimer(self, ms):
        self.timers.append(ms)


def test_queue_takes_few_calls_of_state():
    handle, queue = _Handle(), K._Paced("who", "n", "body", 10)
    queue.init(handle)
    assert not list(queue.handleInputRows((1,), iter([{"us_": 0, "n": i, "body": "a"} for i in range(3000)]), None))
    times = lambda ms: type("Now", (), {"getCurrentWatermarkInMs": lambda self: ms})()
    got = [r for ms in (15_000, 15_005, 40_000) for r in queue.handleExpiredTimer((1,), times(ms), None)]
    assert [(r[1], r[3]) for r in got] == [(i, 10 * i) for i in range(3000)]
    assert handle.timers == [0, 15_010, 15_010] and sum(handle.calls.values()) <= 20


@pytest.mark.parametrize("refresh", [False, True])
def test_recent_keys_take_few_calls_of_state(refresh):
    handle, out, rows = _Handle(), [], []
    recent = K._Recent("key", "n", 2, refresh, None)
    recent.init(handle)
    for part in range(3):
        batch = pd.DataFrame({"who": 1, "n": range(500 * part, 500 * part + 500), "key": [f"k{n * n % 7 % 4}" for n in range(500)]})
        rows += list(batch.itertuples(index=False, name=None))
        out += [tuple(r) for got in recent.handleInputRows((1,), iter([batch]), None) for r in got.itertuples(index=False, name=None)]
    assert out == plain(rows, 2, refresh) and 0 < len(out) < len(rows)
    assert sum(handle.calls.values()) <= 60 and set(recent.seen.held.values()) == {(n,) for n, in recent.notes.held}
