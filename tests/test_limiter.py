"""Admitted events under a sliding limit: batch against plain Python, stream against batch."""

import random
from collections import defaultdict, deque

import numpy as np
import pandas as pd
import pytest

from gaugeline.operators import limiter


def plain(rows, width, limit):
    out, windows = defaultdict(lambda: [0, 0]), defaultdict(deque)
    for key, us in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        dq = windows[key]
        while dq and dq[0] < us - width:
            dq.popleft()
        out[key, us][0] += 1
        if len(dq) < limit:
            dq.append(us)
            out[key, us][1] += 1
    return {(k, us, n, a) for (k, us), (n, a) in out.items()}


def log(seed, n=1500):
    rng = random.Random(seed)
    rows = []
    for key, gap in (("hot", 2), ("calm", 70), ("burst", 15), (None, 30)):
        t = 1_700_000_000_000_000
        for _ in range(n if key == "hot" else n // 4):
            t += rng.choice([0, 1, rng.randint(0, 2 * gap * 1_000_000), 10_000_000 if key == "burst" else 0])
            rows.append((key, t))
    return rows


@pytest.mark.parametrize("limit,block", [(1, 40), (3, 40), (3, 10_000), (20, 25)])
def test_batch_equals_plain(spark, limit, block):
    rows = log(limit)
    df = spark.createDataFrame(pd.DataFrame({"key": [k for k, _ in rows], "ts": pd.to_datetime([t for _, t in rows], unit="us")}).astype({"key": object}))
    out = limiter.admitted_events(df, "key", "ts", 60, limit, block).collect()
    assert {tuple(r) for r in out} == plain(rows, 60_000_000, limit) and len(out) == len({r for r in rows})


def test_edges(spark):
    df = spark.createDataFrame([("a", None), ("b", 0), ("b", 0), ("b", 60), ("b", 61)], "key string, s long").selectExpr("key", "timestamp_seconds(s) AS ts", "s AS us")
    out = {(r["key"], r["at_us"] // 1_000_000): (r["events"], r["admitted"]) for r in limiter.admitted_events(df, "key", "ts", 60, 1).collect()}
    assert out == {("b", 0): (2, 1), ("b", 60): (1, 0), ("b", 61): (1, 1)}
    assert limiter.admitted_events(df.limit(0), "key", "ts").count() == 0
    with pytest.raises(ValueError):
        limiter.admitted_events(df, "key", "ts", limit=0)


def test_stream_equals_batch_over_a_restart(spark, tmp_path):
    from gaugeline.streaming import counters
    from gaugeline.streaming import limiter as streaming

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", streaming.ROCKS)
    rows = [(k or "none", t) for k, t in log(9, 400)]
    rng = random.Random(3)
    rows.sort(key=lambda r: r[1] + rng.randint(0, 20_000_000))  # out of order by up to 20 s
    end = max(t for _, t in rows) + 3_600_000_000
    folder, third = str(tmp_path), len(rows) // 3
    for i, part in enumerate((rows[:third], rows[third:2 * third], rows[2 * third:], [("beat", end)], [("beat", end + 3_600_000_000)])):
        pd.DataFrame({"key": [k for k, _ in part], "ts": pd.to_datetime([t for _, t in part], unit="us", utc=True)}).to_parquet(f"{folder}/{i}.parquet", coerce_timestamps="us")
    schema = spark.read.parquet(f"{folder}/0.parquet").schema

    def run(pattern):
        stream = counters.file_stream(spark, folder, schema, pattern, files_per_trigger=1)
        streaming.append_to_parquet(streaming.admitted_stream(stream, "key", "ts", 60, 3, "30 seconds"), f"{folder}/out", f"{folder}/state")
        return {tuple(r) for r in spark.read.parquet(f"{folder}/out").collect()}

    first = run("[01].parquet")
    second = run("*.parquet")
    assert first < second
    assert {r for r in second if r[0] != "beat"} == plain(rows, 60_000_000, 3)


class _Calls:
    """The state of one key, and how often it was asked."""

    def __init__(self):
        self.entries, self.list, self.timers, self.n = {}, [], [], 0

    def getMapState(self, *_):
        return self

    def getListState(self, *_):
        return type("L", (), {"get": lambda _: list(self.list), "put": lambda _, v: setattr(self, "list", v), "clear": lambda _: setattr(self, "list", [])})()

    def keys(self):
        return list(self.entries)

    def iterator(self):
        return list(self.entries.items())

    def containsKey(self, k):
        self.n += 1
        return k in self.entries

    def getValue(self, k):
        self.n += 1
        return self.entries[k]

    def updateValue(self, k, v):
        self.n += 1
        self.entries[k] = v

    def removeKey(self, k):
        self.n += 1
        del self.entries[k]

    def listTimers(self):
        return [(t,) for t in self.timers]

    def deleteTimer(self, t):
        self.timers.remove(t)

    def registerTimer(self, t):
        self.timers.append(t)


def test_stream_asks_its_state_once_a_stretch_and_not_once_an_event():
    from gaugeline.streaming import limiter as streaming
    rng, state = np.random.default_rng(2), _Calls()
    window = streaming.WindowLimit(60_000_000, 3)
    window.init(state)
    us = rng.integers(-300_000_000, 3_000_000_000, 20_000) // 1000 * 1000
    mark = lambda ms: type("T", (), {"getCurrentWatermarkInMs": lambda _: ms})()
    out = []
    for part, ms in zip(np.split(us, 4), (-10**9, -10**9, -10**9, 1_000_000)):
        out += window.handleInputRows(("a",), iter([pd.DataFrame({"us": p}) for p in np.split(part, 5)]), mark(ms))
    assert len(state.timers) == 1 and state.n < 2_000
    out += window.handleExpiredTimer(("a",), mark(4_000_000), None)
    got = pd.concat(out)
    at, n = np.unique(us, return_counts=True)
    assert np.array_equal(got["at_us"], at) and np.array_equal(got["events"], n) and not state.entries and not state.timers
    assert np.array_equal(got["admitted"], limiter.admit(deque(), at, n, 60_000_000, 3))
