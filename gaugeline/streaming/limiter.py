"""The sliding-window limit of :mod:`gaugeline.operators.limiter` as a continuous query with keyed state and timers."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gaugeline.operators.limiter import admit

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: waiting events that are gathered before they go to the state
GATHER = 500_000


class WindowLimit(StatefulProcessor):
    """Keeps events until the watermark has passed them, since earlier ones may still come and take their place.

    State of a key: waiting times with their numbers, one entry per stretch of ``width``, and the at most ``limit`` newest
    admitted times. A call touches each stretch once and holds one at a time. A timer at the earliest waiting time wakes the
    key when the watermark gets there, also if no event of it comes any more.
    """

    def __init__(self, width: int, limit: int):
        self.width, self.limit = width, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "stretch bigint", "us binary, n binary")
        self.held = handle.getListState("held", "us bigint, n bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        stretches = {k[0] for k in self.waiting.keys()}
        new, gathered = [], 0
        for frame in rows:
            new.append(frame["us"].to_numpy(dtype="int64"))
            gathered += len(frame)
            if gathered >= GATHER:
                self.keep(np.concatenate(new), stretches)
                new, gathered = [], 0
        if gathered:
            self.keep(np.concatenate(new), stretches)
        yield from self.settle(key, timerValues.getCurrentWatermarkInMs(), stretches)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self.settle(key, timerValues.getCurrentWatermarkInMs(), {k[0] for k in self.waiting.keys()})

    def keep(self, us: np.ndarray, stretches: set[int]) -> None:
        """Add events to the waiting ones; ``stretches`` are those of the state and grow with it."""
        at, n = np.unique(us, return_counts=True)
        of = at // self.width
        for start, end in pairwise([*np.flatnonzero(np.diff(of, prepend=of[0] - 1)).tolist(), len(of)]):
            stretch = int(of[start])
            times, numbers = at[start:end], n[start:end].astype(np.int64)
            if stretch in stretches:
                before, counted = self.read(stretch)
                times, where = np.unique(np.concatenate([before, times]), return_inverse=True)
                sums = np.zeros(len(times), dtype=np.int64)
                np.add.at(sums, where, np.concatenate([counted, numbers]))
                numbers = sums
            self.write(stretch, times, numbers)
            stretches.add(stretch)

    def read(self, stretch: int) -> tuple[np.ndarray, np.ndarray]:
        us, n = self.waiting.getValue((stretch,))
        return np.frombuffer(bytes(us), dtype=np.int64), np.frombuffer(bytes(n), dtype=np.int64)

    def write(self, stretch: int, us: np.ndarray, n: np.ndarray) -> None:
        self.waiting.updateValue((stretch,), (us.tobytes(), n.tobytes()))

    def settle(self, key, watermark_ms: int, stretches: set[int]) -> Iterator[pd.DataFrame]:
        """Decide on all waiting events that the watermark has passed; wake up again for the next."""
        for expiry in list(self.handle.listTimers()):
            self.handle.deleteTimer(expiry[0] if isinstance(expiry, tuple) else expiry)
        # the watermark drops what is strictly before it, so its own millisecond may still grow
        passed = watermark_ms * 1000
        held, decided = None, False
        for stretch in sorted(stretches):
            at, n = self.read(stretch)
            ready = int(np.searchsorted(at, passed))
            if ready:
                if held is None:
                    held = deque(tuple(h) for h in self.held.get())
                admitted = admit(held, at[:ready], n[:ready], self.width, self.limit)
                decided = True
                yield pd.DataFrame({"key": key[0], "at_us": at[:ready], "events": n[:ready], "admitted": admitted})
            if ready < len(at):
                self.handle.registerTimer(int(at[ready]) // 1000 + 1)
                if ready:
                    self.write(stretch, at[ready:], n[ready:])
                break
            self.waiting.removeKey((stretch,))
        if decided:
            self.held.put([(int(t), int(k)) for t, k in held]) if held else self.held.clear()

    def close(self) -> None:
        pass


def admitted_stream(stream: DataFrame, key: str, at: str = "ts", seconds: int = 300, limit: int = 5, lateness: str = "10 minutes") -> DataFrame:
    """key, at_us, events, admitted of every time that the watermark has passed; append mode, exactly once with a checkpoint.

    The query needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    times = F.col(at).cast("timestamp")
    timed = stream.select(F.col(key).alias("key"), times.alias("at"), F.unix_micros(times).alias("us")).where("us IS NOT NULL").withWatermark("at", lateness)
    kind = timed.schema["key"].dataType.simpleString()
    out = timed.groupBy("key").transformWithStateInPandas(
        WindowLimit(seconds * 1_000_000, limit), f"key {kind}, at_us bigint, events bigint, admitted bigint", outputMode="Append", timeMode="EventTime")
    return out.withColumnRenamed("key", key)


def append_to_parquet(result: DataFrame, out: str, checkpoint: str) -> None:
    """Process what is available and stop; a restart from the checkpoint goes on where the last run ended."""
    q = result.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
