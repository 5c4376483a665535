"""Which events a sliding-window limit lets through, when events that it turns away do not count.

An event is admitted while fewer than ``limit`` admitted events of its key lie within the last ``seconds`` up to it. What is
admitted therefore depends on what was admitted before, and no window function expresses it. The state a key carries is
small, its at most ``limit`` newest admitted times, so the log is cut into time blocks of a key that are simulated side by
side: first from an empty window, then again only where the block before ended otherwise than assumed, until nothing changes.
Blocks forget their start where a window empties or both runs admit the same events, so most settle in the first rounds; a
key under constant pressure settles block by block, in at most ``MOST_BLOCKS`` rounds. A task streams one block and holds
one batch and one window, however many events the key has.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from gaugeline.session import cut_lineage

#: different times of a key in one block, on average
BLOCK = 250_000
MOST_BLOCKS = 64
HELD = "array<struct<us:bigint,n:bigint>>"


def admit(held: deque, at: np.ndarray, n: np.ndarray, width: int, limit: int) -> np.ndarray:
    """How many of the ``n`` events at each of the sorted times are admitted; ``held`` (time, number) is the window before and after."""
    out = np.zeros(len(at), dtype=np.int64)
    used, i = sum(k for _, k in held), 0
    while i < len(at):
        while held and held[0][0] < at[i] - width:
            used -= held.popleft()[1]
        if used >= limit:
            # nothing is admitted before the oldest has left
            i = int(np.searchsorted(at, held[0][0] + width, side="right"))
            continue
        out[i] = min(int(n[i]), limit - used)
        held.append((int(at[i]), int(out[i])))
        used += int(out[i])
        i += 1
    return out


def _simulated(points: DataFrame, windows: DataFrame, width: int, limit: int, rows: bool) -> DataFrame:
    """Simulate the blocks of ``points`` (key, block, us, n), each from its window in ``windows`` (key, block, held) or an empty one.

    Returns key, us, n, admitted if ``rows``, else the windows at the blocks' ends.
    """
    key_type = points.schema["key"].dataType.simpleString()

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, held = None, deque()

        def ended():
            return pd.DataFrame({"key": [current[0]], "block": [current[1]], "held": [[{"us": t, "n": k} for t, k in held]]})

        for frame in frames:
            codes = pd.factorize(frame["key"], use_na_sentinel=False)[0]
            block = frame["block"].to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], (np.diff(codes) != 0) | (np.diff(block) != 0)]))
            for start, end in zip(cuts, [*cuts[1:], len(frame)]):
                part = frame.iloc[start:end]
                name = (None if pd.isna(part["key"].iloc[0]) else part["key"].iloc[0], int(block[start]))
                if name != current:
                    if current is not None and not rows:
                        yield ended()
                    current, held = name, deque()
                if part["us"].isna().iloc[0]:
                    held.extend((int(h["us"]), int(h["n"])) for h in part["held"].iloc[0])
                    part = part.iloc[1:]
                at, n = part["us"].to_numpy(dtype="int64"), part["n"].to_numpy(dtype="int64")
                admitted = admit(held, at, n, width, limit)
                if rows:
                    yield pd.DataFrame({"key": part["key"], "us": at, "n": n, "admitted": admitted})
        if current is not None and not rows:
            yield ended()

    none = F.lit(None).cast("bigint")
    starts = windows.select("key", "block", none.alias("us"), none.alias("n"), "held")
    both = points.select("key", "block", "us", "n", F.lit(None).cast(HELD).alias("held")).unionByName(starts)
    # a block's window is its first row: nulls sort before all times
    return both.repartition("key", "block").sortWithinPartitions("key", "block", F.col("us").asc_nulls_first()).mapInPandas(
        run, f"key {key_type}, us bigint, n bigint, admitted bigint" if rows else f"key {key_type}, block bigint, held {HELD}")


def admitted_events(events: DataFrame, key: str, at: str, seconds: int = 300, limit: int = 5, block: int = BLOCK) -> DataFrame:
    """key, at_us, events, admitted: per key and time, how many events there are and how many are let through.

    Events of one key at the same time come one after the other; an event exactly ``seconds`` old still counts. Rows
    without a time are left out, a null key is a key of its own, and ``limit`` is at least 1.
    """
    if limit < 1:
        raise ValueError("limit must be at least 1")
    width = seconds * 1_000_000
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    points = events.select(F.col(key).alias("key"), micros.alias("us")).where("us IS NOT NULL").groupBy("key", "us").agg(F.count(F.lit(1)).alias("n"))
    points = cut_lineage(points)
    spans = points.groupBy("key").agg(F.min("us").alias("first"), F.max("us").alias("last"), F.ceil(F.count(F.lit(1)) / block).alias("blocks"))
    # no block is shorter than the window, so that a window never reaches back over a whole block
    span = F.greatest(F.lit(width + 1), F.ceil((F.col("last") - F.col("first") + 1) / F.least("blocks", F.lit(MOST_BLOCKS))))
    spans = spans.select(F.col("key").alias("k"), "first", span.cast("bigint").alias("span"))
    points = cut_lineage(points.join(spans, F.col("key").eqNullSafe(F.col("k"))).select(
        "key", F.expr("(us - first) div span").alias("block"), "us", "n", F.expr("first + ((us - first) div span) * span").alias("start")))

    starts = points.groupBy("key", "block").agg(F.first("start").alias("start"))
    followed = cut_lineage(starts.withColumn("chain", F.count(F.lit(1)).over(W.partitionBy("key"))).where("chain > 1").drop("chain"))
    empty = F.array().cast(HELD)
    used = followed.select("key", "block", empty.alias("held"))
    if not used.isEmpty():
        ends = cut_lineage(_simulated(_of(points, followed), used.limit(0), width, limit, rows=False))
        before = W.partitionBy("key").orderBy("block")
        for _ in range(MOST_BLOCKS):
            handed = followed.join(ends, _same(followed, ends)).select(followed["key"], followed["block"], "start", "held")
            handed = handed.withColumn("held", F.coalesce(F.lag("held").over(before), empty)).select(
                "key", "block", F.filter("held", lambda h: h["us"] >= F.col("start") - width).alias("held"))
            handed = cut_lineage(handed)
            changed = cut_lineage(_changed(handed, used))
            used = handed
            if changed.isEmpty():
                break
            again = _simulated(_of(points, changed), changed, width, limit, rows=False)
            ends = cut_lineage(ends.join(changed, _same(ends, changed), "left_anti").unionByName(again))
    out = _simulated(points, used, width, limit, rows=True)
    return out.select(F.col("key").alias(key), F.col("us").alias("at_us"), F.col("n").alias("events"), "admitted")


def _same(a: DataFrame, b: DataFrame):
    return a["key"].eqNullSafe(b["key"]) & (a["block"] == b["block"])


def _of(points: DataFrame, blocks: DataFrame) -> DataFrame:
    return points.join(blocks, _same(points, blocks), "left_semi")


def _changed(handed: DataFrame, used: DataFrame) -> DataFrame:
    """The blocks whose window differs from the one they were last simulated with."""
    same = _same(handed, used) & (handed["held"] == used["held"])
    return handed.join(used, same, "left_anti")
