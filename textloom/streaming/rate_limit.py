"""Sliding-log rate limiting per key, over a table and over a stream.

A hit is allowed when fewer than ``hits`` allowed ones lie within the window before it; refused hits are not logged, so a
plain range count over all hits would refuse too many.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..options import RateLimit


def exempt(path: Column, limit: RateLimit = RateLimit()) -> Column:
    return path.isin(*limit.exempt_paths)


class SlidingLog:
    """The times of the allowed hits within the window, at most as many as are allowed."""

    def __init__(self, limit: RateLimit, log: list[int] | tuple[int, ...] = ()) -> None:
        self.span, self.hits, self.log = limit.seconds * 1_000_000, limit.hits, deque(log)

    def allows(self, now: int) -> bool:
        while self.log and now - self.log[0] > self.span:
            self.log.popleft()
        if len(self.log) >= self.hits:
            return False
        self.log.append(now)
        return True


def limited(events: DataFrame, key: str, ts: str, limit: RateLimit = RateLimit()) -> DataFrame:
    """key, micros, allowed for every event.

    One exchange on the key; its hits pass a task in their order, and all that is kept of them is the log. Whether a hit is
    allowed depends on all earlier ones of its key, so one key's hits are not dealt out further, but they are never held.
    """
    rows = events.select(F.col(key).alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("micros"))
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, log = None, SlidingLog(limit)
        for batch in batches:
            allowed = []
            for own, now in zip(batch.column("key").to_pylist(), batch.column("micros").to_pylist()):
                if own != last:
                    last, log = own, SlidingLog(limit)
                allowed.append(log.allows(now))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(allowed, pa.bool_())], names=["key", "micros", "allowed"])

    return rows.repartition("key").sortWithinPartitions("key", "micros").mapInArrow(run, f"key {kind}, micros long, allowed boolean")


def limited_stream(events: DataFrame, key: str, ts: str, limit: RateLimit = RateLimit()) -> DataFrame:
    """The same over a stream: (key, micros, allowed); hits of a micro-batch are taken in the order of their times.

    The state of a key is its log, at most ``hits`` times; it is dropped when no hit comes for a window of processing time.
    """
    rows = events.select(F.col(key).cast("string").alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("micros"))

    def fold(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        log = SlidingLog(limit, state.get[0] if state.exists else ())
        times = sorted(int(t) for part in parts for t in part["micros"])
        allowed = [log.allows(now) for now in times]
        state.update((list(log.log),))
        state.setTimeoutDuration(limit.seconds * 1000)
        yield pd.DataFrame({"key": [k[0]] * len(times), "micros": times, "allowed": allowed})

    return rows.groupBy("key").applyInPandasWithState(fold, "key string, micros long, allowed boolean", "log array<long>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def request_metrics(requests: DataFrame, buckets: tuple[float, ...]) -> DataFrame:
    """Requests and durations (seconds) by method, path and status, with cumulative duration buckets."""
    counted = [F.count_if(F.col("seconds") <= b).alias(f"le_{b:g}".replace(".", "_")) for b in buckets]
    return requests.groupBy("method", "path", "status").agg(F.count("*").alias("n"), F.sum("seconds").alias("seconds"), *counted)
