"""A keyed cache as the state of a stream: an entry lives for a time to live after its last write, measured in event time.

Each key holds its value and one timer. A write replaces the value and moves the timer; when the watermark passes it, the
entry is evicted. The state is kept by Spark's state store, so a query that is started again from its checkpoint goes on
with the entries and timers that it had. Session setting: the RocksDB state store provider."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "url string, event string, value string, at timestamp"


class _Entry(StatefulProcessor):
    def __init__(self, seconds: int):
        self.life = seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "value string, written long, until long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        seen = pd.concat(list(rows)).sort_values(["ts", "value"])
        old = self.entry.get() if self.entry.exists() else None
        newest, at = seen["value"].iloc[-1], int(seen["ts"].iloc[-1].timestamp() * 1000)
        if old is not None and old[1] > at:
            return iter([])  # a late write does not undo a newer one
        if old is not None:
            self.handle.deleteTimer(old[2])
        self.entry.update((newest, at, at + self.life))
        self.handle.registerTimer(at + self.life)
        return iter([pd.DataFrame({"url": [key[0]], "event": ["put" if old is None else "replaced"], "value": [newest], "at": [pd.Timestamp(at, unit="ms")]})])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        value, _, until = self.entry.get()
        self.entry.clear()
        return iter([pd.DataFrame({"url": [key[0]], "event": ["evicted"], "value": [value], "at": [pd.Timestamp(until, unit="ms")]})])

    def close(self) -> None:
        pass


def ttl_cache(writes: DataFrame, days: float = 7, late: str = "1 hour") -> DataFrame:
    """writes (url, value, ts) -> url, event (put, replaced, evicted), value, at."""
    w = writes.withWatermark("ts", late)
    return w.groupBy("url").transformWithStateInPandas(_Entry(int(days * 86_400)), OUT, "append", "EventTime")
