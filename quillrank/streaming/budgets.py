"""Requests allowed or refused per key: a least interval between allowed ones, and so many per window.

A key's state is three numbers: the moment of its last allowed request, the window it
fell in, and how many that window has allowed. A timer at the end of the window and the
interval drops the state, so keys that ask no more cost nothing. Requests of a
micro-batch are taken in order of time, then id; one that comes later than the watermark
is dropped by Spark, as is one without a time. A request before the last allowed one (of
an earlier batch, but within the watermark) is refused by the interval.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class Budget(StatefulProcessor):
    def __init__(self, key: str, interval_us: int, window_us: int, most: int):
        self.key, self.interval, self.window, self.most = key, interval_us, window_us, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("budget", "last long, window long, used int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        asked = pd.concat(list(rows)).sort_values(["at", "id"])
        last, window, used = self.state.get() if self.state.exists() else (None, None, 0)
        out = []
        for i, at in zip(asked["id"].tolist(), asked["at"].tolist(), strict=True):
            mine = at // self.window
            spent = used if mine == window else 0
            why = "interval" if last is not None and at - last < self.interval else "budget" if spent >= self.most else ""
            if not why:
                last, window, used = at, mine, spent + 1
            out.append((key[0], i, not why, why))
        if last is not None:
            self.state.update((last, window, used))
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(max((window + 1) * self.window, last + self.interval) // 1000 + 1)
        yield pd.DataFrame(out, columns=[self.key, "id", "allowed", "reason"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield pd.DataFrame({self.key: pd.Series([], dtype="int64"), "id": pd.Series([], dtype="int64"), "allowed": pd.Series([], dtype=bool), "reason": pd.Series([], dtype=str)})

    def close(self) -> None:
        pass


def with_rocks(spark: SparkSession, run):
    """``run()`` with the state store that such state needs, the session's own set again afterwards."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        return run()
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def budgets(requests: DataFrame, key: str, interval: float, window: float, most: int, lateness: str = "1 hour") -> DataFrame:
    """(key, id, allowed, reason) of a stream of requests: key (long), id, ts; interval and window in seconds."""
    rows = requests.where("ts is not null").select(F.col(key).cast("long").alias(key), F.col("id").cast("long").alias("id"), "ts", F.unix_micros("ts").alias("at"))
    grouped = rows.withWatermark("ts", lateness).groupBy(key)
    return grouped.transformWithStateInPandas(Budget(key, int(interval * 1e6), int(window * 1e6), most), f"{key} long, id long, allowed boolean, reason string", "Append", "EventTime")
