"""Issuing as a stream: every hour each series' newest bar that is at most six hours old is called.

Bars wait in a map state until the watermark has passed them; a timer for every hour from a bar's
close to six hours after it makes the run of that hour. A bar that comes behind the watermark is
left out: the runs that it would have served have been made without it, and a bucket in whose first
15 minutes no run had a fresh bar stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.functions.scalar import HOUR_MS
from tidemark.operators import ledger as L

#: What the rule signals read of a bar.
SNAPSHOT = "row_idx long, close double, sma24 double, sma72 double, regime string, source string"
FIELDS = [f.split()[0] for f in SNAPSHOT.split(", ")]


class HourlyRuns(StatefulProcessor):
    """State per series: bars ahead of the watermark, and the newest bar behind it."""

    def __init__(self, fresh_hours: int):
        self.fresh_hours = fresh_hours

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ahead = handle.getMapState("ahead", "close_ms long", SNAPSHOT)
        self.newest = handle.getValueState("newest", f"close_ms long, {SNAPSHOT}")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        for batch in rows:
            for values in batch[["close_ms", *FIELDS]].itertuples(index=False, name=None):
                at, *snapshot = (None if pd.isna(v) else v for v in values)
                if at > passed:
                    self.ahead.updateValue((at,), tuple(snapshot))
                    for hour in range(self.fresh_hours + 1):
                        self.handle.registerTimer(at + hour * HOUR_MS)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        if self.ahead.containsKey((at,)):
            self.newest.update((at, *self.ahead.getValue((at,))))
            self.ahead.removeKey((at,))
        if self.newest.exists():
            close_ms, *snapshot = self.newest.get()
            # A newer bar has runs of its own; where its close is not on this bar's hours, they differ.
            if (at - close_ms) % HOUR_MS == 0 and at - close_ms <= self.fresh_hours * HOUR_MS:
                yield pd.DataFrame([(*key, at, close_ms, *snapshot)], columns=["series_id", "run_ms", "close_time_ms", *FIELDS])

    def close(self) -> None:
        pass


def stream_runs(bars: DataFrame, delay: str, fresh_hours: int = L.STALENESS_HOURS) -> DataFrame:
    """Runs of a stream of bars (series_id, close_time, ``SNAPSHOT``). Needs the RocksDB state store."""
    rows = bars.withColumn("close_ms", F.unix_millis("close_time")).withWatermark("close_time", delay)
    return rows.groupBy("series_id").transformWithStateInPandas(HourlyRuns(fresh_hours), f"series_id string, run_ms long, close_time_ms long, {SNAPSHOT}", "Append", "EventTime")


def stream_issue(bars: DataFrame, delay: str, models=L.SIGNALS) -> DataFrame:
    """Calls of the runs that open a bucket; abstentions and late runs are left out."""
    return L.attempts_of(stream_runs(bars, delay), models).filter(F.col("skipped").isNull())
