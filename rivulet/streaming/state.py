"""Keyed state with timers: triggers that cool down, snapshots at a cadence."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import UTC

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: Seconds between the starts of two runs of one key, and what a caller is told to wait while another run is on; fixed values.
COOLDOWN_S, BUSY_RETRY_S = 120, 60
DECISIONS = "key string, ts timestamp, decision string, retry_after_s long"
SNAPSHOTS = "run string, t double, value double"


@contextmanager
def state_store(spark: SparkSession):
    """The state store that timers and typed state need, for the queries that start inside."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def _ms(x) -> int:
    return round(x.replace(tzinfo=UTC).timestamp() * 1000)


class Cooldown(StatefulProcessor):
    """State of a key: when its last run started and when it ends, in milliseconds. A timer drops the state when neither matters any more."""

    def __init__(self, seconds: int):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "started long, ends long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        started, ends = self.last.get() if self.last.exists() else (None, None)
        out = []
        for ts, run_s in pd.concat(rows).sort_values(["ts", "run_s"])[["ts", "run_s"]].itertuples(index=False):
            now = _ms(ts)
            if started is not None and now < ends:
                out.append((key[0], ts, "single_flight", BUSY_RETRY_S))
            elif started is not None and now - started < 1000 * self.seconds:
                out.append((key[0], ts, "cooldown", (1000 * self.seconds - (now - started)) // 1000 + 1))
            else:
                started, ends = now, now + round(1000 * run_s)
                out.append((key[0], ts, "accepted", 0))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.last.update((started, ends))
        self.handle.registerTimer(max(started + 1000 * self.seconds, ends))
        yield pd.DataFrame(out, columns=["key", "ts", "decision", "retry_after_s"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter(())


def triggers(requests: DataFrame, seconds: int = COOLDOWN_S, late: str = "1 minute") -> DataFrame:
    """Requests (key, ts, run_s) -> a decision for each: one run of a key at a time, and starts at least ``seconds`` apart.

    Requests of a key count in the order of time within a micro-batch; rows later
    than the watermark are dropped by the engine.
    """
    rows = requests.selectExpr("CAST(key AS STRING) AS key", "ts", "CAST(run_s AS DOUBLE) AS run_s").withWatermark("ts", late)
    return rows.groupBy("key").transformWithStateInPandas(Cooldown(seconds), DECISIONS, "Append", "EventTime")


class Cadence(StatefulProcessor):
    """State of a run: the time from which the next snapshot is due."""

    def __init__(self, every: float):
        self.every = every

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.due = handle.getValueState("due", "t double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        due = self.due.get()[0] if self.due.exists() else self.every
        out = []
        for t, value in pd.concat(rows).sort_values(["t", "value"])[["t", "value"]].itertuples(index=False):
            if t >= due:
                out.append((key[0], t, value))
                due += self.every
        self.due.update((due,))
        yield pd.DataFrame(out, columns=["run", "t", "value"]).astype({"t": float, "value": float})


def snapshots(steps: DataFrame, every: float) -> DataFrame:
    """Steps (run, t, value) -> the first step at or after each due time; one step meets one due time, as a step can't be shown twice."""
    rows = steps.selectExpr("CAST(run AS STRING) AS run", "CAST(t AS DOUBLE) AS t", "CAST(value AS DOUBLE) AS value")
    return rows.groupBy("run").transformWithStateInPandas(Cadence(every), SNAPSHOTS, "Append", "None")
