"""Stateful streams: alerts that hold for a time, and the last messages of each user. Each has a batch twin that gives the same rows.

State is bounded: an alert keeps one run for each series, a history the last n messages and those that the watermark
hasn't passed yet. Timers of event time end runs that fall silent and release messages in the order of their turns.
Processors of this kind need the RocksDB state store, which rocksdb() sets for a session while it is open.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .metrics import LATE

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
CHANGES = "series string, state string, changed_at timestamp"


@contextmanager
def rocksdb(spark: SparkSession):
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def alert_changes(alerts: DataFrame, width_seconds: int, hold: int) -> DataFrame:
    """alerts(series, start, alert) as changes (series, state, changed_at): "firing" when windows in a row have been in alert for hold of them, "resolved" at the end of such a run. A window without events ends a run."""
    at = F.floor(F.unix_seconds("start") / width_seconds)
    bad = alerts.where("alert").select("series", at.alias("at"), F.to_date("start").alias("day"))
    # Runs within a day first, so that no task orders all windows of a series; then the runs are joined.
    own = Window.partitionBy("series", "day").orderBy("at")
    runs = bad.withColumn("g", F.col("at") - F.row_number().over(own)).groupBy("series", "day", "g").agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    w = Window.partitionBy("series").orderBy("lo")
    first = F.coalesce((F.col("lo") != F.lag("hi").over(w) + 1).cast("int"), F.lit(1))
    whole = runs.withColumn("first", first).withColumn("i", F.sum("first").over(w)).groupBy("series", "i").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    whole = whole.where(F.col("hi") - F.col("lo") + 1 >= hold)
    change = F.explode(F.array(F.struct(F.lit("firing").alias("state"), (F.col("lo") + hold).alias("k")), F.struct(F.lit("resolved").alias("state"), (F.col("hi") + 1).alias("k"))))
    return whole.select("series", change.alias("c")).select("series", "c.state", F.timestamp_seconds(F.col("c.k") * width_seconds).alias("changed_at"))


class AlertHold(StatefulProcessor):
    """A series' run of windows in alert: since when, until when, and whether it fires."""

    def __init__(self, width_ms: int, hold: int):
        self.width, self.hold = width_ms, hold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.run = handle, handle.getValueState("run", "since long, until long, firing boolean")

    def _forget(self, key, until: int, firing: bool) -> list:
        self.handle.deleteTimer(until + self.width + 1)
        self.run.clear()
        return [(key[0], "resolved", until)] if firing else []

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf, out = pd.concat(list(rows)).sort_values("at"), []
        run = self.run.get() if self.run.exists() else None
        for at, alert in zip(pdf["at"].tolist(), pdf["alert"].tolist(), strict=True):
            if run is not None and (not alert or at != run[1]):
                out += self._forget(key, run[1], run[2])
                run = None
            if not alert:
                continue
            since, firing = (at, False) if run is None else (run[0], run[2])
            if run is not None:
                self.handle.deleteTimer(run[1] + self.width + 1)
            until = at + self.width
            if not firing and until - since >= self.hold * self.width:
                out.append((key[0], "firing", since + self.hold * self.width))
                firing = True
            run = (since, until, firing)
            self.run.update(run)
            # By then the next window would have come, if it had any event.
            self.handle.registerTimer(until + self.width + 1)
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.run.exists():
            _, until, firing = self.run.get()
            if until + self.width < expiredTimerInfo.getExpiryTimeInMs():
                self.run.clear()
                out = [(key[0], "resolved", until)] if firing else []
        yield self._frame(out)

    @staticmethod
    def _frame(rows: list) -> pd.DataFrame:
        own = pd.DataFrame(rows, columns=["series", "state", "changed_at"])
        own["changed_at"] = pd.to_datetime(own["changed_at"].astype("int64"), unit="ms")
        return own

    def close(self) -> None:
        pass


def alert_stream(alerts: DataFrame, width_seconds: int, hold: int) -> DataFrame:
    """alert_changes of a stream of windows in append mode (series, window, alert)."""
    own = alerts.select(F.col("series").cast("string").alias("series"), F.unix_millis(F.col("window.start")).alias("at"), "alert", F.col("window"))
    return own.groupBy("series").transformWithStateInPandas(AlertHold(width_seconds * 1000, hold), CHANGES, "Append", "EventTime")


class History(StatefulProcessor):
    """A user's last messages by turn, and those that wait for the watermark."""

    def __init__(self, n: int):
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, turn long, content string")
        self.last = handle.getListState("last", "turn long, content string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows))
        new = [(int(a), int(t), c) for a, t, c in zip(pdf["at"].tolist(), pdf["turn"].tolist(), pdf["content"].tolist(), strict=True)]
        self.waiting.appendList(new)
        # A timer must lie ahead of the watermark, or it would never come.
        ahead = timerValues.getCurrentWatermarkInMs() + 1
        # One for the earliest is enough: when it comes, it sets the next.
        self.handle.registerTimer(max(min(x[0] for x in new), ahead))
        yield self._frame([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # All that the watermark has passed, in one go.
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        rows = [tuple(x) for x in self.waiting.get()] if self.waiting.exists() else []
        due = sorted((x for x in rows if x[0] <= now), key=lambda x: (x[1], x[0]))
        left = [x for x in rows if x[0] > now]
        if left and due:
            self.waiting.put(left)
            self.handle.registerTimer(min(x[0] for x in left))
        elif not left:
            self.waiting.clear()
        last, out = [tuple(x) for x in self.last.get()] if self.last.exists() else [], []
        for _, turn, content in due:
            last = sorted([*last, (turn, content)], key=lambda x: x[0])
            at = max(i for i, x in enumerate(last) if x[0] == turn)
            out.append((key[0], turn, [c for _, c in last[max(0, at + 1 - self.n) : at + 1] if c is not None]))
            last = last[-self.n :]
        if due:
            self.last.put(last)
        yield self._frame(out)

    @staticmethod
    def _frame(rows: list) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["user_id", "turn", "history"]).astype({"user_id": "int64", "turn": "int64"})

    def close(self) -> None:
        pass


def history_stream(messages: DataFrame, n: int, late: str = LATE) -> DataFrame:
    """rolling_history of a stream (user_id, ts, turn, content) whose messages may come in any order within the delay; later ones and those without user, time or turn are dropped. Times ascend with turns and lie after 1970, where a stream's watermark begins."""
    own = messages.withWatermark("ts", late).where("user_id is not null and ts is not null and turn is not null")
    own = own.select("user_id", "ts", F.unix_millis("ts").alias("at"), "turn", "content")
    return own.groupBy("user_id").transformWithStateInPandas(History(n), "user_id long, turn long, history array<string>", "Append", "EventTime")
