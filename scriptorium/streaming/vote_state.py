"""Votes as keyed state of a stream: the last action of each user on each page, kept only while an older one may still come.

Actions are votes and cancels in any order. A key's state is its last action by time and id; each batch gives the keys whose last
action has changed. Once the watermark has passed that action every action that is still let in is newer, so a timer drops the
state: what is kept is bounded by the actions of the allowed lateness, not by all users and pages.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from scriptorium.operators.ratings import latest

#: State stores that hold keyed state of this kind.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGES = "user_id long, page_id long, vote_id long, rate int, ts timestamp, cancelled boolean"


class LastAction(StatefulProcessor):
    """The last action of a key; its state goes when the watermark passes it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "micros long, vote_id long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        best, found = None, None
        for part in rows:
            micros = part["ts"].astype("datetime64[us]").astype("int64")
            order = sorted(range(len(part)), key=lambda n: (micros.iloc[n], part["vote_id"].iloc[n]))
            top = (int(micros.iloc[order[-1]]), int(part["vote_id"].iloc[order[-1]]))
            if best is None or top > best:
                best, found = top, part.iloc[[order[-1]]]
        if best is None or self.last.exists() and tuple(self.last.get()) >= best:
            return
        self.last.update(best)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(best[0] // 1000 + 1)
        yield found.assign(user_id=key[0], page_id=key[1])[["user_id", "page_id", "vote_id", "rate", "ts", "cancelled"]]

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def last_actions(actions: DataFrame, late: str = "2 days") -> DataFrame:
    """Changes of a stream of actions (user_id, page_id, vote_id, rate, ts, cancelled): for each key that a batch has changed its last
    action. Actions later than ``late`` are left out. The session's state store has to be ``STORE``."""
    timed = actions.withColumns({"ts": F.col("ts").cast("timestamp"), "rate": F.col("rate").cast("int"), "cancelled": F.coalesce("cancelled", F.lit(False))})
    keyed = timed.withWatermark("ts", late).groupBy("user_id", "page_id")
    return keyed.transformWithStateInPandas(LastAction(), outputStructType=CHANGES, outputMode="Update", timeMode="EventTime")


def standing_votes(changes: DataFrame) -> DataFrame:
    """The votes that stand after all changes written so far: the last change of each key, unless it is a cancel."""
    return latest(changes, "user_id", "page_id").filter("not cancelled").drop("cancelled")
