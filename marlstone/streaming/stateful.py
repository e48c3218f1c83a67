"""Operators on streams that keep a state for each key, on event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: List state and timers are kept by this provider only.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
_OUT = "event_id bigint, user_id bigint, seconds bigint"


class SinceLast(StatefulProcessor):
    """Holds a user's rows until the watermark has passed them, and then gives them in order of time.

    State of a user: the rows still to come, the time of the last cause, and the time of its last row. A timer stands at the
    first waiting row. A user of whom nothing has come for ``forget`` milliseconds of event time loses the last cause too.
    """

    def __init__(self, cause: str, effect: str, forget: int):
        self.cause, self.effect, self.forget = cause, effect, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ms bigint, event_id bigint, event_type string")
        self.last = handle.getValueState("last", "ms bigint")
        self.seen = handle.getValueState("seen", "ms bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        mark, new = timerValues.getCurrentWatermarkInMs(), []
        for frame in rows:
            known = frame[frame["ms"] > mark]  # what is not after the watermark is late
            new += zip(known["ms"].tolist(), known["event_id"].tolist(), known["event_type"].tolist(), strict=True)
        if new:
            self.waiting.appendList(new)
            newest = max(r[0] for r in new)
            self.seen.update((max(newest, self.seen.get()[0]) if self.seen.exists() else newest,))
            self.handle.registerTimer(min(r[0] for r in new))
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        mark, out = timerValues.getCurrentWatermarkInMs(), []
        held = sorted(self.waiting.get()) if self.waiting.exists() else []
        ripe, rest = [r for r in held if r[0] <= mark], [r for r in held if r[0] > mark]
        last = self.last.get()[0] if self.last.exists() else None
        for ms, event_id, kind in ripe:
            if last is not None and ms - last > self.forget:
                last = None
            if kind == self.effect:
                out.append((event_id, key[0], None if last is None else ms // 1000 - last // 1000))
            if kind == self.cause:
                last = ms
        if ripe:
            if rest:
                self.waiting.put(rest)
                self.handle.registerTimer(rest[0][0])
            else:
                self.waiting.clear()
                if last is not None:
                    self.handle.registerTimer(self.seen.get()[0] + self.forget + 1)
            if last is not None:
                self.last.update((last,))
        elif not rest and self.seen.exists() and self.seen.get()[0] + self.forget < mark:
            self.last.clear()
            self.seen.clear()
        if out:
            found = pd.DataFrame(out, columns=["event_id", "user_id", "seconds"])
            yield found.astype({"event_id": "int64", "user_id": "int64", "seconds": "Int64"})

    def close(self) -> None:
        pass


def since_last(events: DataFrame, cause: str, effect: str, late: str = "1 hour", forget_days: int = 3650) -> DataFrame:
    """(event_id, user_id, seconds): of each ``effect``, the seconds since its user's last ``cause``; null where there was none.

    Works on a stream of events with ts, event_id, user_id and event_type, in
    any order: rows wait until the watermark, ``late`` behind the latest time,
    has passed them, and are then taken by time and event_id, so the answer
    is the table's. Rows that come later than that are dropped; those that the
    watermark has not passed are still waiting. A cause more than
    ``forget_days`` old counts no more, and a user of whom nothing has come for
    so long is forgotten. Events without a user or a time are left out. Sets
    the session's provider of states to that which has timers.
    """
    events.sparkSession.conf.set(*PROVIDER)
    known = events.where(F.col("event_type").isin(cause, effect) & F.col("user_id").isNotNull() & F.col("ts").isNotNull())
    rows = known.select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    rows = rows.withColumn("ms", F.unix_millis("ts"))
    forget = forget_days * 86_400_000
    return rows.groupBy("user_id").transformWithStateInPandas(SinceLast(cause, effect, forget), _OUT, "append", "EventTime")
