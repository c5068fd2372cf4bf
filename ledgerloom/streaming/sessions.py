"""Sessions of a stream with late rows: state a user, timers that close sessions, and a side output of what came too late.

The same sessions as operators.temporal.sessions finds in a table. State and timers are in the checkpoint, so a query that stopped goes on
where it was.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that keeps timers and lists; set it before the query starts.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
SCHEMA = "kind string, user_id bigint, start bigint, end bigint, n bigint, total double, event_id bigint"


def merged(spans: list[tuple], gap: int) -> list[tuple]:
    """Spans (first, last, n, total) by time; those not further apart than the gap are one."""
    out: list[tuple] = []
    for first, last, n, total in sorted(spans):
        if out and first - out[-1][1] <= gap:
            a = out[-1]
            out[-1] = (a[0], max(a[1], last), a[2] + n, a[3] + total)
        else:
            out.append((first, last, n, total))
    return out


class Sessions(StatefulProcessor):
    """Open sessions of a user as a list, microseconds; it is as long as the lateness allows.

    A session is closed when the watermark has passed the last moment at which a row could still join it.
    Rows behind the watermark go out as late, each by itself, and change nothing.
    """

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "first bigint, last bigint, n bigint, total double")

    def _closes(self, last: int) -> int:
        return (last + self.gap) // 1000 + 1

    def _kept(self) -> list[tuple]:
        return [tuple(x) for x in self.open.get()] if self.open.exists() else []

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        watermark, spans = 1000 * timerValues.getCurrentWatermarkInMs(), self._kept()
        known = {s[1] for s in spans}
        for r in rows:
            if r.at < watermark:
                yield Row(kind="late", user_id=key[0], start=r.at, end=r.at, n=1, total=r.value, event_id=r.event_id)
            else:
                spans.append((r.at, r.at, 1, r.value or 0.0))
                if len(spans) > 10_000:  # a hot user's rows are merged as they come
                    spans = merged(spans, self.gap)
        spans = merged(spans, self.gap)
        if spans:
            self.open.put([Row(first=a, last=b, n=n, total=t) for a, b, n, t in spans])
            for s in spans:
                if s[1] not in known:
                    self.handle.registerTimer(self._closes(s[1]))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
        watermark, stay = timerValues.getCurrentWatermarkInMs(), []
        for first, last, n, total in self._kept():
            if self._closes(last) <= watermark:
                yield Row(kind="session", user_id=key[0], start=first, end=last, n=n, total=total, event_id=None)
            else:
                stay.append(Row(first=first, last=last, n=n, total=total))
        if stay:
            self.open.put(stay)
        else:
            self.open.clear()

    def close(self) -> None:
        pass


def session_stream(events: DataFrame, gap_micros: int, late: str = "1 day") -> DataFrame:
    """Rows of a stream of events (event_id, ts, user_id, value): kind "session", closed ones, and kind "late", single rows.

    Events without a user or a time are in neither. Late is what lies more than `late` behind the newest event of the batches before.
    The watermark's own filter would drop such rows unseen, so the state works on a copy of the time that does not carry it.
    """
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).where("user_id IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", late)
    rows = timed.select("user_id", F.unix_micros("ts").alias("at"), F.col("value").cast("double").alias("value"), "event_id")
    out = rows.groupBy("user_id").transformWithState(Sessions(gap_micros), SCHEMA, "Append", "EventTime")
    return out.withColumns({c: F.timestamp_micros(c) for c in ("start", "end")})
