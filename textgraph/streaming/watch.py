"""A watcher as a stream: file events settle path by path, and what has settled goes into the catalog in batches."""

from __future__ import annotations

import bisect
import datetime
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SETTLED = "path string, change string, content string, at timestamp"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Debounce(StatefulProcessor):
    """Of each path the content that it settles at: that of an event which none follows within the delay.

    State: the path's events whose delay isn't over, and the digest of what was given out last, none while the path isn't
    there. A path has one timer, for its earliest event. When it fires, all events whose delay the watermark has passed are
    decided at once, so nothing that matters can still come, a path's state is read once however many they are, and what
    is given out doesn't depend on how events fall into batches or in which order they come. Contents that are what was
    given out last, and deletions of what never was, are nothing.
    """

    def __init__(self, delay_ms: int):
        self.delay_ms = delay_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # times in microseconds
        self.pending = handle.getListState("pending", "at long, content string")
        self.sent = handle.getValueState("sent", "digest string")

    def _due(self, events: list[tuple[int, str | None]]) -> int:
        return min(at for at, _ in events) // 1000 + self.delay_ms

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = []
        for pdf in rows:
            own = pdf[pdf["at"].notna()]
            new += [(at, content if isinstance(content, str) else None) for at, content in zip(_micros(own["at"]), own["content"], strict=True)]
        if new:
            old = list(self.pending.get())
            due = self._due(new)
            if not old or due < self._due(old):
                if old:
                    self.handle.deleteTimer(self._due(old))
                self.handle.registerTimer(due)
            self.pending.appendList(new)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        over = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()) - self.delay_ms
        # of one millisecond the latest counts, then what is there before what isn't
        known = sorted(self.pending.get(), key=lambda e: (e[0], e[1] is not None, e[1] or ""))
        times = [at // 1000 for at, _ in known]
        n = bisect.bisect_right(times, over)
        if n < len(known):
            self.pending.put(known[n:])
            self.handle.registerTimer(times[n] + self.delay_ms)
        else:
            self.pending.clear()
        before = last = self.sent.get()[0] if self.sent.exists() else None
        out = []
        for k in range(n):
            if k + 1 < len(times) and times[k + 1] <= times[k] + self.delay_ms:
                continue
            at, content = known[k]
            digest = None if content is None else hashlib.sha256(content.encode()).hexdigest()
            if digest != last:
                out.append((key[0], "deleted" if digest is None else "added" if last is None else "modified", content, at))
            last = digest
        if last is None:
            self.sent.clear()
        elif last != before:
            self.sent.update((last,))
        if out:
            made = pd.DataFrame(out, columns=["path", "change", "content", "at"])
            made["at"] = pd.to_datetime(made["at"], unit="us")
            yield made

    def close(self) -> None:
        pass


def _micros(at: pd.Series) -> list[int]:
    own = at.dt.tz_convert("UTC").dt.tz_localize(None) if at.dt.tz is not None else at
    return own.astype("datetime64[us]").astype("int64").tolist()


def settled(events: DataFrame, delay: datetime.timedelta = datetime.timedelta(milliseconds=500), late: str = "10 seconds") -> DataFrame:
    """(path, change, content, at) of a stream of (path, at, content), content null for a deletion: what each path is whenever no event follows for `delay`.

    Events may come in any order within `late`; those without a time are nothing. Needs the RocksDB state store (`with_state_store`), which holds
    a digest for each path and the events of its last delay. Sessions keep their times in UTC.
    """
    own = events.select("path", "at", "content").withWatermark("at", late)
    return own.groupBy("path").transformWithStateInPandas(statefulProcessor=Debounce(int(delay.total_seconds() * 1000)), outputStructType=SETTLED, outputMode="Append", timeMode="EventTime")


def with_state_store(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return spark


def settled_batch(events: DataFrame) -> DataFrame:
    """(path, content) that a whole table of events ends with, deleted paths left out: what a stream over them comes to."""
    order = F.struct("at", F.col("content").isNotNull(), F.coalesce("content", F.lit("")))
    return events.filter("at is not null").groupBy("path").agg(F.max_by("content", order).alias("content")).filter("content is not null")
