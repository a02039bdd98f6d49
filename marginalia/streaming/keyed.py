"""Intervals as keyed stream state: a row per open interval, gone when the watermark has passed its end."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class OpenIntervals(StatefulProcessor):
    """Per key: the end of its open interval and the latest row it has shown. A timer at the end clears both, so a key
    whose interval is over has no state. Times are microseconds, timers milliseconds, rounded up."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "until bigint, seen bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        until = seen = before = None
        if self.open.exists():
            until, seen = self.open.get()
            before = until
        for r in sorted(rows, key=lambda r: (r["at"], r["id"])):
            if seen is not None and r["at"] < seen:
                yield Row(key=key[0], id=r["id"], held=None, until=None, late=True)
                continue
            seen = r["at"]
            held = until is not None and seen < until
            starts = not held and r["length"] is not None
            if starts:
                until = seen + r["length"]
            yield Row(key=key[0], id=r["id"], held=held, until=until if starts else None, late=False)
        if until is None:
            return
        self.open.update((until, seen))
        if until != before:
            if before is not None:
                self.handle.deleteTimer(-(-before // 1000))
            self.handle.registerTimer(-(-until // 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.open.exists() and -(-self.open.get()[0] // 1000) <= expiredTimerInfo.getExpiryTimeInMs():
            self.open.clear()
        return iter(())

    def close(self) -> None:
        pass


def keyed_intervals(rows: DataFrame, late: str) -> DataFrame:
    """The interval chain over a stream of key, at (microseconds), id, length and ts: key, id, held, until, late.

    A row older than what its key has shown while the interval is open is marked ``late`` and starts nothing; one older than the
    watermark (``late`` behind the newest row) is left out. A step sorts the rows it has of one key, so steps are to be
    kept small by their source's limit of files; a log too busy for that goes through the batch form."""
    grouped = rows.withWatermark("ts", late).groupBy("key")
    return grouped.transformWithState(
        OpenIntervals(), "key string, id bigint, held boolean, until bigint, late boolean", "append", "eventTime"
    )


def with_keyed_state(spark: SparkSession, run) -> None:
    """Run a stream whose state needs the store that has timers and columns of its own; other streams keep theirs."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        run()
    finally:
        if before is None:
            spark.conf.unset(STORE)
        else:
            spark.conf.set(STORE, before)
