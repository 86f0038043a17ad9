"""Streams that keep state: the summaries of the last days, and volumes that are final once they are written."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from newsdesk.operators.summaries import FIELDS
from newsdesk.streaming.ingest import sliding_volume

_VALUE = ", ".join(f"{c} string" for c in FIELDS) + ", cached_ms long"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Summaries(StatefulProcessor):
    """The newest summary of each slug, and a timer that drops it `hours` after it was made, by event time.

    A change is a row: (slug, summary fields, cached_ms, kept), where `kept` is false for a summary that expired.
    """

    def __init__(self, hours: int):
        self.ms = hours * 3_600_000 + 1  # a summary of just that age stays

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("summary", _VALUE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        old = tuple(self.newest.get()) if self.newest.exists() else None
        best = old
        for frame in rows:
            for row in frame[[*FIELDS, "cached_ms"]].itertuples(index=False, name=None):
                row = (*row[:-1], int(row[-1]))
                if best is None or self._order(row) > self._order(best):
                    best = row
        if best != old:
            if old:
                self.handle.deleteTimer(old[-1] + self.ms)
            self.newest.update(best)
            self.handle.registerTimer(best[-1] + self.ms)
            yield self._change(key, best, True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.newest.exists():
            gone = tuple(self.newest.get())
            self.newest.clear()
            yield self._change(key, gone, False)

    def close(self) -> None:
        pass

    @staticmethod
    def _order(row: tuple) -> tuple:
        """As summaries.newest(): by time, then by the fields, nulls first."""
        return (row[-1], *((v is not None, v or "") for v in row[:-1]))

    @staticmethod
    def _change(key, row: tuple, kept: bool) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *row, kept)], columns=["slug", *FIELDS, "cached_ms", "kept"])


def keep_summaries(made: DataFrame, hours: int = 72, late: str = "0 seconds") -> DataFrame:
    """The changes of a stream of generated summaries (slug, fields, cached_at). State holds the last `hours` alone: see
    Summaries. Rows of no slug, or later than the watermark allows, make none."""
    rows = made.where("slug is not null and cached_at is not null").withWatermark("cached_at", late)
    rows = rows.selectExpr("slug", *FIELDS, "cached_at", "unix_millis(cached_at) AS cached_ms")
    changes = f"slug string, {_VALUE}, kept boolean"
    return rows.groupBy("slug").transformWithStateInPandas(Summaries(hours), outputStructType=changes, outputMode="Append", timeMode="EventTime")


def run_stream(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends what has arrived to Parquet files, then stops; goes on from the checkpoint when it is started again. Keeps
    state in RocksDB, which state with timers needs."""
    conf = rows.sparkSession.conf
    before = conf.get(_PROVIDER)
    conf.set(_PROVIDER, _ROCKS)
    try:
        query = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        return query
    finally:
        conf.set(_PROVIDER, before)


def summaries_in_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(slug, fields, cached_at) that a stopped stream of keep_summaries() holds, from its state store."""
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "summary").load()
    return state.selectExpr("key.slug AS slug", *[f"value.{c} AS {c}" for c in FIELDS], "timestamp_millis(value.cached_ms) AS cached_at")


def volume_stream(articles: DataFrame, late: str = "48 hours", length: str = "48 hours", step: str = "4 hours") -> DataFrame:
    """sliding_volume() of a stream in append mode: a window is written once, when no article that counts can come any
    more. Articles later than `late` are dropped; late_rows() counts them."""
    return sliding_volume(articles.withWatermark("published_at", late), length, step)


def late_rows(query: StreamingQuery) -> int:
    """Rows that a query's stateful operators dropped as too late, in the batches that its progress holds."""
    return sum(int(op["numRowsDroppedByWatermark"]) for progress in query.recentProgress for op in progress["stateOperators"])
