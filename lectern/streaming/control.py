"""Progress of a running stream, and stopping it on request between two micro-batches."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener


class Control(StreamingQueryListener):
    """Reports each micro-batch of the query that it watches, and stops that query once a stop is asked for.

    measured() adds numbers to a stream, which come exactly, as Spark's observed metrics. A stop takes effect after a
    micro-batch has been committed, so none is cut short by it and a restart goes on with the next.
    """

    def __init__(self, report: Callable[[dict], None] | None = None, name: str = "progress"):
        self.report, self.name = report, name
        self.batches: list[dict] = []
        self.asked, self.ended = threading.Event(), threading.Event()
        self.query: StreamingQuery | None = None

    def measured(self, rows: DataFrame, **numbers: Column) -> DataFrame:
        return rows.observe(self.name, *[c.alias(k) for k, c in numbers.items()])

    def watch(self, spark: SparkSession, query: StreamingQuery) -> None:
        self.query = query
        spark.streams.addListener(self)

    def request_stop(self) -> None:
        self.asked.set()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if self.query is None or str(p.runId) != str(self.query.runId):
            return
        row = p.observedMetrics.get(self.name)
        told = {"batch": p.batchId, "rows": p.numInputRows} | (row.asDict() if row is not None else {})
        self.batches.append(told)
        if self.report:
            self.report(told)
        if self.asked.is_set():
            # a listener must not wait for its own query
            threading.Thread(target=self.query.stop, daemon=True).start()

    def onQueryIdle(self, event) -> None:
        if self.query is not None and str(event.runId) == str(self.query.runId) and self.asked.is_set():
            threading.Thread(target=self.query.stop, daemon=True).start()

    def onQueryTerminated(self, event) -> None:
        if self.query is not None and str(event.runId) == str(self.query.runId):
            self.ended.set()
