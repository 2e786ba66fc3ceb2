"""Streams of jobs: running progress, the contiguous frontier of completions, and throttled checkpoints."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def live_progress(chunks: DataFrame, rate: int) -> DataFrame:
    """conv_id, last_turn, done characters, and seconds of narration (100 samples a character) made in a second of work.

    The same aggregation serves a table and, in update mode, a stream. A turn takes half a second of work.
    """
    g = chunks.groupBy("conv_id").agg(F.max("turn").alias("last_turn"), F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("done"))
    return g.withColumn("speed", F.round(F.col("done") * 100.0 / rate / (0.5 * (F.col("last_turn") + 1)), 6))


def frontier(completions: DataFrame) -> DataFrame:
    """project, frontier: how many leading indices of a project are complete, from a stream of (project, idx) in any order.

    The state holds the frontier and what lies beyond it as runs of indices, so its size is the number of gaps, not of
    completions; repeated completions change nothing.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        reached, runs = state.get if state.exists else (0, [])
        new = sorted({i for b in batches for i in b["idx"].dropna().astype("int64").tolist() if i >= reached})
        pairs = sorted([(r[0], r[1]) for r in runs] + [(i, i + 1) for i in new])
        joined: list[list[int]] = []
        for start, end in pairs:
            if joined and start <= joined[-1][1]:
                joined[-1][1] = max(joined[-1][1], end)
            else:
                joined.append([start, end])
        if joined and joined[0][0] <= reached:
            reached = max(reached, joined.pop(0)[1])
        state.update((reached, joined))
        yield pd.DataFrame({"project": [key[0]], "frontier": [reached]})

    rows = completions.select("project", "idx").filter("project is not null").groupBy("project")
    return rows.applyInPandasWithState(step, "project long, frontier long", "frontier long, runs array<array<long>>", "update", GroupStateTimeout.NoTimeout)


class CheckpointSink:
    """Keeps verified entries in versions below `path`, and writes one only when enough has changed.

    Entries that differ from what is kept wait in a folder, one part for each micro-batch; from `limit` of them on, or
    `seconds` after the last version, they become the next version, and so they do when the phase ends: flush(). Entries
    of equal identity change nothing and are not written. A micro-batch that runs again replaces its own part, and parts
    that were written but not removed before a failure hold nothing new the next time.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], limit: int = 1000, seconds: float = 30, clock: Callable[[], float] = time.monotonic):
        self.spark, self.path, self.keys, self.limit, self.seconds, self.clock = spark, path.rstrip("/"), keys, limit, seconds, clock
        self.saved_at = clock()

    def _files(self, folder: str) -> tuple:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _numbers(self, folder: str, name: str) -> list[int]:
        at, store = self._files(folder)
        return sorted(int(x.getPath().getName().split("=")[1]) for x in store.listStatus(at) if x.getPath().getName().startswith(f"{name}=")) if store.exists(at) else []

    def _changes(self, rows: DataFrame) -> DataFrame:
        """rows whose identity isn't that of the newest version's entry."""
        if not self._numbers("versions", "version"):
            return rows
        kept = latest_entries(self.spark.read.parquet(f"{self.path}/versions"), self.keys)
        rest = [c for c in rows.columns if c not in self.keys]
        old = kept.select(*self.keys, F.struct(*rest).alias("_old"))
        return rows.join(old, self.keys, "left").filter(~F.struct(*rest).eqNullSafe(F.col("_old"))).select(rows.columns)

    def __call__(self, batch: DataFrame, number: int) -> None:
        self._changes(batch).write.mode("overwrite").parquet(f"{self.path}/waiting/batch={number}")
        waiting = self.spark.read.parquet(f"{self.path}/waiting").count()
        if waiting >= self.limit or waiting and self.clock() - self.saved_at >= self.seconds:
            self.flush()

    def flush(self) -> int:
        """Write what waits as the next version; the number of its entries, and no version where that is 0."""
        batches = self._numbers("waiting", "batch")
        if not batches:
            return 0
        newest = latest_entries(self.spark.read.parquet(f"{self.path}/waiting").withColumnRenamed("batch", "version"), self.keys)
        changed = self._changes(newest).persist()
        n = changed.count()
        if n:
            changed.write.mode("overwrite").parquet(f"{self.path}/versions/version={1 + max(self._numbers('versions', 'version'), default=-1)}")
        changed.unpersist()
        for b in batches:
            at, store = self._files(f"waiting/batch={b}")
            store.delete(at, True)
        self.saved_at = self.clock()
        return n


def checkpoint_sink(changes: DataFrame, sink: CheckpointSink, checkpoint: str):
    """A writer that hands the micro-batches of a stream of verified entries to a sink; flush it when the query ends."""
    return changes.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)


def latest_entries(versions: DataFrame, keys: list[str]) -> DataFrame:
    """The newest version's row of each key of what checkpoint_sink() wrote."""
    rest = [c for c in versions.columns if c not in keys and c != "version"]
    newest = versions.groupBy(*keys).agg(F.max_by(F.struct(*rest), "version").alias("x"))
    return newest.select(*keys, "x.*")
