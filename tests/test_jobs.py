"""Streams, and literals for what the tables don't hold."""

import random

from pyspark.sql import functions as F

from lectern.functions import glyphs
from lectern.plans import sheets, status
from lectern.streaming import control, jobs


def test_frontier_stream(spark, tmp_path):
    source, schema = f"{tmp_path}/in", "project long, idx long"
    for k, rows in enumerate(([(1, 1), (2, 0)], [(1, 0), (1, 0), (2, 2)], [(1, 2), (None, 5)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    out = f"{tmp_path}/out"
    stream = jobs.frontier(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source))
    q = stream.writeStream.outputMode("update").foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{out}/n={n}"))
    q.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(out).groupBy("project").agg(F.max_by("frontier", "n").alias("f"))
    assert {tuple(r) for r in got.collect()} == {(1, 3), (2, 1)}


def test_frontier_holds_runs(spark, tmp_path):
    """Completions in random order, in many batches, equal a plain count of the leading ones."""
    rng = random.Random(1)
    rows = [(p, i) for p in (1, 2) for i in range(120) if (p, i) != (2, 77)]
    rng.shuffle(rows)
    for k in range(0, len(rows), 60):
        spark.createDataFrame(rows[k : k + 60], "project long, idx long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = jobs.frontier(spark.readStream.schema("project long, idx long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"))
    out = f"{tmp_path}/out"
    q = stream.writeStream.outputMode("update").foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{out}/n={n}"))
    q.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    last = spark.read.parquet(out).groupBy("project").agg(F.max_by("frontier", "n").alias("f"))
    assert {tuple(r) for r in last.collect()} == {(1, 120), (2, 77)}


def test_checkpoint_sink(spark, tmp_path):
    """A version from the limit on, after the time, or at the end; none where nothing has changed."""
    schema, now = "project long, idx long, size long", [0.0]
    sink = jobs.CheckpointSink(spark, f"{tmp_path}/out", ["project", "idx"], limit=5, seconds=30, clock=lambda: now[0])
    versions = lambda: sorted(x.name for x in (tmp_path / "out/versions").glob("version=*"))
    batch = lambda rows: spark.createDataFrame(rows, schema)
    sink(batch([(1, i, 5) for i in range(3)]), 0)
    assert versions() == []
    sink(batch([(1, i, 5) for i in range(3, 6)]), 1)
    assert versions() == ["version=0"]  # six changes
    sink(batch([(1, i, 5) for i in range(6)]), 2)
    assert sink.flush() == 0 and versions() == ["version=0"]  # all known
    sink(batch([(1, 0, 6), (2, 0, None)]), 3)
    sink(batch([(1, 0, 7)]), 4)
    assert versions() == ["version=0"]
    now[0] = 31.0
    sink(batch([(1, 0, 7)]), 5)
    assert versions() == ["version=0", "version=1"]  # the time is over
    sink(batch([(2, 0, None), (1, 1, 9)]), 6)
    assert sink.flush() == 1 and sink.flush() == 0 and len(versions()) == 3
    rows = jobs.latest_entries(spark.read.parquet(f"{tmp_path}/out/versions"), ["project", "idx"])
    assert {tuple(r) for r in rows.collect()} == {(1, 0, 7), (1, 1, 9), (2, 0, None), *((1, i, 5) for i in range(2, 6))}


def test_checkpoint_stream(spark, tmp_path):
    schema = "project long, idx long, size long"
    for k in range(3):
        spark.createDataFrame([(1, k, 5), (1, 9, 6)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    sink = jobs.CheckpointSink(spark, f"{tmp_path}/out", ["project", "idx"], limit=4)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    jobs.checkpoint_sink(stream, sink, f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    sink.flush()
    rows = jobs.latest_entries(spark.read.parquet(f"{tmp_path}/out/versions"), ["project", "idx"])
    assert {tuple(r) for r in rows.collect()} == {(1, 0, 5), (1, 1, 5), (1, 2, 5), (1, 9, 6)}


def test_a_stream_stops_between_batches(spark, tmp_path):
    """Counts are exact, a stop leaves whole batches, and the next run goes on where this one ended."""
    schema = "project long, idx long"
    for k in range(40):
        spark.createDataFrame([(1, 10 * k + i) for i in range(10)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    out = f"{tmp_path}/out"

    def start(control):
        rows = control.measured(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), n=F.count(F.lit(1)), last=F.max("idx"))
        query = rows.writeStream.foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{out}/n={n}")).option("checkpointLocation", f"{tmp_path}/state").start()
        control.watch(spark, query)
        return query

    first = control.Control(report=lambda told: told["batch"] >= 2 and first.request_stop())
    again = control.Control()
    try:
        start(first).awaitTermination(60)
        assert first.ended.wait(20)
        assert all(told["n"] == told["rows"] == 10 for told in first.batches) and first.batches[-1]["batch"] >= 2
        done = spark.read.parquet(out).count()
        assert done % 10 == 0 and 30 <= done < 400
        query = start(again)
        query.processAllAvailable()
        query.stop()
        assert spark.read.parquet(out).select("idx").distinct().count() == spark.read.parquet(out).count() == 400
    finally:
        for c in (first, again):
            spark.streams.removeListener(c)


def test_hangul(spark):
    df = spark.createDataFrame([(" 한글 a가",)], "t string").select(glyphs.decompose_hangul(F.col("t")))
    import unicodedata

    assert df.first()[0] == unicodedata.normalize("NFD", "한글 a가")


def test_snapshot_faults(spark):
    rows = [("running", 0.5, None, 3), ("gone", float("nan"), float("inf"), None), (None, None, -1.0, -1)]
    got = status.snapshot_faults(spark.createDataFrame(rows, "state string, fraction double, eta double, completed long"))
    assert [r["faults"] for r in got.collect()] == [[], ["state", "fraction", "eta", "completed"], ["state", "fraction", "eta", "completed"]]


def test_sheet_of_marks(spark):
    tags = spark.createDataFrame([(1, "Harbour;  Sons", "")], "book long, publisher string, artist string")
    markers = spark.createDataFrame([(1, 1, 0, 50, "Part #3")], "book long, chapter_no long, start_ms long, end_ms long, title string")
    lines = [r["line"] for r in sheets.marker_sheet(tags, markers).orderBy("line_no").collect()]
    assert lines == ["publisher=Harbour\\; Sons", "[CHAPTER]", "TIMEBASE=1/1000", "START=0", "END=50", "title=Part \\#3"]


def test_numbered(spark):
    rows = spark.createDataFrame([("a", 5), ("a", 25), ("a", 7), ("b", 3), (None, 1)], "k string, o long")
    assert {tuple(r) for r in status.numbered(rows, "k", "o", 10).select("k", "o", "n").collect()} == {("a", 5, 1), ("a", 7, 2), ("a", 25, 3), ("b", 3, 1), (None, 1, 1)}
