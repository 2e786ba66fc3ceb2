"""Timelines of narrated books: exact sample offsets, chapter markers, balanced segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_PAUSE, CHAPTER_PAUSE = 0.18, 0.9


def round_ms(samples: Column, rate: int) -> Column:
    """Samples as milliseconds: one half-even rounding of an exact quotient."""
    return F.bround((samples * 1000).cast("decimal(30,0)") / F.lit(rate).cast("decimal(10,0)"), 0).cast("long")


def timeline(chunks: DataFrame, rate: int) -> DataFrame:
    """Speech and pause entries of each book with start and end samples.

    chunks: book, pos, chapter, samples. A short pause lies between chunks, a long one before a new chapter.
    """
    order = Window.partitionBy("book").orderBy("pos")
    c = chunks.withColumn("last", F.lag("chapter").over(order))
    pause = F.when(F.col("last").isNull(), F.lit(0)).when(F.col("last") != F.col("chapter"), F.lit(round(CHAPTER_PAUSE * rate))).otherwise(F.lit(round(CHUNK_PAUSE * rate))).cast("long")
    entries = F.array(F.struct(F.lit(0).alias("part"), F.lit("pause").alias("kind"), pause.alias("n")), F.struct(F.lit(1).alias("part"), F.lit("speech").alias("kind"), F.col("samples").alias("n")))
    e = c.select("book", "pos", "chapter", "last", F.explode(entries).alias("e")).select("book", "pos", "chapter", "last", "e.*").filter("kind = 'speech' or n > 0")
    done = Window.partitionBy("book").orderBy("pos", "part")
    e = e.withColumns({"entry_no": F.row_number().over(done) - 1, "end": F.sum("n").over(done)})
    starts = (F.col("kind") == "speech") & (F.col("last").isNull() | (F.col("last") != F.col("chapter")))
    return e.select("book", F.col("entry_no").cast("long").alias("entry_no"), "kind", "chapter", "n", (F.col("end") - F.col("n")).alias("start"), "end", starts.alias("starts_chapter"))


def chapter_markers(entries: DataFrame, rate: int) -> DataFrame:
    """Start and end in milliseconds of each chapter; a chapter starts before the pause that opens it."""
    order = Window.partitionBy("book").orderBy("entry_no")
    e = entries.withColumns({"before": F.lag("kind").over(order), "before_n": F.lag("n").over(order), "total": F.max("end").over(Window.partitionBy("book"))})
    m = e.filter("starts_chapter").withColumn("from", F.col("start") - F.when(F.col("before") == "pause", F.col("before_n")).otherwise(F.lit(0)))
    nxt = F.lead("from").over(order)
    return m.select("book", F.row_number().over(order).cast("long").alias("chapter_no"), round_ms(F.col("from"), rate).alias("start_ms"), round_ms(F.coalesce(nxt, "total"), rate).alias("end_ms"))


def balance_segments(entries: DataFrame, parts: int) -> DataFrame:
    """Each book's timeline in `parts` contiguous segments of near-equal length; cuts prefer chapters, then pauses.

    A fold over the cuts that carries the last one; a row per book, its entries as one array.
    """
    rows = entries.groupBy("book").agg(F.sort_array(F.collect_list(F.struct("entry_no", F.col("start").alias("at"), "starts_chapter", (F.col("kind") == "pause").alias("pause"), "end"))).alias("e"))
    rows = rows.withColumns({"size": F.size("e"), "total": F.array_max(F.transform("e", lambda x: x["end"]))})
    w = F.least(F.lit(parts), F.col("size"))

    def step(cuts: Column, s: Column) -> Column:
        low, high = F.element_at(cuts, -1) + 1, F.col("size") - (w - s)
        open_ = F.filter("e", lambda x: (x["entry_no"] >= low) & (x["entry_no"] <= high))
        best = lambda own: F.array_min(F.transform(own, lambda x: F.struct(F.abs(x["at"] * w - F.col("total") * s).alias("off"), x["entry_no"].alias("no"))))["no"]
        return F.concat(cuts, F.array(F.coalesce(best(F.filter(open_, lambda x: x["starts_chapter"])), best(F.filter(open_, lambda x: x["pause"])), best(open_))))

    inner = F.when(w > 1, F.sequence(F.lit(1), w - 1)).otherwise(F.array().cast("array<int>"))
    cuts = F.aggregate(inner, F.array(F.lit(0).cast("long")), step)
    return rows.select("book", F.posexplode(cuts).alias("segment_no", "first_entry"), "size").withColumn("last_entry", F.coalesce(F.lead("first_entry").over(Window.partitionBy("book").orderBy("segment_no")), F.col("size")) - 1).drop("size")


#: Seconds by which the last marker may pass the end of its book.
SLACK = 0.001


def marker_faults(markers: DataFrame, books: DataFrame) -> DataFrame:
    """books with chapters (markers found), faults (the rules that a finished book breaks) and valid (it breaks none).

    markers: book, chapter_no, start, end in seconds. books: book (one row each), duration, and expected (seconds),
    tolerance and chapters_expected, of which null ones aren't judged. Faults: `duration` (missing, not finite, not above
    0), `length` (further from the expected seconds than the tolerance), `count` (another number of markers), `markers`
    (one that is missing a time or has none that is finite, begins below 0, ends no later than it begins, begins before an
    earlier one ends, or ends more than SLACK after the book). Markers of other books are left out.
    """
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    b = books.select("book", F.col("duration").cast("double").alias("long"))
    m = markers.select("book", "chapter_no", F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end")).join(b, "book")
    before = F.coalesce(F.max("end").over(Window.partitionBy("book").orderBy("chapter_no", "start", "end").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    sound = finite("start") & finite("end") & (F.col("start") >= 0) & (F.col("end") > F.col("start")) & (F.col("start") >= before) & (~finite("long") | (F.col("end") <= F.col("long") + SLACK))
    each = m.withColumn("sound", F.coalesce(sound, F.lit(False))).groupBy("book").agg(F.count(F.lit(1)).alias("chapters"), F.bool_and("sound").alias("sound"))
    out = books.join(each, "book", "left").withColumn("chapters", F.coalesce("chapters", F.lit(0).cast("long")))
    length = finite("duration") & (F.abs(F.col("duration") - F.col("expected")) > F.greatest(F.lit(0.0), F.coalesce("tolerance", F.lit(0.0))))
    rules = {"duration": ~(finite("duration") & (F.col("duration") > 0)), "length": length, "count": F.col("chapters") != F.col("chapters_expected"), "markers": ~F.coalesce("sound", F.lit(True))}
    faults = F.array_compact(F.array(*[F.when(F.coalesce(broken, F.lit(False)), F.lit(name)) for name, broken in rules.items()]))
    return out.withColumn("faults", faults).drop("sound").withColumn("valid", F.size("faults") == 0)


def expected_tolerance(segments: Column) -> Column:
    """Seconds by which a book of so many segments may differ from its source."""
    return F.greatest(F.lit(2.0), 0.1 * segments)
