"""Runs of frames and interval algebra with window functions; every window is one clip's."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def flag_runs(frames: DataFrame, least: int) -> DataFrame:
    """clip, start, end (half open) of the maximal runs of flagged frames, `least` frames long or more."""
    w = Window.partitionBy("clip").orderBy("frame_no")
    runs = frames.filter("flag").withColumn("island", F.col("frame_no") - F.row_number().over(w))
    runs = runs.groupBy("clip", "island").agg(F.min("frame_no").alias("start"), (F.max("frame_no") + 1).alias("end"))
    return runs.filter(F.col("end") - F.col("start") >= least).drop("island")


def expand_runs(frames: DataFrame, least: int) -> DataFrame:
    """flag_runs() grown over adjacent support frames, then merged where they overlap or touch."""
    w = Window.partitionBy("clip").orderBy("frame_no")
    back = Window.partitionBy("clip").orderBy(F.desc("frame_no"))
    stop = F.when(~F.col("support"), F.col("frame_no"))
    f = frames.withColumns({
        "left": F.coalesce(F.max(stop).over(w.rowsBetween(Window.unboundedPreceding, -1)) + 1, F.lit(0)),
        # backwards, as a frame that ends with its clip is read anew for each row
        "right": F.coalesce(F.min(stop).over(back.rowsBetween(Window.unboundedPreceding, -1)), F.count(F.lit(1)).over(Window.partitionBy("clip"))),
        "island": F.col("frame_no") - F.sum(F.col("flag").cast("int")).over(w),
    })
    runs = f.filter("flag").groupBy("clip", "island").agg(F.count(F.lit(1)).alias("n"), F.min_by("left", "frame_no").alias("start"), F.max_by("right", "frame_no").alias("end"))
    return merge_intervals(runs.filter(F.col("n") >= least).select("clip", "start", "end"))


def merge_intervals(intervals: DataFrame, clips: DataFrame | None = None) -> DataFrame:
    """Overlapping and touching intervals of a clip become one; empty ones are dropped.

    With clips (clip, n, one row each) intervals are first cut to [0, n]; those of other clips go. Repeated intervals
    go first, so that the order within a clip has no ties. Null ends drop an interval.
    """
    order = Window.partitionBy("clip").orderBy("start", "end")
    if clips is not None:
        within = lambda c: F.greatest(F.lit(0), F.least("n", c))
        known = intervals.filter("start is not null and end is not null").join(clips.select("clip", "n"), "clip")
        intervals = known.select("clip", within("start").alias("start"), within("end").alias("end"))
    i = intervals.filter(F.col("end") > F.col("start")).distinct().withColumn("before", F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    i = i.withColumn("island", F.sum(F.when(F.col("start") <= F.col("before"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return i.groupBy("clip", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def interval_gaps(merged: DataFrame, clips: DataFrame | None = None) -> DataFrame:
    """The gaps between a clip's consecutive intervals. With clips (clip, n) a clip without intervals is one gap; an
    empty clip has none."""
    nxt = F.lead("start").over(Window.partitionBy("clip").orderBy("start"))
    gaps = merged.select("clip", F.col("end").alias("start"), nxt.alias("end")).filter("end is not null")
    if clips is None:
        return gaps
    silent = clips.filter("n > 0").join(merged.select("clip"), "clip", "left_anti")
    return gaps.unionByName(silent.select("clip", F.lit(0).cast("long").alias("start"), F.col("n").cast("long").alias("end")))


def loud_gaps(frames: DataFrame, gaps: DataFrame, bin_width: int, least: int, level: float) -> DataFrame:
    """Gaps of `least` frames or more whose root mean square is at `level` or above.

    A range join of frames and gaps, made an equi-join by coarse bins: each gap is dealt to the bins it touches.
    """
    bins = F.explode(F.sequence(F.floor(F.col("start") / bin_width), F.floor((F.col("end") - 1) / bin_width)))
    dealt = gaps.filter(F.col("end") - F.col("start") >= least).withColumn("bin", bins)
    f = frames.withColumn("bin", F.floor(F.col("frame_no") / bin_width))
    inside = dealt.join(f, ["clip", "bin"]).filter((F.col("frame_no") >= F.col("start")) & (F.col("frame_no") < F.col("end")))
    out = inside.groupBy("clip", "start", "end").agg(F.round(F.sqrt(F.avg(F.col("value") * F.col("value"))), 6).alias("rms"))
    return out.filter(F.col("rms") >= level - 1e-6)
