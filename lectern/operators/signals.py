"""Signals of clips: issues, pauses, levels and joined parts. A frame is (clip, frame_no, features), a sample (clip, pos, x)."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import let
from lectern.operators import intervals, speech, vectors

FLOOR = 1e-12


@dataclass(frozen=True)
class Limits:
    """What counts as an issue. Levels in dBFS; tones and centroids in units of a bin; lengths in frames, `edge` and
    `no_speech` in seconds."""

    # Fixed values
    silent: float = -50.0
    edge: float = 3.0
    low_level: float = -35.0
    low_share: float = 0.80
    low_bin: int = 25
    low_frames: int = 4
    noise_level: float = -38.0
    noise_zcr: float = 0.22
    noise_centroid: float = 550.0
    noise_flatness: float = 0.07
    noise_frames: int = 4
    tone_level: float = -38.0
    tone_range: float = 12.0
    tone_bin: float = 125.0
    tone_mad: float = 15.0
    centroid_mad: float = 62.5
    centroid_off: float = 100.0
    tone_flatness: float = 0.04
    tone_frames: int = 8
    no_speech: float = 1.0
    no_speech_level: float = -38.0


def features(frames: DataFrame, size: int, low: int) -> DataFrame:
    """Level, sign changes and spectrum of each frame (vec_id, clip, frame_no, samples)."""
    f = frames.select("vec_id", "clip", "frame_no")
    return f.join(vectors.frame_levels(frames), "vec_id").join(vectors.frame_spectrum(frames, size, low), "vec_id")


def _stretch(start: Column, end: Column) -> list[Column]:
    """n, total and power (sum of squares) of a piece's samples from start up to before end."""
    lo = F.greatest(start - F.col("pos"), F.lit(0)).cast("int")
    part = F.slice("samples", lo + 1, F.greatest(F.least(end - F.col("pos"), F.size("samples")).cast("int") - lo, F.lit(0)))
    add = lambda f: F.aggregate(part, F.lit(0.0), lambda a, x: a + f(x.cast("double")))
    return [F.size(part).cast("long").alias("n"), add(lambda x: x).alias("total"), add(lambda x: x * x).alias("power")]


def edge_silence(pieces: DataFrame, size: int, rate: int, limits: Limits) -> DataFrame:
    """Clips that are silent as a whole, and long enough silence at their start and end: kind, start, end in samples.

    pieces (clip, pos, samples) tile each clip, in whatever lengths. Frames of `size` samples are laid from the start for
    the head and from the end for the tail, so no length has to be a multiple of theirs; where whole frames stay short of
    the least silence, the exact first and last samples of that length decide. Each piece gives sums for the frames that
    it touches, and clips meet in partial sums: a long clip is no one task's, and no row is a sample.
    """
    edge = max(1, math.ceil(limits.edge * rate))
    p = pieces.filter((F.size("samples") > 0) & F.col("clip").isNotNull())
    clips = p.groupBy("clip").agg(F.max(F.col("pos") + F.size("samples")).alias("all"))
    p = p.join(clips, "clip").withColumn("last", F.col("pos") + F.size("samples"))
    count = F.floor(F.col("all") / size)

    def frames(kind: str, offset: Column) -> DataFrame:
        touched = F.sequence(F.floor((F.col("pos") - offset) / size), F.floor((F.col("last") - 1 - offset) / size))
        rows = p.withColumn("no", F.explode(touched))
        at = offset + F.col("no") * size
        return rows.select("clip", "all", F.lit(kind).alias("of"), "no", *_stretch(at, at + size))

    ends = [p.filter(F.col("all") >= edge).filter(touch).select("clip", "all", F.lit(kind).alias("of"), F.lit(0).cast("long").alias("no"), *_stretch(start, end)) for kind, touch, start, end in (("first", F.col("pos") < edge, F.lit(0), F.lit(edge)), ("final", F.col("last") > F.col("all") - edge, F.col("all") - edge, F.col("all")))]
    parts = frames("head", F.lit(0)).unionByName(frames("tail", F.col("all") % size))
    for x in ends:
        parts = parts.unionByName(x)
    sums = parts.groupBy("clip", "of", "no").agg(F.first("all").alias("all"), *[F.sum(c).alias(c) for c in ("n", "total", "power")])
    spread = F.greatest(F.col("power") / F.col("n") - F.pow(F.col("total") / F.col("n"), 2), F.lit(0.0))
    quiet = 20 * F.log10(F.sqrt(spread + FLOOR) + FLOOR) <= limits.silent
    of = lambda kind: F.col("of") == kind
    whole = (F.col("no") >= 0) & (F.col("no") < count)
    c = sums.groupBy("clip").agg(
        F.first("all").alias("all"), F.bool_and(quiet | ~of("head")).alias("silent"),
        F.min(F.when(of("head") & whole & ~quiet, F.col("no"))).alias("loud"), F.max(F.when(of("tail") & whole & ~quiet, F.col("no"))).alias("late"),
        F.bool_or(of("first") & quiet).alias("first"), F.bool_or(of("final") & quiet).alias("final"),
    )
    reach = lambda frames, exact: F.when((frames * size < edge) & exact, F.lit(edge)).otherwise(frames * size).cast("long")
    c = c.withColumns({"head": reach(F.coalesce("loud", count), F.col("first")), "tail": reach(F.coalesce(count - 1 - F.col("late"), count), F.col("final"))})
    span = lambda cond, kind, start, end: F.when(cond, F.struct(F.lit(kind).alias("kind"), start.cast("long").alias("start"), end.cast("long").alias("end")))
    some = ~F.col("silent") & (count > 0)
    found = F.array(span(F.col("silent"), "silent", F.lit(0), F.col("all")), span(some & (F.col("head") >= edge), "leading", F.lit(0), F.col("head")), span(some & (F.col("tail") >= edge), "trailing", F.col("all") - F.col("tail"), F.col("all")))
    return c.select("clip", F.explode(F.array_compact(found)).alias("x")).select("clip", "x.*")


def _median(values: Column) -> Column:
    middle = lambda v: (F.get(v, F.floor((F.size(v) - 1) / 2).cast("int")) + F.get(v, F.floor(F.size(v) / 2).cast("int"))) / 2
    return let(F.sort_array(values), middle)


def _deviation(values: Column, middle: Column) -> Column:
    return _median(F.transform(values, lambda x: F.abs(x - middle)))


def rolling_tone(frames: DataFrame, limits: Limits) -> DataFrame:
    """Frames (clip, frame_no) that belong to a sustained tone: members, within limits, of an accepted window of frames.

    A window's medians are values of their own within the condition; as columns they would be sorted anew for each member.
    """
    n = limits.tone_frames
    w = Window.partitionBy("clip").orderBy("frame_no").rowsBetween(0, n - 1)
    member = F.struct("frame_no", "rms_dbfs", F.col("dominant_bin").cast("double").alias("bin"), "centroid", "flatness")
    own = F.named_struct(F.lit("tone"), _median(F.col("m.bin")), F.lit("middle"), _median(F.col("m.centroid")))

    def sustained(t: Column) -> Column:
        ok = (t["tone"] >= limits.tone_bin) & (_deviation(F.col("m.bin"), t["tone"]) <= limits.tone_mad)
        return ok & (_deviation(F.col("m.centroid"), t["middle"]) <= limits.centroid_mad) & (_deviation(F.col("m.centroid"), t["tone"]) <= limits.centroid_off)

    level = (F.array_min("m.rms_dbfs") >= limits.tone_level) & (F.array_max("m.rms_dbfs") - F.array_min("m.rms_dbfs") <= limits.tone_range)
    f = frames.select("clip", F.collect_list(member).over(w).alias("m")).filter(F.size("m") == n)
    f = f.filter(level & (_median(F.col("m.flatness")) <= limits.tone_flatness) & let(own, sustained))
    near = lambda t: F.filter("m", lambda x: (F.abs(x["bin"] - t["tone"]) <= 2 * limits.tone_mad) & (F.abs(x["centroid"] - t["middle"]) <= 2 * limits.centroid_mad))
    return f.select("clip", F.explode(let(own, near)).alias("x")).select("clip", "x.frame_no").distinct()


def issues(frames: DataFrame, pieces: DataFrame, size: int, rate: int, limits: Limits, include_vad: bool = False, loader: Callable[[], speech.Detector] = speech.EnergyDetector) -> DataFrame:
    """All issues of a clip as kind, start, end in samples: silence, low-frequency collapse, broadband noise, tones, and
    with include_vad what is loud and no speech by the detector that `loader` makes.

    frames: the features of whole frames of `size` samples; pieces (clip, pos, samples) tile the clips.
    """
    level = F.col("rms_dbfs")
    low = frames.select("clip", "frame_no", ((level >= limits.low_level) & (F.col("low_share") >= limits.low_share)).alias("flag"), ((level >= limits.low_level) & (F.col("dominant_bin") <= limits.low_bin)).alias("support"))
    noisy = (level >= limits.noise_level) & (F.col("zcr") >= limits.noise_zcr) & (F.col("centroid") >= limits.noise_centroid) & (F.col("flatness") >= limits.noise_flatness)
    tones = rolling_tone(frames, limits).withColumn("flag", F.lit(True))
    found = edge_silence(pieces, size, rate, limits)
    for kind, runs in (("low", intervals.expand_runs(low, limits.low_frames)), ("noise", intervals.flag_runs(frames.select("clip", "frame_no", noisy.alias("flag")), limits.noise_frames)), ("tone", intervals.flag_runs(tones, limits.tone_frames))):
        found = found.unionByName(runs.select("clip", F.lit(kind).alias("kind"), (F.col("start") * size).alias("start"), (F.col("end") * size).alias("end")))
    if include_vad:
        gaps = speech.no_speech(pieces, rate, loader, limits.no_speech, limits.no_speech_level)
        found = found.unionByName(gaps.select("clip", F.lit("no speech").alias("kind"), "start", "end"))
    return found


def gain_to_target(frames: DataFrame, target: float, ceiling: float) -> DataFrame:
    """Gain in dB that brings each clip's gated level to `target`, its peak staying below `ceiling`.

    Frames at -70 dB and above count, then those less than 10 dB below their mean. A clip without any has no gain.
    """
    power = vectors.dot(F.col("samples"), F.col("samples")) / F.size("samples")
    peak = F.array_max(F.transform("samples", F.abs))
    f = frames.select("clip", power.alias("p"), peak.alias("peak")).withColumn("gated", F.when(F.col("p") >= 1e-7, F.col("p")))
    first = f.groupBy("clip").agg((F.avg("gated") / 10).alias("gate"), F.max("peak").alias("top"))
    second = f.join(first, "clip").filter(F.col("gated") >= F.col("gate")).groupBy("clip").agg(F.avg("gated").alias("mean"))
    level, top = 10 * F.log10("mean"), 20 * F.log10(F.col("top"))
    return first.join(second, "clip", "left").select("clip", F.round(level, 4).alias("level"), F.round(F.least(target - level, F.when(F.col("mean").isNotNull(), ceiling - top)), 4).alias("gain"))


def _meet(pieces: DataFrame, spans: DataFrame, bin_width: int = 1 << 14) -> DataFrame:
    """Each piece (clip, pos, samples) with each span (clip, start, end) that it overlaps, by coarse bins: an equi-join."""
    bins = lambda a, b: F.explode(F.sequence(F.floor(a / bin_width), F.floor((b - 1) / bin_width)))
    dealt = spans.filter(F.col("end") > F.col("start")).withColumn("bin", bins(F.col("start"), F.col("end")))
    p = pieces.filter(F.size("samples") > 0).withColumn("last", F.col("pos") + F.size("samples"))
    met = p.withColumn("bin", bins(F.col("pos"), F.col("last"))).join(dealt, ["clip", "bin"]).filter((F.col("pos") < F.col("end")) & (F.col("last") > F.col("start")))
    return met.filter(F.col("bin") == F.greatest(F.floor(F.col("pos") / bin_width), F.floor(F.col("start") / bin_width))).drop("bin", "last")  # once


def pause_cuts(pieces: DataFrame, rate: int, most: float, level: float = -50.0) -> DataFrame:
    """clip, start, end of what to cut so that no pause between two sounds is longer than `most` seconds.

    pieces (clip, pos, samples) tile the clips. Sounds are whole 10 ms frames at `level` dBFS and above. Half of the
    allowed length stays at each side of a pause; the cut moves outwards by up to 5 ms to the quietest sample, the first
    of equals. A row is a frame or a pause, never a sample.
    """
    size, cap, radius = max(1, round(rate * 0.01)), round(most * rate), round(rate * 0.005)
    p = pieces.filter(F.size("samples") > 0)
    f = p.withColumn("no", F.explode(F.sequence(F.floor(F.col("pos") / size), F.floor((F.col("pos") + F.size("samples") - 1) / size))))
    f = f.select("clip", "no", *_stretch(F.col("no") * size, (F.col("no") + 1) * size)).groupBy("clip", "no").agg(F.sum("n").alias("n"), F.sum("power").alias("power"))
    active = f.filter((F.col("n") == size) & (F.sqrt(F.col("power") / F.col("n") + FLOOR) >= 10 ** (level / 20)))
    pauses = active.select("clip", (F.lag("no").over(Window.partitionBy("clip").orderBy("no")) + 1).alias("a"), F.col("no").alias("b"))
    pauses = pauses.filter((F.col("b") - F.col("a")) * size > cap)
    left, right = F.col("a") * size + cap // 2, F.col("b") * size - (cap - cap // 2)
    side = lambda name, lo, hi: F.struct(F.lit(name).alias("side"), lo.alias("start"), (hi + 1).alias("end"))
    tries = pauses.select("clip", "a", F.explode(F.array(side("start", left - radius, left), side("end", right, right + radius))).alias("t")).select("clip", "a", "t.*")
    met = _meet(p, tries)
    lo = F.greatest(F.col("start") - F.col("pos"), F.lit(0)).cast("int")
    part = F.slice("samples", lo + 1, (F.least(F.col("end") - F.col("pos"), F.size("samples")) - lo).cast("int"))
    own = F.array_min(F.transform(part, lambda x, i: F.struct(F.abs(x).alias("v"), (F.col("pos") + lo + i).alias("pos"))))
    best = met.select("clip", "a", "side", own.alias("q")).groupBy("clip", "a").agg(*[F.min(F.when(F.col("side") == k, F.col("q")))["pos"].alias(k) for k in ("start", "end")])
    return best.filter(F.col("end") > F.col("start")).select("clip", "start", "end")


def pause_apply(pieces: DataFrame, cuts: DataFrame) -> DataFrame:
    """The pieces (clip, pos, samples) without the samples that a cut (clip, start, up to before end) covers.

    pos stays that of the piece's first sample before cutting; pieces that nothing is left of go.
    """
    own = _meet(pieces, cuts).groupBy("clip", "pos").agg(F.collect_list(F.struct("start", "end")).alias("cuts"))
    p = pieces.join(own, ["clip", "pos"], "left")
    left = F.filter("samples", lambda x, i: ~F.exists("cuts", lambda c: (F.col("pos") + i >= c["start"]) & (F.col("pos") + i < c["end"])))
    out = p.withColumn("samples", F.when(F.col("cuts").isNull(), F.col("samples")).otherwise(left)).select("clip", "pos", "samples")
    return out.filter(F.size("samples") > 0)


def join_parts(parts: DataFrame, keys: list[str], gap: int, placeholder: int | None = None) -> DataFrame:
    """The samples of a group's parts in order, with `gap` zeros between; for groups of a few parts.

    A part without samples (null: it failed) is silence of `placeholder` samples, so that what follows keeps its place;
    without a placeholder the group's result is null.
    """
    own = F.col("samples") if placeholder is None else F.coalesce("samples", F.array_repeat(F.lit(0.0), placeholder))
    rows = parts.withColumn("samples", own).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("part", "samples"))).alias("p"))
    pieces = F.transform("p", lambda x, i: F.concat(F.array_repeat(F.lit(0.0), F.when(i > 0, gap).otherwise(0)), x["samples"]))
    return rows.select(*keys, F.flatten(pieces).alias("samples"))


def frame_signal(signals: DataFrame, size: int) -> DataFrame:
    """frame_no and frame (size samples) for every whole frame of each row's samples, beside its other columns.

    An incomplete tail is dropped; null and short signals have no frame.
    """
    count = F.floor(F.size("samples") / size).cast("int")
    numbers = F.when(count > 0, F.sequence(F.lit(0), count - 1))
    rows = signals.withColumn("frame_no", F.explode(numbers))
    return rows.withColumn("frame", F.slice("samples", F.col("frame_no") * size + 1, F.lit(size))).withColumn("frame_no", F.col("frame_no").cast("long")).drop("samples")
