"""Silence at edges, speech and loud gaps, and finished books, at exact boundaries."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import intervals, signals, speech, vectors
from lectern.plans import timeline

RATE = 24_000
LIMITS = signals.Limits()


def pieces(spark, clips, length=7001):
    rows = [(clip, k, [float(v) for v in x[k : k + length]]) for clip, x in clips.items() for k in range(0, max(1, len(x)), length)]
    return spark.createDataFrame(rows, "clip string, pos long, samples array<double>").repartition(3)


def sound(seconds, rate=RATE, loud=0.12):
    return loud * np.sin(2 * np.pi * 180 * np.arange(round(seconds * rate)) / rate)


def test_edges(spark):
    silence = lambda seconds, rate=RATE: np.zeros(round(seconds * rate))
    clips = {
        "whole": silence(3), "short": silence(0.1), "both": np.r_[silence(3), sound(2), silence(4)], "tail": np.r_[sound(1.1), silence(3)],
        "brief": np.r_[silence(0.75), sound(2), silence(0.75)], "loud and short": sound(0.1), "nearly": np.r_[silence(2.99), sound(1)],
        "rest": np.r_[silence(3.1), sound(0.1)], "offset": np.r_[silence(3) + 0.5, sound(1)],
    }
    got = sorted((r["clip"], r["kind"], r["start"] / RATE, r["end"] / RATE) for r in signals.edge_silence(pieces(spark, clips), RATE // 4, RATE, LIMITS).collect())
    assert got == sorted([("whole", "silent", 0, 3), ("short", "silent", 0, 0.1), ("both", "leading", 0, 3), ("both", "trailing", 5, 9), ("tail", "trailing", pytest.approx(1.1), 4.1), ("rest", "leading", 0, 3), ("offset", "leading", 0, 3)])


def test_edges_where_frames_do_not_divide_the_least_silence(spark):
    rate = 22_049
    clips = {"first": np.r_[np.zeros(3 * rate), sound(1, rate)], "final": np.r_[sound(1, rate), np.zeros(3 * rate)]}
    found = signals.edge_silence(pieces(spark, clips), round(rate / 4), rate, LIMITS)
    assert sorted((r["clip"], r["start"], r["end"]) for r in found.collect()) == [("final", rate, 4 * rate), ("first", 0, 3 * rate)]
    assert signals.edge_silence(pieces(spark, clips).limit(0), 10, rate, LIMITS).count() == 0


def test_loud_gaps_at_their_boundaries(spark):
    """1.0 s and -38 dBFS are enough, a hundredth less is not; edges aren't judged; a clip without speech is one gap."""

    def loader():  # takes as speech what is far above the rest
        return lambda x, rate: [(int(a), int(b)) for a, b in np.flatnonzero(np.diff(np.r_[False, np.abs(x) > 0.5, False])).reshape(-1, 2)]

    rate, level = 16_000, 10 ** (-38 / 20)
    talk = np.full(rate, 0.9)
    noise = lambda seconds, times=1.0: np.full(round(seconds * rate), level * times)
    clips = {
        "gap": np.r_[talk, noise(1), talk], "brief": np.r_[talk, noise(0.99), talk], "soft": np.r_[talk, noise(1, 0.99), talk], "edges": np.r_[noise(2), talk, noise(2)],
        "none": noise(2), "silent": np.zeros(2 * rate), "two": np.r_[talk, noise(1.5), talk, noise(2), talk], "quiet none": noise(2, 0.5),
    }
    got = sorted((r["clip"], r["start"] / rate, r["end"] / rate) for r in speech.no_speech(pieces(spark, clips), rate, loader).collect())
    assert got == [("gap", 1, 2), ("none", 0, 2), ("two", 1, 2.5), ("two", 3.5, 5.5)]
    with pytest.raises(Exception, match="finite"):
        speech.speech_ranges(spark.createDataFrame([("x", [float("nan")])], "clip string, samples array<double>"), rate).collect()
    assert speech.speech_ranges(spark.createDataFrame([("x", None), ("y", [])], "clip string, samples array<double>"), rate).count() == 0


def test_energy_detector():
    """Short silences are closed, short sounds go, margins stay inside the signal."""
    rate = 1000
    detect = speech.EnergyDetector(level=-20, frame=0.01, silence=0.2, speech=0.18, margin=0.04)
    on, off = (lambda s: np.full(round(s * rate), 0.5)), (lambda s: np.zeros(round(s * rate)))
    assert detect(np.r_[on(0.1), off(0.19), on(0.1), off(0.5)], rate) == [(0, 430)]
    assert detect(np.r_[off(0.5), on(0.17), off(0.5), on(0.18), off(0.01)], rate) == [(1130, 1360)]
    assert detect(off(1), rate) == [] and detect(np.zeros(0), rate) == [] and detect(on(0.005), rate) == []


def test_a_detector_is_loaded_once_in_a_worker(spark, tmp_path):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    path = str(tmp_path / "loads")

    def counted():
        with open(path, "a") as f:
            f.write("x")
        return lambda x, rate: [(0, len(x))]

    rows = spark.createDataFrame([(str(i), [0.5, 0.5]) for i in range(40)], "clip string, samples array<double>").coalesce(1)
    for _ in range(2):
        assert speech.speech_ranges(rows, 2, counted).count() == 40
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(open(path).read()) <= 2  # twenty batches, two runs: a load for each worker process at most


def test_finished_books(spark):
    times = {
        "good": [(0, 5), (5, 10.0009)], "gap": [(1, 2), (4, 9)], "over": [(0, 5), (4.9, 10)], "late": [(0, 10.002)], "empty": [(0, 0)], "below": [(-0.1, 3)], "nan": [(0, float("nan"))], "null": [(None, 3)], "nested": [(0, 8), (2, 3)],
        "short": [(0, 5)], "count": [(0, 5)], "no end": [(0, 5)],
    }
    markers = spark.createDataFrame([(b, i, *map(lambda v: None if v is None else float(v), x)) for b, t in times.items() for i, x in enumerate(t)] + [("other", 0, 0.0, 1.0)], "book string, chapter_no long, start double, end double")
    books = [(b, 10.0, None, None, None) for b in list(times)[:9]] + [("short", 10.0, 12.5, 2.0, 1), ("count", 10.0, 12.0, 2.0, 2), ("no end", float("inf"), 1.0, None, 1), ("none", 10.0, 10.0, 0.0, 0), ("null book", None, None, None, 0)]
    got = timeline.marker_faults(markers, spark.createDataFrame(books, "book string, duration double, expected double, tolerance double, chapters_expected long"))
    bad = dict.fromkeys(list(times)[2:9], ["markers"])
    assert {r["book"]: r["faults"] for r in got.collect()} == bad | {"good": [], "gap": [], "short": ["length"], "count": ["count"], "no end": ["duration"], "none": [], "null book": ["duration"]}
    assert all(r["valid"] == (not r["faults"]) for r in got.collect())
    assert spark.range(31).select(timeline.expected_tolerance(F.col("id")).alias("t")).agg(F.min("t"), F.max("t")).first() == (2.0, 3.0)


def test_a_frame_or_window_is_summed_once(spark):
    """Nothing of a whole frame, window or clip stands where it is computed anew for each element (F11)."""
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    frames = spark.range(4).selectExpr("id vec_id", "0 clip", "id frame_no", "array(id, 2 * id, -1.0D) samples")
    assert "- (aggregate(" not in plan(vectors.frame_levels(frames))
    made = spark.range(9).selectExpr("0 clip", "id frame_no", "-20D rms_dbfs", "id % 3 dominant_bin", "0.5D centroid", "0.1D flatness")
    assert "abs((x#" not in plan(signals.rolling_tone(made, signals.Limits()))
    assert not re.search(r"abs\(\(lambda \w+#\d+ - (?!lambda)", plan(signals.rolling_tone(made, signals.Limits())))
    flags = spark.range(9).selectExpr("0 clip", "id frame_no", "id % 4 = 0 flag", "id % 3 > 0 support")
    assert not re.search(r"RowFrame, \d+, unboundedfollowing", plan(intervals.expand_runs(flags, 1)))
