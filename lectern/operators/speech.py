"""Speech in signals by a detector that the caller may bring, and the loud stretches without any.

A detector is made by a loader, once in each Python worker, and then called for one signal after another: given its
samples and their rate it returns (start, end) sample numbers of speech. Detectors with a model put the loading there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators import intervals

Detector = Callable[[np.ndarray, int], list[tuple[int, int]]]
_loaded: dict[str, Detector] = {}


class EnergyDetector:
    """Speech is where the level of short frames is high: silences that are too short are closed, runs that are too short
    go, and what is left grows by a margin at both ends. An incomplete frame at the end counts as silence."""

    def __init__(self, level: float = -40.0, frame: float = 0.03, silence: float = 0.2, speech: float = 0.18, margin: float = 0.04):
        self.level, self.frame, self.silence, self.speech, self.margin = level, frame, silence, speech, margin

    def __call__(self, samples: np.ndarray, rate: int) -> list[tuple[int, int]]:
        size = max(1, round(rate * self.frame))
        n = len(samples) // size
        loud = np.mean(samples[: n * size].reshape(n, size) ** 2, axis=1) >= 10 ** (self.level / 10)
        edges = np.flatnonzero(np.diff(np.r_[False, loud, False]))
        runs: list[list[int]] = []
        for start, end in edges.reshape(-1, 2) * size:
            if runs and start - runs[-1][1] < self.silence * rate:
                runs[-1][1] = end
            else:
                runs.append([start, end])
        pad = round(self.margin * rate)
        return [(max(0, int(a) - pad), min(len(samples), int(b) + pad)) for a, b in runs if b - a >= self.speech * rate]


def whole_signals(pieces: DataFrame) -> DataFrame:
    """clip and samples of each clip, from pieces (clip, pos, samples) that tile it; a clip is as long as a row may be."""
    parts = pieces.filter("clip is not null").groupBy("clip").agg(F.sort_array(F.collect_list(F.struct("pos", "samples"))).alias("p"))
    return parts.select("clip", F.flatten("p.samples").alias("samples"))


def speech_ranges(signals: DataFrame, rate: int, loader: Callable[[], Detector] = EnergyDetector) -> DataFrame:
    """clip, start, end of the speech that a detector finds in each signal (clip, samples).

    Null and empty signals have none. A signal with null, NaN or infinite samples is an error, as no detector takes it.
    """
    kind = signals.schema["clip"].dataType.simpleString()
    name = f"{loader.__module__}.{loader.__qualname__}"

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if name not in _loaded:
            _loaded[name] = loader()
        detector = _loaded[name]
        for batch in batches:
            out = []
            for clip, samples in zip(batch["clip"], batch["samples"]):
                if samples is not None and len(samples):
                    x = np.asarray(samples, dtype=np.float64)
                    if not np.isfinite(x).all():
                        raise ValueError(f"clip {clip}: a signal must have finite samples only")
                    out += [(clip, int(a), int(b)) for a, b in detector(x, rate)]
            yield pd.DataFrame(out, columns=["clip", "start", "end"])

    return signals.select("clip", "samples").mapInPandas(find, f"clip {kind}, start long, end long")


def _sums(pieces: DataFrame, start, end) -> DataFrame:
    """pieces with n and power (sum of squares) of the samples from start up to before end."""
    lo = F.greatest(start - F.col("pos"), F.lit(0)).cast("int")
    hi = F.least(end - F.col("pos"), F.size("samples")).cast("int")
    part = F.slice("samples", lo + 1, F.greatest(hi - lo, F.lit(0)))
    return pieces.withColumns({"n": F.size(part), "power": F.aggregate(part, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))})


def loud_ranges(pieces: DataFrame, ranges: DataFrame, rate: int, seconds: float, level: float, bin_width: int = 1 << 14) -> DataFrame:
    """The ranges (clip, start, end) of `seconds` or more whose root mean square is `level` dBFS or more, silence never.

    The ranges meet the pieces (clip, pos, samples) that they touch through coarse bins, an equi-join; a piece gives one
    sum for a range, so no row is a sample.
    """
    bins = lambda a, b: F.explode(F.sequence(F.floor(a / bin_width), F.floor((b - 1) / bin_width)))
    long = ranges.filter((F.col("end") - F.col("start")) / rate >= seconds).withColumn("bin", bins(F.col("start"), F.col("end")))
    last = F.col("pos") + F.size("samples")
    dealt = pieces.filter(F.size("samples") > 0).withColumn("last", last).withColumn("bin", bins(F.col("pos"), last))
    met = dealt.join(long, ["clip", "bin"]).filter((F.col("pos") < F.col("end")) & (F.col("last") > F.col("start")))
    met = met.filter(F.col("bin") == F.greatest(F.floor(F.col("pos") / bin_width), F.floor(F.col("start") / bin_width)))  # a pair once
    sums = _sums(met, F.col("start"), F.col("end")).groupBy("clip", "start", "end").agg(F.sum("n").alias("n"), F.sum("power").alias("power"))
    return sums.filter((F.col("power") > 0) & (10 * F.log10(F.col("power") / F.col("n")) >= level - 1e-6)).select("clip", "start", "end")


def no_speech(pieces: DataFrame, rate: int, loader: Callable[[], Detector] = EnergyDetector, seconds: float = 1.0, level: float = -38.0) -> DataFrame:
    """clip, start, end (samples) of the loud stretches between two stretches of speech, and of loud clips without any.

    pieces (clip, pos, samples) tile each clip. What is before the first and after the last speech isn't judged.
    """
    clips = pieces.groupBy("clip").agg(F.max(F.col("pos") + F.size("samples")).alias("n"))
    speech = intervals.merge_intervals(speech_ranges(whole_signals(pieces), rate, loader), clips)
    return loud_ranges(pieces, intervals.interval_gaps(speech, clips), rate, seconds, level)
