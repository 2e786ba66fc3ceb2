"""Frame and utterance vectors: pooling, similarity, levels, spectra, padding."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import let


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def elements(vectors: DataFrame, *keys: str) -> DataFrame:
    """A row for each element: the keys, dim and x."""
    return vectors.select(*keys, F.posexplode("embedding").alias("dim", "x")).withColumn("x", F.col("x").cast("double"))


def centroids(vectors: DataFrame) -> DataFrame:
    """The mean vector of each label, at unit length; partial sums meet before the shuffle."""
    means = elements(vectors, "label").groupBy("label", "dim").agg(F.avg("x").alias("m"))
    rows = means.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("dim", "m"))).alias("v")).select("label", F.transform("v", lambda x: x["m"]).alias("v"))
    return rows.withColumn("n", norm(F.col("v"))).select("label", F.transform("v", lambda x: x / F.col("n")).alias("centroid"))


#: Centroids in a block: a matrix of so many rows is broadcast at a time.
CENTROIDS = 4096


def voice_similarity(vectors: DataFrame, others: DataFrame, k: int, block: int = CENTROIDS) -> DataFrame:
    """The k most similar centroids of each vector by cosine, with their rank: vec_id, other, similarity, rank.

    Equal similarities (of six digits) rank by label. Centroids go through the driver in blocks of a bounded size; a batch
    of vectors meets a block as one matrix product, and k rows a vector and block are all that moves. Null vectors and
    centroids have no row, a vector of zeros none either. Rows that repeat a vec_id are ranked together.
    """
    spark, kind = vectors.sparkSession, others.schema["label"].dataType.simpleString()
    schema = f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, other {kind}, similarity double"
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).filter("v is not null")

    def against(labels: list, matrix: np.ndarray) -> DataFrame:
        shared = spark.sparkContext.broadcast((labels, matrix))

        def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            names, m = shared.value
            for batch in batches:
                v = np.array(batch["v"].tolist(), dtype=float).reshape(len(batch), -1)
                length = np.sqrt((v * v).sum(axis=1))
                ids, v = batch["vec_id"].to_numpy()[length > 0], v[length > 0]
                x = v @ m.T / length[length > 0, None]
                x = np.sign(x) * np.floor(np.abs(x) * 1e6 + 0.5) / 1e6
                # labels are in order, so a stable sort ranks equals by label
                top = np.argsort(-x, axis=1, kind="stable")[:, :k]
                yield pd.DataFrame({"vec_id": np.repeat(ids, top.shape[1]), "other": [names[i] for i in top.ravel()], "similarity": np.take_along_axis(x, top, axis=1).ravel()})

        return rows.mapInPandas(best, schema)

    found, labels, held = spark.createDataFrame([], schema), [], []
    for r in others.filter("label is not null and centroid is not null").select("label", "centroid").orderBy("label").toLocalIterator():
        labels.append(r["label"])
        held.append(r["centroid"])
        if len(held) == block:
            found, labels, held = found.unionByName(against(labels, np.array(held, dtype=float))), [], []
    if held:
        found = found.unionByName(against(labels, np.array(held, dtype=float)))
    tops = found.groupBy("vec_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("s"), "other"))), 1, k).alias("x"))
    ranked = tops.select("vec_id", F.posexplode("x").alias("i", "x"))
    return ranked.select("vec_id", "x.other", (-F.col("x.s")).alias("similarity"), (F.col("i") + 1).alias("rank"))


def stats_pool(vectors: DataFrame) -> DataFrame:
    """Mean and sample deviation of each dimension of a label's vectors."""
    return elements(vectors, "label").groupBy("label", "dim").agg(F.round(F.avg("x"), 6).alias("mean"), F.round(F.stddev_samp("x"), 6).alias("std"))


def segment_pool(vectors: DataFrame, length: int) -> DataFrame:
    """Mean and maximum of each stretch of `length` elements, given back at each element."""
    w = Window.partitionBy("vec_id", F.floor(F.col("dim") / length))
    return elements(vectors, "vec_id").select("vec_id", "dim", F.round(F.avg("x").over(w), 6).alias("mean"), F.round(F.max("x").over(w), 6).alias("max"))


def mean_norm(vectors: DataFrame) -> DataFrame:
    """Each element less its label's mean of that dimension."""
    w = Window.partitionBy("label", "dim")
    return elements(vectors, "vec_id", "label").select("vec_id", "dim", F.round(F.col("x") - F.avg("x").over(w), 6).alias("x"))


def frame_levels(frames: DataFrame) -> DataFrame:
    """Level in dBFS with the mean removed, and the share of sign changes, of each frame (vec_id, samples)."""
    n = F.size("samples")
    # the planner would put a column of the mean into the function, which then sums all samples for each of them
    f = frames.withColumn("c", let(F.aggregate("samples", F.lit(0.0), lambda s, x: s + x) / n, lambda mean: F.transform("samples", lambda x: x - mean)))
    signs = F.zip_with(F.slice("c", 1, n - 1), F.slice("c", 2, n - 1), lambda a, b: F.when((a < 0) != (b < 0), 1).otherwise(0))
    rms = F.sqrt(dot(F.col("c"), F.col("c")) / n)
    return f.select("vec_id", F.round(20 * F.log10(rms + 1e-12), 4).alias("rms_dbfs"), F.round(F.aggregate(signs, F.lit(0), lambda s, x: s + x) / (n - 1), 6).alias("zcr"))


def frame_spectrum(frames: DataFrame, size: int, low: int = 8) -> DataFrame:
    """Hann-windowed power spectrum of each frame without its mean: dominant bin, centroid, flatness, share up to bin `low`.

    A batch of frames is one matrix and one real Fourier transform; no row moves. Frames (vec_id, samples) that are null,
    of another length or with a null among their samples are left out.
    """
    window = 0.5 - 0.5 * np.cos(np.arange(size) * (2 * math.pi / size))
    kind = frames.schema["vec_id"].dataType.simpleString()

    def spectra(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bins = np.arange(size // 2 + 1)
        for batch in batches:
            x = np.array(batch["samples"].tolist(), dtype=float).reshape(len(batch), size)
            p = np.abs(np.fft.rfft((x - x.mean(axis=1, keepdims=True)) * window, axis=1)) ** 2
            p[:, 0] = 0
            total = p.sum(axis=1) + 1e-30
            flat = np.exp(np.log(p + 1e-30).mean(axis=1)) / (p.mean(axis=1) + 1e-30)
            yield pd.DataFrame({"vec_id": batch["vec_id"], "dominant_bin": p.argmax(axis=1), "centroid": p @ bins / total, "flatness": flat, "low_share": p[:, : low + 1].sum(axis=1) / total})

    whole = frames.select("vec_id", F.col("samples").cast("array<double>").alias("samples")).filter((F.size("samples") == size) & ~F.exists("samples", lambda v: v.isNull()))
    out = whole.mapInPandas(spectra, f"vec_id {kind}, dominant_bin long, centroid double, flatness double, low_share double")
    return out.select("vec_id", "dominant_bin", F.round("centroid", 4).alias("centroid"), F.round("flatness", 6).alias("flatness"), F.round("low_share", 6).alias("low_share"))


def pad_ragged(rows: DataFrame) -> DataFrame:
    """Arrays (label, vec_id, v) padded right with zeros to their label's longest, and the mask of the padding.

    The longest are found by partial sums and joined back, so a label with very many arrays is no one task's. Null arrays
    have null results.
    """
    most = rows.groupBy(F.col("label").alias("_label")).agg(F.max(F.size("v")).alias("most"))
    r = rows.join(most, F.col("label").eqNullSafe(F.col("_label"))).withColumn("own", F.size("v"))
    padding = F.array_repeat(F.lit(False), F.col("own")), F.array_repeat(F.lit(True), F.col("most") - F.col("own"))
    return r.select("vec_id", F.concat("v", F.array_repeat(F.lit(0.0), F.col("most") - F.col("own"))).alias("v"), F.when(F.col("v").isNotNull(), F.concat(*padding)).alias("mask"))


def trim_tokens(tokens: Column, first: int, last: int, limit: int, most: int = 1001) -> Column:
    """Tokens after the first `first` and before the first `last`, below `limit` only. Without a `last` place `most` ends them."""
    a, b = F.array_position(tokens, F.lit(first)), F.array_position(tokens, F.lit(last))
    end = F.when(b > 0, b - 1).otherwise(F.least(F.size(tokens), F.lit(most)))
    return F.filter(F.slice(tokens, (a + 1).cast("int"), F.greatest(end - a, F.lit(0)).cast("int")), lambda x: x < limit)
