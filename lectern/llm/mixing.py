"""Mixing sources to target weights by the cube method.

Each document of a source should be taken target / source size times on average. The whole part is certain; the
fraction is an inclusion probability, and the cube method's flight phase moves these probabilities through the null
space of the balancing constraints (documents and words) until all but a few are 0 or 1. Flights run in blocks of one
source at a time; what each leaves open goes into the next level's blocks, until one small landing problem a source is
left, which is solved by the choice nearest to the word total. Exchanges of a taken document for another one of the last
flight then close the gap that is left.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import n_words, settle

WEIGHTS = (5.0, 2.0, 1.0)
TOTAL, MOST = 1.5, 2.0
#: Documents in one flight.
BLOCK = 2000
#: Open units that are kept for the landing, beside the two that a flight leaves.
RESERVE = 12
SEED = 11
_TINY = 1e-9


def flight(p: np.ndarray, docs: np.ndarray, size: np.ndarray, seed: int) -> np.ndarray:
    """Probabilities after a flight that keeps sum(p * docs) and sum(p * size); two at most stay fractional.

    Three units move at a time, along the vector that is orthogonal to both constraints; large ones come first.
    """
    draw = iter(np.random.default_rng(seed).random(len(p) + 4).tolist())
    p, d, s = p.tolist(), docs.tolist(), size.tolist()
    todo = iter([i for i in np.argsort(-size, kind="stable").tolist() if _TINY < p[i] < 1 - _TINY])
    here = list(itertools.islice(todo, 3))
    while len(here) == 3:
        i, j, k = here
        u = (d[j] * s[k] - d[k] * s[j], d[k] * s[i] - d[i] * s[k], d[i] * s[j] - d[j] * s[i])
        if not any(u):
            u = (d[j], -d[i], 0.0)
        up = min((1 - p[x] if v > 0 else -p[x]) / v for x, v in zip(here, u) if v)
        down = min((p[x] if v > 0 else p[x] - 1) / v for x, v in zip(here, u) if v)
        step = up if next(draw) * (up + down) < down else -down
        for x, v in zip(here, u):
            p[x] = min(1.0, max(0.0, p[x] + step * v))
        here = [x for x in here if _TINY < p[x] < 1 - _TINY]
        here += itertools.islice(todo, 3 - len(here))
    return np.array([0.0 if x <= _TINY else 1.0 if x >= 1 - _TINY else x for x in p])


def reserve(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places of RESERVE open units of evenly spread sizes (but not the largest), which the last flight leaves to the landing."""
    left = np.flatnonzero((p > _TINY) & (p < 1 - _TINY))
    left = left[np.argsort(size[left], kind="stable")]
    return left if len(left) <= RESERVE else left[np.linspace(0, 0.95 * (len(left) - 1), RESERVE).astype(int)]


def landing(p: np.ndarray, docs: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The open probabilities become 0 or 1, by the choice whose word total, then document total, is nearest.

    For the few units that the last flight and the reserve leave open, all choices are compared.
    """
    out, left = p.copy(), np.flatnonzero((p > 0) & (p < 1))
    if len(left):
        choices = (np.arange(2 ** len(left))[:, None] >> np.arange(len(left))) & 1
        off = choices - p[left]
        out[left] = choices[np.lexsort((abs(off @ docs[left]), abs(off @ size[left]).round(6)))[0]]
    return out


def exchanged(taken: np.ndarray, size: np.ndarray, goal: float) -> np.ndarray:
    """Choices (0 or 1) after exchanges of a taken unit for another, or changes of one unit, as long as one brings the
    taken sizes nearer to the goal. In each turn the best of all is made; a unit for another keeps the number taken, so
    among equals it goes first."""
    taken = taken.copy()
    gap = goal - float(taken @ size)
    while abs(gap) > _TINY:
        ins, outs = np.flatnonzero(taken == 0), np.flatnonzero(taken == 1)
        ins, best = ins[np.argsort(size[ins], kind="stable")], (abs(gap), -1, -1)
        if len(ins) and len(outs):
            at = np.searchsorted(size[ins], size[outs] + gap)
            for near in (np.maximum(at - 1, 0), np.minimum(at, len(ins) - 1)):
                rest = abs(gap - (size[ins[near]] - size[outs]))
                k = int(rest.argmin())
                best = min(best, (float(rest[k]), int(ins[near[k]]), int(outs[k])))
        for units, sign, place in ((ins, 1, 1), (outs, -1, 2)):
            if len(units):
                rest = abs(gap - sign * size[units])
                k = int(rest.argmin())
                if rest[k] < best[0] - _TINY:
                    best = (float(rest[k]), *((int(units[k]), -1) if place == 1 else (-1, int(units[k]))))
        if best[0] >= abs(gap) - _TINY:
            break
        for unit, value in ((best[1], 1.0), (best[2], 0.0)):
            if unit >= 0:
                taken[unit] = value
        gap = goal - float(taken @ size)
    return taken


def targets(sources: DataFrame, total: float = TOTAL, most: float = MOST, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """source, source_size and target of each source (source, source_size).

    Sources in code point order, null last, have the weights in turn and share `total` times all sizes. A target over
    `most` times its source's size stops there, and the excess is shared by weight again until none is above. The order
    is found by range partitions and their sizes; only sums reach the driver.
    """
    parts = sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id())
    parts = settle(parts.withColumn("row", F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))), "mix-sources")
    before = parts.groupBy("part").agg(F.max("row").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = (F.col("before") + F.col("row") - 1) % len(weights)
    s = parts.join(before.select("part", "before"), "part").withColumn("weight", F.get(F.array(*map(F.lit, weights)), place.cast("int")))
    s = settle(s.select("source", "source_size", "weight", (F.col("source_size") * most).alias("top")), "mix-weights")
    whole = (s.agg(F.sum("source_size")).first()[0] or 0) * total
    share, held = 0.0, -1
    while True:
        above = F.col("weight") * share > F.col("top")
        full, weight, n = s.agg(F.coalesce(F.sum(F.when(above, F.col("top"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0)), F.count_if(above)).first()
        if n == held or not weight:
            break
        held, share = n, max(share, (whole - full) / weight)
    return s.select("source", "source_size", F.least(F.col("weight") * share, "top").alias("target") if weight else F.col("top").alias("target"))


def _fly(units: DataFrame, last: bool, level: int) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["order", "size", "n"], kind="stable").reset_index(drop=True)
        docs, size = pdf["n"].to_numpy(float), (pdf["size"] * pdf["n"]).to_numpy(float)
        p = pdf["p"].to_numpy(float).copy()
        flown = np.ones(len(p), dtype=bool)
        flown[reserve(p, size) if last else []] = False
        p[flown] = flight(p[flown], docs[flown], size[flown], (SEED * 1_000_003 + level * 8191 + int(pdf["order"].iloc[0])) % 2**63)
        pdf["p"] = exchanged(landing(p, docs, size), size, float(pdf["p"].to_numpy(float) @ size)) if last else p
        return pdf

    return units.groupBy("source", "block").applyInPandas(run, units.schema)


def cube_sample(units: DataFrame) -> DataFrame:
    """units (source, size, n rows that stand or fall together, p, others) with p 0 or 1.

    Within each source the sums of p * n and p * n * size stay, up to the landing. Equal input gives an equal result:
    the units' order is a hash of their columns, the seeds are fixed.
    """
    key = [c for c in units.columns if c != "p"]
    fixed = (F.col("p") <= _TINY) | (F.col("p") >= 1 - _TINY)
    units = settle(units.withColumn("order", F.xxhash64(*key)), "mix-units")
    done = units.filter(fixed).withColumn("p", F.round("p"))
    left, level = units.filter(~fixed), 0
    while True:
        counts = left.groupBy("source").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
        last = counts.filter("blocks > 1").isEmpty()
        u, c = left.alias("u"), counts.alias("c")
        dealt = u.join(c, F.col("u.source").eqNullSafe(F.col("c.source"))).select("u.*", F.pmod(F.xxhash64("order", F.lit(level)), "blocks").alias("block"))
        flown = settle(_fly(dealt, last, level), "mix-flown").drop("block")
        if last:
            return done.unionByName(flown).drop("order")
        done, left, level = done.unionByName(flown.filter("p in (0, 1)")), flown.filter("p not in (0, 1)"), level + 1


def mix_sources(docs: DataFrame, total: float = TOTAL, most: float = MOST, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """doc_id, source, size (words), source_size, target, copies and taken (copies * size) for every row of docs.

    No document is taken more than ceil(most) times. Null and empty texts have size 0 and no copies; a null source is a
    source of its own; rows that agree in doc_id, source and size are taken alike. An empty table gives an empty result.
    """
    kind = docs.schema["doc_id"].dataType
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"))
    units = settle(rows.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-sizes")
    sizes = targets(units.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), total, most, weights)
    u, t = units.alias("u"), settle(sizes, "mix-targets").alias("t")
    rate = F.when(F.col("size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    joined = u.join(t, F.col("u.source").eqNullSafe(F.col("t.source"))).select("u.*", "source_size", "target", F.floor(rate + _TINY).alias("sure"), F.greatest(rate - F.floor(rate + _TINY), F.lit(0.0)).alias("p"))
    taken = cube_sample(joined).withColumn("copies", (F.col("sure") + F.col("p")).cast("long"))
    return taken.select(F.col("doc_id").cast(kind).alias("doc_id"), "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "n")


def expanded(mix: DataFrame) -> DataFrame:
    """A row for each document of a mix, of those that stand together too."""
    return mix.withColumn("n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).drop("n")


def mixed_documents(docs: DataFrame, **settings: float) -> DataFrame:
    """The documents of the mix, with size, copies and taken; those with no copies are left out."""
    mix = mix_sources(docs, **settings).filter("copies > 0").select("doc_id", "source", "size", "copies", "taken")
    rest = docs.drop("size", "copies", "taken")
    d, m = rest.withColumn("size", n_words(F.col("text"))).alias("d"), mix.alias("m")
    same = F.col("d.doc_id").eqNullSafe(F.col("m.doc_id")) & F.col("d.source").cast("string").eqNullSafe(F.col("m.source")) & (F.col("d.size") == F.col("m.size"))
    return d.join(m, same).select("d.*", "m.copies", "m.taken")
