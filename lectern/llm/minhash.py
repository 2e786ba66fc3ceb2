"""Near duplicates by one-permutation hashing with optimal densification, banded buckets and star-shaped candidates.

1. A text becomes its set of shingles; documents with one and the same set are a class, and only classes go on.
2. One permutation of the hash space, cut into BINS ranges, gives a class's signature: the least member of each range. An
   empty range borrows the value of a range that a hash of its own number picks, again and again until one isn't empty
   (optimal densification), so that two signatures agree in a place with the sets' similarity, short sets too.
3. BANDS bands of ROWS places make buckets. In a bucket the class that meets most others is the hub. Every class is
   compared with the hub that it shares most buckets with: as many candidates as classes, however large the buckets are.
   Full sets decide, and the links make first components.
4. A star can miss links between classes that both differ from the hub. In buckets that still hold several components,
   each set of members once, signature trees compare the full sets, so that every two classes of a bucket are either
   compared or known to be connected. Large buckets are cut into blocks of bounded size, of which those of near sizes
   meet. No pair of classes is written out.
5. All links make the components.

Two classes of similarity s share no bucket with probability (1 - s ** ROWS) ** BANDS: 2e-9 at 0.85.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import jaccard_join as sets_of
from lectern.llm.common import discard, settle
from lectern.llm.components import components

BINS = 256
BANDS, ROWS = 42, 6
#: Turns of densification that are looked up at a time.
TURNS = 64
_TOP = np.uint64(64 - BINS.bit_length() + 1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


@functools.lru_cache(maxsize=64)
def probes(block: int) -> np.ndarray:
    """For each of TURNS turns (a row each) the ranges that the empty ones look at: a hash of their number and the turn,
    the same for all sets."""
    turn = np.arange(block * TURNS, (block + 1) * TURNS, dtype=np.uint64)[:, None]
    return (sets_of.mix((np.arange(BINS, dtype=np.uint64) << np.uint64(32)) + turn + _STEP) >> _TOP).astype(np.int64)


def signature(s: np.ndarray) -> np.ndarray:
    """BINS places of a set (sorted hashes, not empty): the least member of each range, empty ranges densified."""
    at, first = np.unique((s >> _TOP).astype(np.int64), return_index=True)
    out, full = np.zeros(BINS, dtype=np.uint64), np.zeros(BINS, dtype=bool)
    out[at], full[at] = s[first], True
    empty, block = np.flatnonzero(~full), 0
    while len(empty):
        look = probes(block)[:, empty]
        hit = full[look]
        found = hit.any(axis=0)
        out[empty[found]] = out[look[hit.argmax(axis=0), np.arange(len(empty))][found]]
        empty, block = empty[~found], block + 1
    return out


def bands(s: np.ndarray) -> np.ndarray:
    """A hash for each band of the set's signature."""
    places = signature(s)[: BANDS * ROWS].reshape(BANDS, ROWS)
    out = np.arange(1, BANDS + 1, dtype=np.uint64) * _STEP
    for i in range(ROWS):
        out = sets_of.mix(out + _STEP ^ places[:, i])
    return out.view(np.int64)


def _sets(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, mark (hash of the text), key (of the class; null for an empty set), n and the bands of the class.

    A task gives a class's bands once, however many copies it meets. Sets so small that a set with one member more or
    less isn't similar enough link with nothing else and have no bands.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                keys, sizes, found = [], [], []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1)):
                    s = sets_of.shingle_set(text.as_py(), k)
                    key = sets_of.set_key(s) if len(s) else None
                    new = doc is not None and key is not None and key not in seen
                    found.append(bands(s) if new and 100 * len(s) >= percent * (len(s) + 1) else np.zeros(0, dtype=np.int64))
                    if new:
                        seen.add(key)
                    keys.append(key)
                    sizes.append(len(s))
                offsets = np.r_[0, np.cumsum([len(x) for x in found])].astype(np.int32)
                column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), column], ["doc_id", "mark", "key", "n", "bands"])

    return sets_of.read_documents(docs).mapInArrow(read, "doc_id long, mark long, key long, n long, bands array<long>")


def buckets(known: DataFrame) -> DataFrame:
    """shingle (the bucket), key, n, room (n) and hub of the buckets that several classes have, each class once.

    known: key, n and bands, more than once for a key perhaps. Named as the groups of the Jaccard join are, whose stars
    and trees compare the classes. Buckets of one class are left out before anything but counts is shuffled.
    """
    once = settle(known.filter(F.size("bands") > 0).groupBy("key").agg(F.max("n").alias("n"), F.first("bands").alias("bands")), "minhash-classes")
    rows = once.select("key", "n", F.explode("bands").alias("shingle"))
    several = settle(rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("classes")).filter("classes > 1"), "minhash-buckets")
    rows = settle(sets_of.among(rows, "shingle", several.select("shingle")).join(several, "shingle"), "minhash-rows", once)
    met = settle(rows.groupBy("key").agg(F.sum("classes").alias("met")), "minhash-met")
    hubs = rows.join(met, "key").groupBy("shingle").agg(F.max(F.struct("met", "key"))["key"].alias("hub"))
    out = settle(rows.join(hubs, "shingle").select("shingle", "key", "n", F.col("n").alias("room"), "hub"), "minhash-groups")
    discard(rows, several, met)
    return out


def open_buckets(groups: DataFrame, some: DataFrame, percent: int) -> DataFrame:
    """key and meets: the (pair, side) of every comparison within buckets that hold several components.

    groups: as buckets() gives them; some: key and component so far. Of buckets with the same classes one is compared.
    """
    rows = settle(groups.select("shingle", "key", "n").join(some.select("key", "component"), "key"), "minhash-known")
    members = F.sum(F.xxhash64("key").cast("decimal(38,0)"))
    each = rows.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("classes"), members.alias("members"), F.sum("n").alias("size"))
    once = each.filter("low != high").groupBy("classes", "members").agg(F.min_by("shingle", F.xxhash64("shingle")).alias("shingle"), F.max("size").alias("size"))
    rows = settle(rows.drop("component").join(once.select("shingle", "size"), "shingle"), "minhash-open", rows)
    meet = lambda side, *of: F.struct(F.xxhash64(*of).alias("pair"), F.lit(side).alias("side")).alias("m")
    meets = rows.filter(F.col("size") <= sets_of.BLOCK).select("key", meet(0, "shingle"))
    # a set is no more than 100 / percent times as large as one that it links with: that is one step of sizes at most
    large = rows.filter(F.col("size") > sets_of.BLOCK).withColumn("step", (F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent))).cast("long"))
    cuts = large.groupBy("shingle", "step").agg(F.ceil(F.sum("n") / sets_of.BLOCK).alias("cuts"))
    cut = large.join(cuts, ["shingle", "step"]).withColumn("part", F.pmod(F.xxhash64("key"), "cuts"))
    blocks = cuts.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1))).drop("cuts")
    other = blocks.withColumn("to", F.explode(F.array(F.col("step"), F.col("step") + 1))).select("shingle", F.col("to").alias("step"), F.col("step").alias("step_y"), F.col("part").alias("part_y"))
    pairs = blocks.join(other, ["shingle", "step"]).filter("step != step_y or part <= part_y")
    of = ("shingle", "step", "part", "step_y", "part_y")
    ends = pairs.select("shingle", "step", "part", meet(0, *of)).unionByName(pairs.filter("step != step_y or part != part_y").select("shingle", F.col("step_y").alias("step"), F.col("part_y").alias("part"), meet(1, *of)))
    meets = meets.unionByName(cut.join(ends, ["shingle", "step", "part"]).select("key", "m"))
    return settle(meets.groupBy("key").agg(F.collect_list("m").alias("meets")), "minhash-meets", rows)


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of docs (doc_id, text; other columns are ignored).

    Documents link when 100 * intersection >= percent * union of their shingle sets; component_id is the least doc_id
    reachable by links, itself included, and kept says whether that is the row's own. doc_id holds whole numbers; ids
    of another type that are none are refused with an error. Texts without words have an empty set and stay alone. A
    null doc_id takes part in no link, has a null component_id and is kept; repeated rows are documents of one class.
    An empty table gives an empty result. Sets compare by 64-bit hashes of their shingles.
    """
    sets = settle(_sets(docs, k, percent), "minhash-sets")
    known = sets.filter("doc_id is not null and key is not null")
    classes = settle(known.groupBy("key").agg(F.min(F.struct("doc_id", "mark")).alias("first"), F.max("n").alias("n")).select("key", F.col("first.doc_id").alias("rep"), F.col("first.mark").alias("mark"), "n"), "minhash-reps")
    groups = buckets(known)
    some = settle(classes.join(groups.select("key").distinct(), "key"), "minhash-some")
    texts = settle(sets_of.class_texts(docs, some), "minhash-texts")
    met = settle(sets_of.stars(groups, percent, extra=0), "minhash-star-meets")
    star_links = settle(sets_of.compare(texts.withColumn("component", F.col("key")), met, k, percent), "minhash-stars", met)
    some = settle(sets_of.joined(some, star_links).select("key", "n", "component"), "minhash-starred", some)
    met = open_buckets(groups, some, percent)
    links = settle(sets_of.compare(texts.join(some.select("key", "component"), "key"), met, k, percent).unionByName(star_links), "minhash-links")
    found = settle(components(links), "minhash-components")
    grouped = classes.join(found.select(F.col("node").alias("key"), "component"), "key", "left").select("key", "rep", F.coalesce("component", "key").alias("component"))
    least = grouped.groupBy("component").agg(F.min("rep").alias("component_id"))
    ids = settle(grouped.join(least, "component").select("key", "component_id"), "minhash-ids")
    discard(groups, texts, star_links, some, met, links, classes, found)
    out = sets.select("doc_id", F.col("n").alias("n_shingles"), "key").join(ids, "key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
