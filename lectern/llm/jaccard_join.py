"""Exact similarity join of documents on word shingles, with signature trees.

1. Each text becomes the set of its shingles (64-bit hashes). Documents with one and the same set are a class, and only
   classes go on: copies cost a row, never a pair.
2. All sets order their shingles alike: by hash, but those known as frequent last. Of two sets that link, a bounded number
   of first shingles (the prefixes) must have so many in common. This is exact for any order that all sets share; the
   counts of frequent shingles only keep passages that very many texts have out of the prefixes.
3. In each group of classes with a prefix shingle in common, the class that has it at the first place is the hub. Every
   class is compared with the hub that it shares most with, if that is as much as a link must share. The links found
   make first components; groups that lie inside one component need no more work, so a large family of near copies is
   settled by a star. Classes that share too little with all others together go too.
4. What is left is dealt to blocks of bounded size by families (classes that share several shingles with a hub). Of a
   block, and of two blocks, only those classes meet that share as much with the other block as a link must share.
   Groups that very many blocks share are cut anew, by size.
5. In a comparison, a signature tree: its nodes hold the OR of their documents' token bitmaps and their range of sizes. A
   dual traversal drops node pairs whose greatest possible overlap or size ratio is too small, or that are known to be
   connected; at the leaves the sets themselves decide.
6. All links make the components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import discard, settle, unused
from lectern.llm.components import components

#: Shingles a block holds, about; a larger document is a block of its own.
BLOCK = 60_000
#: Percent of a set by which its prefix is longer than it must be, so that links share so much of their prefixes.
EXTRA = 10
#: Shingles that tie a class to its family, and blocks of a group beyond which it is cut anew.
TIES, HOT = 3, 48
#: Classes that a task compares with one hub.
STAR = 500
#: Frequent shingles that are told apart from others: found OFTEN times in a task and known for the whole, at most.
OFTEN, FREQUENT = 3, 1_000_000
#: Shingles that a task counts at a time.
COUNTED = 4_000_000
#: Shingles in the texts that a task compares, about.
TASK = 1_500_000
#: Bits of a filter for each key that it lets pass, and bits at most (64 MB).
BITS, MOST_BITS = 16, 1 << 29
#: Hashes of so many words are remembered by a worker (a cache: results don't depend on it).
REMEMBERED = 500_000
_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_known = _Words()


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """The sorted distinct hashes of a text's k-word shingles: A-Z lower-cased, split at ASCII white space.

    With fewer words the whole sequence is the only one; no words give an empty set.
    """
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, dtype=np.uint64)
    if len(_known) > REMEMBERED:
        _known.clear()
    h = np.fromiter(map(_known.__getitem__, found), dtype=np.uint64, count=len(found))
    k = min(k, len(h))
    out = np.full(len(h) - k + 1, k, dtype=np.uint64)
    for i in range(k):
        out = mix(out + _MIX[0] ^ h[i : len(h) - k + 1 + i])
    return np.unique(out)


def set_key(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - 2**63


def least_overlap(total: int, percent: int) -> int:
    """The least intersection with which sets of `total` members together are linked: 100 i >= percent (total - i)."""
    return -(-percent * total // (100 + percent))


def prefix(s: np.ndarray, percent: int, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first shingles of a set in the order of all sets: as many as a link can miss, and those that it then shares.

    The first m shingles that two sets have in common, with at least i in common, are among the first n - i + m of
    either. s is sorted; frequent: sorted shingles and their counts.
    """
    n = len(s) - -(-percent * len(s) // 100) + max(1, len(s) * EXTRA // 100)
    keys, counts = frequent
    if not len(keys):
        return s[:n]
    at = np.minimum(np.searchsorted(keys, s), len(keys) - 1)
    return s[np.argsort(np.where(keys[at] == s, counts[at], 0), kind="stable")[:n]]


class _Union:
    def __init__(self, n: int):
        self.up = np.arange(n)
        self.members = [[i] for i in range(n)]

    def join(self, a: int, b: int) -> bool:
        a, b = int(self.up[a]), int(self.up[b])
        if a == b:
            return False
        if len(self.members[a]) < len(self.members[b]):
            a, b = b, a
        self.up[self.members[b]] = a
        self.members[a] += self.members[b]
        self.members[b] = []
        return True


class SignatureTree:
    """A binary tree over sets; a node holds the OR of its members' bitmaps, their sizes' range and their most hash clashes."""

    def __init__(self, sets: list[np.ndarray], ids: list[int], bits: int):
        order = sorted(range(len(sets)), key=lambda i: (int(sets[i][0]), len(sets[i])))
        self.ids = np.array([ids[i] for i in order])
        self.sets = [sets[i] for i in order]
        flags = np.zeros((len(order), bits), dtype=bool)
        for row, s in zip(flags, self.sets):
            row[(s % np.uint64(bits)).astype(np.int64)] = True
        maps = np.packbits(flags, axis=1).view(np.uint64)
        n = np.array([len(s) for s in self.sets])
        clash = n - np.bitwise_count(maps).sum(axis=1)
        self.nodes: list[tuple] = []
        self.root = self._build(maps, n, clash, 0, len(order))

    def _build(self, maps: np.ndarray, n: np.ndarray, clash: np.ndarray, lo: int, hi: int) -> int:
        kids = () if hi - lo == 1 else (self._build(maps, n, clash, lo, (lo + hi) // 2), self._build(maps, n, clash, (lo + hi) // 2, hi))
        self.nodes.append((np.bitwise_or.reduce(maps[lo:hi]), int(n[lo:hi].min()), int(n[lo:hi].max()), int(clash[lo:hi].max()), lo, hi, kids))
        return len(self.nodes) - 1


def dual_traversal(a: SignatureTree, b: SignatureTree, percent: int, union: _Union) -> list[tuple[int, int]]:
    """Links (places in `union`) between members of two trees, or of one with itself; links inside what is already
    connected are left out, for they change no component."""
    out, todo = [], [(a.root, b.root)]
    up = union.up
    while todo:
        p, q = todo.pop()
        bits_p, low_p, high_p, clash_p, p0, p1, kids_p = a.nodes[p]
        bits_q, low_q, high_q, clash_q, q0, q1, kids_q = b.nodes[q]
        if a is b and p == q:
            if kids_p:
                x, y = kids_p
                todo += [(x, y), (y, y), (x, x)]
            continue
        if 100 * high_p < percent * low_q or 100 * high_q < percent * low_p:
            continue
        most = min(high_p, high_q, int(np.bitwise_count(bits_p & bits_q).sum()) + min(clash_p, clash_q))
        if most < least_overlap(low_p + low_q, percent):
            continue
        inside = up[a.ids[p0:p1]]
        if (inside == inside[0]).all() and (up[b.ids[q0:q1]] == inside[0]).all():
            continue
        if not kids_p and not kids_q:
            s, t = a.sets[p0], b.sets[q0]
            both = len(np.intersect1d(s, t, assume_unique=True))
            if 100 * both >= percent * (len(s) + len(t) - both):
                union.join(a.ids[p0], b.ids[q0])
                out.append((int(a.ids[p0]), int(b.ids[q0])))
        elif kids_p and (not kids_q or p1 - p0 >= q1 - q0):
            todo += [(k, q) for k in kids_p]
        else:
            todo += [(p, k) for k in kids_q]
    return out


def tree_links(keys: list[int], sides: list[int], sets: list[np.ndarray], percent: int, known: list[int]) -> list[tuple[int, int]]:
    """Links that connect what is linked among the documents of one block (side 0 only) or between two blocks.

    known: the component that each is in already; links inside one are left out.
    """
    union, first = _Union(len(keys)), {}
    for i, c in enumerate(known):
        union.join(first.setdefault(c, i), i)
    bits = 64
    while bits < min(4 * max(map(len, sets)), 1 << 16):
        bits *= 2
    trees = [SignatureTree([sets[i] for i in at], at, bits) for side in (0, 1) if (at := [i for i, x in enumerate(sides) if x == side])]
    return [(keys[i], keys[j]) for i, j in dual_traversal(trees[0], trees[-1], percent, union)] if trees else []


def _mark() -> Column:
    return F.xxhash64(F.col("text").cast("string")).alias("mark")


def read_documents(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), _mark())


def frequent_shingles(docs: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many different sets have, sorted, and how many about; FREQUENT at most.

    Every text counts. A task counts its own sets and gives the shingles found OFTEN times, which are summed.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        known, counts = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        held, size = [], 0

        def add() -> None:
            nonlocal known, counts, held, size
            own, n = np.unique(np.concatenate([known, *held]), return_counts=True)
            n[np.searchsorted(own, known)] += counts - 1
            keep = n > 1 if len(own) > COUNTED else slice(None)  # so memory stays bounded: these are rare
            known, counts, held, size = own[keep], n[keep], [], 0

        for batch in batches:
            for mark, text in zip(batch.column(1).to_pylist(), batch.column(0)):
                if mark not in seen:
                    seen.add(mark)
                    held.append(shingle_set(text.as_py(), k))
                    size += len(held[-1])
                    if size > COUNTED:
                        add()
        add()
        often = counts >= OFTEN
        yield pa.RecordBatch.from_arrays([pa.array(known[often].view(np.int64)), pa.array(counts[often])], ["shingle", "n"])

    rows = read_documents(docs).select("text", "mark").mapInArrow(count, "shingle long, n long")
    top = rows.groupBy("shingle").agg(F.sum("n").alias("n")).filter(F.col("n") > 2 * OFTEN).orderBy(F.desc("n"), "shingle").limit(FREQUENT).toPandas()
    keys, counts = top["shingle"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)
    order = np.argsort(keys)
    return keys[order], counts[order]


def _sets(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, mark (hash of the text), key (of the class; null for an empty set), n and the prefix of the class.

    A task gives a class's prefix once, however many copies it meets.
    """
    order = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, k))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for lo in range(0, len(ids), 2000):
                keys, sizes, firsts = [], [], []
                for doc, text in zip(ids[lo : lo + 2000].to_pylist(), texts[lo : lo + 2000].to_pylist()):
                    s = shingle_set(text, k)
                    key = set_key(s) if len(s) else None
                    new = doc is not None and key is not None and key not in seen
                    firsts.append(prefix(s, percent, order.value).view(np.int64) if new else np.zeros(0, dtype=np.int64))
                    if new:
                        seen.add(key)
                    keys.append(key)
                    sizes.append(len(s))
                offsets = np.r_[0, np.cumsum([len(x) for x in firsts])].astype(np.int32)
                column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(firsts)))
                yield pa.RecordBatch.from_arrays([ids[lo : lo + 2000], batch.column(2)[lo : lo + 2000], pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), column], ["doc_id", "mark", "key", "n", "prefix"])

    return read_documents(docs).mapInArrow(read, "doc_id long, mark long, key long, n long, prefix array<long>")


def bitmap(keys: DataFrame, hashed: bool = False) -> np.ndarray:
    """A map of bits, one set for each of the keys (one column of whole numbers): BITS for each key, MOST_BITS at most.
    hashed: the keys are hashes themselves.

    Its size is bounded at any scale, and so is what reaches the driver; with more keys it only lets more others pass.
    """
    n, size = keys.count(), 1 << 20
    while size < min(BITS * n, MOST_BITS):
        size *= 2
    at = F.pmod(F.col(keys.columns[0]) if hashed else F.xxhash64(keys.columns[0]), F.lit(size))
    words = keys.select(at.alias("at")).groupBy(F.floor(F.col("at") / 32768).alias("word")).agg(F.bitmap_construct_agg((F.col("at") % 32768).cast("long")).alias("bits"))
    out = np.zeros(size // 8, dtype=np.uint8)
    for r in words.toLocalIterator():
        out[r["word"] * 4096 : (r["word"] + 1) * 4096] = np.frombuffer(r["bits"], dtype=np.uint8)
    return out


def passes(bits: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    at = hashed % (len(bits) * 8)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _able(known: DataFrame, shared: DataFrame, percent: int) -> DataFrame:
    """key, n, room and prefix of classes that may share enough of their prefixes with others, each once.

    shared: shingles that several prefixes have. prefix keeps what is among them (and few others), room the members from
    each place on. All is done row by row, before anything is shuffled.
    """
    bits = known.sparkSession.sparkContext.broadcast(bitmap(shared))

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, n, first, hashed = (batch.column(i) for i in range(4))
            size = np.diff(first.offsets.to_numpy()).astype(np.int64)
            n, values = n.to_numpy(), first.flatten().to_numpy()
            row = np.repeat(np.arange(len(n)), size)
            room = n[row] - (np.arange(len(values)) - np.repeat(np.cumsum(size) - size, size))
            ok = passes(bits.value, hashed.flatten().to_numpy())
            count, most = np.bincount(row[ok], minlength=len(n)), np.zeros(len(n), dtype=np.int64)
            np.maximum.at(most, row[ok], room[ok])
            kept = -(-n * percent // 100)
            able = (count >= np.maximum(1, kept * EXTRA // 100)) & (most >= kept)
            use = ok & able[row]
            offsets = pa.array(np.r_[0, np.cumsum(np.bincount(row[use], minlength=len(n))[able])].astype(np.int32))
            columns = [pa.ListArray.from_arrays(offsets, pa.array(x[use])) for x in (room, values)]
            yield pa.RecordBatch.from_arrays([keys.filter(pa.array(able)), pa.array(n[able]), *columns], ["key", "n", "room", "prefix"])

    rows = known.select("key", "n", "prefix", F.transform("prefix", lambda x: F.xxhash64(x)).alias("hashed")).filter(F.size("prefix") > 0)
    rows = rows.mapInArrow(select, "key long, n long, room array<long>, prefix array<long>")
    return rows.groupBy("key").agg(F.min(F.struct("n", "room", "prefix")).alias("x")).select("key", "x.*")


def _overlap(total: Column, percent: int) -> Column:
    """least_overlap() of a column."""
    return F.ceil(total * percent / (100 + percent))


def _kept(n: Column, percent: int) -> Column:
    """Members that a set of n has in common with any that it links with, at least; the size of these at least too."""
    return F.ceil(n * percent / 100)


def _needed(n: Column, percent: int, extra: int = EXTRA) -> Column:
    """Prefix shingles that a set of n shares with any that it links with, at least: as many as for the smallest of these."""
    return F.greatest(F.lit(1), F.floor(_kept(n, percent) * extra / 100))


def _groups(known: DataFrame, percent: int) -> DataFrame:
    """shingle, key, n, room (members from its place on) and hub of prefix shingles that several classes have, each once.

    room is what an overlap can be at most if the shingle is the first in common. Classes that share too little of their
    prefixes are left out before anything but counts is shuffled.
    """
    twice = settle(known.select(F.explode("prefix").alias("shingle")).groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("shingle"), "jaccard-twice")
    able = settle(_able(known, twice, percent), "jaccard-able", twice)
    rows = able.select("key", "n", F.explode(F.arrays_zip("prefix", "room")).alias("x")).select(F.col("x.prefix").alias("shingle"), "key", "n", F.col("x.room").alias("room"))
    hubs = rows.groupBy("shingle").agg(F.min(F.struct(F.col("n") - F.col("room"), "key"))["key"].alias("hub"), F.min("key").alias("low"), F.max("key").alias("high"))
    return settle(rows.join(hubs.filter("low != high").select("shingle", "hub"), "shingle"), "jaccard-groups", able)


def class_texts(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """key, n and text of each class; classes: key, n, rep (a document of the class) and mark (its text's hash), settled.

    Other texts are left out before the shuffle.
    """
    rows = among(read_documents(docs).filter("doc_id is not null"), "doc_id", classes.select("rep"))
    one = classes.select("key", "n", F.col("rep").alias("doc_id"), "mark")
    return rows.join(one, ["doc_id", "mark"]).groupBy("doc_id", "mark", "key", "n").agg(F.min("text").alias("text")).select("key", "n", "text")


def compare(texts: DataFrame, met: DataFrame, k: int, percent: int) -> DataFrame:
    """a, b (keys) of linked classes. met: key and meets, the (pair, side) of each comparison; texts: key, n, component, text.

    A task takes many pairs of blocks, as most are small.
    """

    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        out, sets = [], {}
        for _, own in pdf.groupby("pair", sort=True):
            own = own.drop_duplicates(["key", "side"])
            keys = own["key"].tolist()
            for key, text in zip(keys, own["text"]):
                if key not in sets:
                    sets[key] = shingle_set(text, k)
            out += tree_links(keys, own["side"].tolist(), [sets[x] for x in keys], percent, own["component"].tolist())
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    rows = met.join(texts, "key").select(F.explode("meets").alias("m"), "key", "n", "component", "text")
    total = met.join(texts.select("key", "n"), "key").agg(F.coalesce(F.sum(F.size("meets") * F.col("n")), F.lit(0))).first()[0]
    task = F.pmod(F.xxhash64("m.pair"), F.lit(1 + total // TASK)).alias("task")
    return rows.select(task, "m.pair", "m.side", "key", "component", "text").groupBy("task").applyInPandas(links, "a long, b long")


def stars(groups: DataFrame, percent: int, extra: int = EXTRA) -> DataFrame:
    """key and meets: each class meets the hub that it shares most with; a hub meets its classes in parts of about STAR.

    extra: the percentage of a set that links share in groups at least; 0: one group.
    """
    ties = groups.filter("key != hub").groupBy("key", "hub").agg(F.count(F.lit(1)).alias("shared"), F.max("n").alias("n")).filter(F.col("shared") >= _needed(F.col("n"), percent, extra))
    best = ties.groupBy("key").agg(F.max(F.struct("shared", "hub"))["hub"].alias("hub"))
    best = settle(best, "jaccard-best")
    parts = best.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / STAR).alias("parts"))
    meet = lambda hub, part, side: F.struct(F.xxhash64(hub, part).alias("pair"), F.lit(side).alias("side"))
    spokes = best.join(parts, "hub").select("key", meet("hub", F.pmod(F.xxhash64("key"), "parts"), 1).alias("m"))
    hubs = parts.select(F.col("hub").alias("key"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "hub").select("key", meet("hub", F.col("part"), 0).alias("m"))
    return spokes.unionByName(hubs).groupBy("key").agg(F.collect_list("m").alias("meets"))


def _fits(percent: int) -> Column:
    """Whether sizes and components of x and y, the members of two blocks that share a shingle, allow a new link."""
    sizes = (F.col("x.high") * 100 >= F.col("y.low") * percent) & (F.col("y.high") * 100 >= F.col("x.low") * percent)
    one = (F.col("x.from") == F.col("x.to")) & (F.col("y.from") == F.col("y.to")) & (F.col("x.from") == F.col("y.from"))
    return sizes & ~one


def among(rows: DataFrame, name: str, keys: DataFrame) -> DataFrame:
    """rows whose column `name` is among keys (settled), and few others; no row is shuffled."""
    bits = rows.sparkSession.sparkContext.broadcast(bitmap(keys))

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(passes(bits.value, batch.column(batch.num_columns - 1).to_numpy())))

    (own,) = unused(rows, "hashed")
    hashed = rows.withColumn(own, F.xxhash64(name))
    return hashed.mapInArrow(select, hashed.schema).drop(own)


def _open(rows: DataFrame, percent: int) -> DataFrame:
    """rows (shingle, key, component and others, settled) of groups of several components and of classes that still can
    link, and few others.

    A class must share as many shingles of its prefix with other components as a link does, one at a place with room.
    Classes that go make groups smaller, so this is done twice.
    """
    for _ in range(2):
        apart = rows.groupBy("shingle").agg(F.min("component").alias("from"), F.max("component").alias("to")).filter(F.col("from") != F.col("to")).select("shingle")
        apart = settle(apart, "jaccard-apart")
        rows = settle(among(rows, "shingle", apart), "jaccard-open", rows, apart)
        able = rows.groupBy("key").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("shared"), F.max("room").alias("room"))
        able = settle(able.filter((F.col("shared") >= _needed(F.col("n"), percent)) & (F.col("room") >= _kept(F.col("n"), percent))).select("key"), "jaccard-can")
        rows = settle(among(rows, "key", able), "jaccard-open", rows, able)
    return rows


def meetings(groups: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """key and meets: the (pair, side) of every comparison of blocks that a class takes part in.

    groups: as _groups() gives them; classes: key, n and component so far. Groups inside one component are left out.
    """
    rows = _open(settle(groups.join(classes.select("key", "component"), "key"), "jaccard-known"), percent)
    ties = rows.filter("key != hub").groupBy("key", "hub").agg(F.count(F.lit(1)).alias("shared")).filter(F.col("shared") >= TIES)
    families = components(ties.select(F.col("hub").alias("a"), F.col("key").alias("b")))
    members = rows.select("key", "n").distinct().join(families, F.col("key") == F.col("node"), "left").select("key", "n", F.coalesce(families["component"], "key").alias("family"))
    members = settle(members, "jaccard-families")
    large = members.groupBy("family").agg(F.sum("n").alias("all")).filter(F.col("all") > BLOCK).select("family", F.ceil(F.col("all") / BLOCK).alias("blocks"))
    part = F.when(F.col("blocks").isNull(), F.lit(0).cast("long")).otherwise(F.pmod(F.xxhash64("key"), "blocks"))
    dealt = settle(members.join(large, "family", "left").select("key", F.xxhash64("family", part).alias("block")), "jaccard-dealt", members)
    rows = settle(rows.join(dealt, "key"), "jaccard-placed", rows, dealt)

    at = rows.groupBy("shingle", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.min("component").alias("from"), F.max("component").alias("to"))
    at = settle(at.join(at.groupBy("shingle").agg(F.count(F.lit(1)).alias("met")), "shingle"), "jaccard-met")
    few = at.filter(F.col("met") <= HOT).groupBy("shingle").agg(F.collect_list(F.struct("block", "low", "high", "from", "to")).alias("blocks"))
    both = few.select("shingle", "blocks", F.explode("blocks").alias("x")).select("shingle", "x", F.explode("blocks").alias("y")).filter((F.col("x.block") <= F.col("y.block")) & _fits(percent))
    both = both.select("shingle", F.col("x.block").alias("x"), F.col("y.block").alias("y"))
    meet = lambda i, *salt: F.struct(F.xxhash64("x", "y", *salt).alias("pair"), F.lit(i).alias("side")).alias("m")
    ends = both.select("shingle", F.col("x").alias("block"), meet(0)).unionByName(both.filter("x != y").select("shingle", F.col("y").alias("block"), meet(1)))
    # groups in very many blocks aren't counted: what a class has of these may be shared besides
    hot = settle(rows.join(at.filter(F.col("met") > HOT).select("shingle").distinct(), "shingle").select("shingle", "key", "n", "room", "component"), "jaccard-hot")
    heat = hot.groupBy("key").agg(F.count(F.lit(1)).alias("hot"))
    seen = rows.select("shingle", "block", "key", "n", "room").join(ends, ["shingle", "block"]).groupBy("key", "m").agg(F.max("n").alias("n"), F.max("room").alias("room"), F.count(F.lit(1)).alias("shared")).join(heat, "key", "left")
    enough = F.col("shared") >= _needed(F.col("n"), percent) - F.coalesce("hot", F.lit(0))
    across = seen.filter(enough & (F.col("hot").isNotNull() | (F.col("room") >= _kept(F.col("n"), percent)))).select("key", "m")

    # links that may share such groups only: these are cut anew by size, so that only parts of fitting sizes meet
    crowd = hot.join(heat, "key").filter(F.col("hot") >= _needed(F.col("n"), percent)).drop("hot")
    crowd = crowd.withColumn("step", (F.log(F.col("n").cast("double")) / F.log(F.lit(101.0 / percent))).cast("long"))
    wide = crowd.groupBy("shingle", "step").agg(F.ceil(F.sum("n") / BLOCK).alias("cuts"))
    cut = crowd.join(wide, ["shingle", "step"]).withColumn("block", F.xxhash64("shingle", "step", F.pmod(F.xxhash64("key"), "cuts")))
    cut = settle(cut.select("shingle", "key", "n", "room", "component", "block"), "jaccard-cut")
    spans = settle(cut.groupBy("shingle", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max("room").alias("room"), F.min("component").alias("from"), F.max("component").alias("to")), "jaccard-spans")
    x, y = spans.alias("x"), spans.alias("y")
    room = F.least("x.room", "y.room") >= _overlap(F.col("x.low") + F.col("y.low"), percent)
    pairs = x.join(y, "shingle").filter((F.col("x.block") <= F.col("y.block")) & _fits(percent) & room).select(F.col("x.block").alias("x"), F.col("y.block").alias("y"))
    each = pairs.select(F.col("x").alias("block"), meet(0, F.lit("cut"))).unionByName(pairs.filter("x != y").select(F.col("y").alias("block"), meet(1, F.lit("cut"))))
    crowded = cut.select("block", "key").join(each, "block").select("key", "m")
    return settle(across.unionByName(crowded).groupBy("key").agg(F.collect_list("m").alias("meets")), "jaccard-meets", rows, at, hot, cut, spans)


def joined(classes: DataFrame, links: DataFrame) -> DataFrame:
    """classes with component: the least key reachable by links."""
    found = components(links).select(F.col("node").alias("key"), F.col("component").alias("found"))
    return classes.drop("component").join(found, "key", "left").withColumn("component", F.coalesce("found", "key")).drop("found")


def _classes(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The sets of all rows, and key, component and first (the least doc_id and its mark) of each class."""
    sets = settle(_sets(docs, k, percent), "jaccard-sets")
    known = sets.filter("doc_id is not null and key is not null")
    classes = settle(known.groupBy("key").agg(F.min(F.struct("doc_id", "mark")).alias("first"), F.max("n").alias("n")).select("key", F.col("first.doc_id").alias("rep"), F.col("first.mark").alias("mark"), "n"), "jaccard-classes")
    groups = _groups(known, percent)
    some = settle(classes.join(groups.select("key").distinct(), "key"), "jaccard-some")
    texts = settle(class_texts(docs, some), "jaccard-texts")
    met = settle(stars(groups, percent), "jaccard-star-meets")
    star_links = settle(compare(texts.withColumn("component", F.col("key")), met, k, percent), "jaccard-stars", met)
    some = settle(joined(some, star_links).select("key", "n", "component"), "jaccard-starred", some)
    met = meetings(groups, some, percent)
    links = settle(compare(texts.join(some.select("key", "component"), "key"), met, k, percent).unionByName(star_links), "jaccard-links")
    grouped = joined(classes, links)
    least = grouped.groupBy("component").agg(F.min(F.struct("rep", "mark")).alias("first"))
    out = settle(grouped.join(least, "component").select("key", "component", "first"), "jaccard-components")
    discard(groups, texts, star_links, some, met, links, classes)
    return sets, out


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of docs (doc_id, text; other columns are ignored).

    Documents link when 100 * intersection >= percent * union of their shingle sets; component_id is the least doc_id
    reachable by links, itself included. doc_id holds whole numbers: ids of another type are cast, and one that is no
    number is refused with an error. Texts without words have an empty set and stay alone. A null doc_id takes part
    in no link and has a null component_id; repeated rows are documents of one class. An empty table gives an empty
    result. Sets compare by 64-bit hashes of their shingles.
    """
    sets, classes = _classes(docs, k, percent)
    rows, ids = sets.select("doc_id", F.col("n").alias("n_shingles"), "key"), classes.select("key", F.col("first.rep").alias("component_id"))
    return rows.join(ids, "key", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs without near duplicates: of each component the document with the least doc_id stays.

    Rows that repeat a doc_id and its text are one document; other texts of the id are judged by themselves. Rows with
    a null doc_id all stay. doc_id holds whole numbers, as for jaccard_components(); all columns stay, whatever their names.
    """
    sets, classes = _classes(docs, k, percent)
    mark, kept, row = unused(docs, "mark", "kept", "row")
    keep = classes.select("component", "first").distinct().select("first.rep", "first.mark")
    alone = sets.filter("doc_id is not null and key is null").select(F.col("doc_id").alias("rep"), "mark").distinct()
    keep = settle(keep.unionByName(alone).select(F.xxhash64("rep", "mark").alias(kept)), "jaccard-keep")
    own = docs.filter("doc_id is not null").withColumn(mark, _mark())
    # most rows that go are left out before the shuffle, and one exchange serves the join and the window
    own = among(own.withColumn(kept, F.xxhash64(F.col("doc_id").cast("long"), mark)), kept, keep)
    own = own.join(keep.distinct(), kept, "left_semi")
    first = own.withColumn(row, F.row_number().over(Window.partitionBy(kept, "doc_id", mark).orderBy(mark))).filter(F.col(row) == 1)
    return first.select(docs.columns).unionByName(docs.filter("doc_id is null"))
