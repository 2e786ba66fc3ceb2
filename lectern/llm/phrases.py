"""Phrase collocations: exact counts of word sequences by a HAT-trie, and the strongest of each language.

Sequences are counted by length, shortest first, and a longer one is looked at only where its first and its last part are
frequent: what is left out has fewer than `least` occurrences for certain. Each task counts in a burst trie over word
numbers: the directory is shallow, its containers are hash tables that burst in two at a word's border, and when the trie
is full whole subtrees leave as sorted runs. The runs meet by prefix: the first word, or the first two where the first is very
frequent. Each group merges its runs.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import discard, settle
from lectern.llm.jaccard_join import bitmap, mix, passes

LONGEST, LEAST = 3, 10
TOP = 2000
#: Entries of a container before it bursts, and of all tries of a task before they are spilled.
BURST, HELD = 1 << 16, 1 << 21
#: Words whose sequences are held before they are counted, and bits of a word's number.
BATCH, BITS = 1 << 19, 21
#: Names of a language that a task numbers before its trie is spilled.
NAMES = 1 << 19
#: Entries of runs that a group merges, about.
MERGED = 1 << 20
#: Parts of a language from which the strongest are taken before they meet.
SALT = 64
_STEP = np.uint64(0x9E3779B97F4A7C15)
# A-Z to a-z, and the marks that end a piece
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ,;:!?\n\v\f\r", b"abcdefghijklmnopqrstuvwxyz" + b"." * 9)


def tokens(text: bytes | None) -> list[bytes]:
    """The words of a text in order, and a full stop between pieces."""
    return (text or b"").translate(_FOLD).replace(b".", b" . ").split()


class _Numbers(dict):
    """Numbers of words in the order of their first use; 0 ends a piece."""

    def __init__(self):
        super().__init__({b".": 0})
        self.names = [b""]

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.names)
        self.names.append(word)
        return n


class Container:
    """A hash table from code (the packed word numbers of a sequence) to its count, and codes that wait to be folded in."""

    def __init__(self, table: pa.Table | None = None):
        self.table, self.waiting, self.n_waiting = table, [], 0

    def __len__(self) -> int:
        return self.table.num_rows if self.table is not None else 0

    def add(self, codes: np.ndarray) -> None:
        self.waiting.append(codes)
        self.n_waiting += len(codes)
        if self.n_waiting > max(BURST, len(self)):
            self.fold()

    def fold(self) -> None:
        if self.waiting:
            new = pc.value_counts(pa.array(np.concatenate(self.waiting)))
            new = pa.table({"code": new.field("values"), "n": new.field("counts")})
            self.waiting, self.n_waiting = [], 0
            if self.table is not None:
                new = pa.concat_tables([self.table, new]).group_by("code", use_threads=False).aggregate([("n", "sum")]).rename_columns({"n_sum": "n"}).select(["code", "n"])
            self.table = new

    def run(self) -> tuple[np.ndarray, np.ndarray]:
        """Codes in order and their counts."""
        self.fold()
        if self.table is None:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        codes, n = self.table["code"].to_numpy(), self.table["n"].to_numpy()
        order = np.argsort(codes)
        return codes[order], n[order]


class HatTrie:
    """Counts of codes: a shallow directory of borders between subtrees, each with one container.

    A border is the code of a word (or of two, and so on) with nothing after it, so a subtree holds whole branches.
    """

    def __init__(self, words: int):
        self.borders, self.containers = np.zeros(1, dtype=np.int64), [Container()]
        self.words = words

    def __len__(self) -> int:
        return sum(map(len, self.containers))

    def add(self, codes: np.ndarray) -> None:
        if len(self.containers) == 1:
            self.containers[0].add(codes)
        else:
            codes = np.sort(codes)
            ends = np.r_[np.searchsorted(codes, self.borders[1:]), len(codes)]
            for c, lo, hi in zip(self.containers, np.r_[0, ends[:-1]], ends):
                if hi > lo:
                    c.add(codes[lo:hi])
        for i in reversed(range(len(self.containers))):
            if len(self.containers[i]) > BURST:
                self.burst(i)

    def burst(self, i: int) -> None:
        """Cut a container in two at the shortest prefix that parts it about evenly."""
        codes, n = self.containers[i].run()
        for level in reversed(range(self.words)):
            border = int(codes[len(codes) // 2]) >> (BITS * level) << (BITS * level)
            at = int(np.searchsorted(codes, border))
            if 8 * min(at, len(codes) - at) >= len(codes):
                break
        if not 0 < at < len(codes):
            return
        parts = [Container(pa.table({"code": codes[s], "n": n[s]})) for s in (slice(at), slice(at, None))]
        self.containers[i : i + 1] = parts
        self.borders = np.insert(self.borders, i + 1, border)

    def runs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The subtrees in order, each as a sorted run."""
        for c in self.containers:
            yield c.run()


def sequence_hash(lang: int, words: list[np.ndarray]) -> np.ndarray:
    """Hashes of sequences; words: for each place the hashes of the words there, lang: the hash of their language."""
    out = np.full(len(words[0]), lang, dtype=np.uint64)
    for h in words:
        out = mix(out + _STEP ^ h)
    return out.view(np.int64)


class _Counter:
    """One language's sequences of k words in a task."""

    def __init__(self, lang: str, k: int, bits: np.ndarray | None, hot: np.ndarray | None, parts: int):
        self.lang, self.k, self.bits, self.hot, self.parts = lang, k, bits, hot, parts
        self.seed = xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass"))
        self.restart()

    def restart(self) -> None:
        self.numbers, self.trie, self.held, self.hashes, self.total = _Numbers(), HatTrie(self.k), [b"."], np.zeros(1, np.uint64), 0

    def hashed(self) -> np.ndarray:
        new = self.numbers.names[len(self.hashes) :]
        self.hashes = np.r_[self.hashes, np.fromiter(map(xxhash.xxh3_64_intdigest, new), dtype=np.uint64, count=len(new))]
        return self.hashes

    def count(self) -> None:
        """Add the sequences of the words that are held."""
        k = self.k
        ids = np.fromiter(map(self.numbers.__getitem__, self.held), dtype=np.int64, count=len(self.held))
        self.held = [b"."]
        if k == 1:
            ids = ids[ids != 0]
            self.total += len(ids)
            return self.trie.add(ids)
        h, m = self.hashed()[ids], len(ids) - k + 2
        if m < 2:
            return None
        known = passes(self.bits, sequence_hash(self.seed, [h[i : m + i] for i in range(k - 1)]))
        for i in range(k - 1):
            known &= ids[i : m + i] != 0
        at = np.flatnonzero(known[:-1] & known[1:])
        codes = np.zeros(len(at), dtype=np.int64)
        for i in range(k):
            codes = codes << BITS | ids[at + i]
        return self.trie.add(codes)

    def spilled(self) -> Iterator[pa.RecordBatch]:
        """Every subtree as a sorted run, cut by the parts that its prefixes belong to; the trie and the numbers start again."""
        self.count()
        names, hashes = pa.array(self.numbers.names, pa.binary()), self.hashed()
        for codes, n in self.trie.runs():
            if len(codes):
                ids = [codes >> (BITS * i) & ((1 << BITS) - 1) for i in reversed(range(self.k))]
                words = [hashes[x] for x in ids]
                prefix, hot = sequence_hash(self.seed, words[:1]), np.ones(len(codes), dtype=bool)
                for i in range(1, self.k):
                    hot &= passes(self.hot, prefix)
                    prefix = np.where(hot, sequence_hash(self.seed, words[: i + 1]), prefix)
                phrases = pc.binary_join_element_wise(*[names.take(pa.array(x)) for x in ids], b" ")
                yield self._rows(prefix % self.parts, phrases, n)
        if self.k == 1 and self.total:
            yield self._rows(np.zeros(1, np.int64), pa.array([b""]), np.array([self.total]))
        self.restart()

    def _rows(self, part: np.ndarray, phrases: pa.Array, n: np.ndarray) -> pa.RecordBatch:
        table = pa.table({"part": part, "phrase": phrases, "n": n}).sort_by([("part", "ascending"), ("phrase", "ascending")]).combine_chunks()
        part = table["part"].to_numpy()
        starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        offsets = pa.array(np.r_[starts, len(part)].astype(np.int32))
        columns = [pa.ListArray.from_arrays(offsets, table[c].chunk(0)) for c in ("phrase", "n")]
        return pa.RecordBatch.from_arrays([pa.array([self.lang] * len(starts)), pa.array(part[starts]), *columns], ["lang", "part", "phrases", "counts"])


def _counted(docs: DataFrame, k: int, known: list[DataFrame], parts: int, least: int) -> DataFrame:
    """lang, phrase (binary), n and h (the hash that tasks know it by) of all sequences of k words that occur `least` times.

    known: the tables of the shorter ones, shortest first. For k = 1 the empty phrase counts all words.
    """
    context = docs.sparkSession.sparkContext
    bits = context.broadcast(bitmap(known[-1].select("h"), hashed=True) if known else None)
    often = [t.filter(F.col("n") > MERGED // 4).select("h") for t in known]
    hot = context.broadcast(bitmap(often[0] if k == 2 else often[0].unionByName(often[1]), hashed=True) if known else None)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters: dict[str, _Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                if lang not in counters:
                    counters[lang] = _Counter(lang, k, bits.value, hot.value, parts)
                c = counters[lang]
                c.held += tokens(text.as_py())
                c.held.append(b".")
                if len(c.held) > BATCH:
                    c.count()
                    if len(c.numbers.names) > NAMES:
                        yield from c.spilled()
                    elif sum(len(x.trie) for x in counters.values()) > HELD:
                        for x in counters.values():
                            yield from x.spilled()
        for c in counters.values():
            yield from c.spilled()

    def merge(runs: pa.Table) -> pa.Table:
        lang = runs["lang"][0].as_py()
        flat = pa.table({"phrase": pc.list_flatten(runs["phrases"]), "n": pc.list_flatten(runs["counts"])})
        total = flat.group_by("phrase", use_threads=False).aggregate([("n", "sum")])
        total = total.filter(pc.greater_equal(total["n_sum"], least))
        split = [x.split(b" ") for x in total["phrase"].to_pylist()]
        seed = xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass"))
        words = [np.fromiter((xxhash.xxh3_64_intdigest(x[i]) for x in split), dtype=np.uint64, count=len(split)) for i in range(k)]
        return pa.table({"lang": pa.array([lang] * len(split), pa.string()), "phrase": total["phrase"], "n": total["n_sum"], "h": pa.array(sequence_hash(seed, words))})

    runs = docs.mapInArrow(count, "lang string, part long, phrases array<binary>, counts array<long>")
    return runs.groupBy("lang", "part").applyInArrow(merge, "lang string, phrase binary, n long, h long")


def count_phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST) -> list[DataFrame]:
    """For each length from 1 to `longest` the table (lang, phrase, n, words) of all sequences with `least` occurrences.

    docs: text and lang. Counts are exact, over whole texts. The first table has the number of all words of a language as
    that of the empty phrase, where it is `least` or more.
    """
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    known: list[DataFrame] = []
    for k in range(1, longest + 1):
        known.append(settle(_counted(docs, k, known, 1 + size // (6 * MERGED), least), f"phrases-{k}"))
    return known


def collocations(docs: DataFrame, top: int = TOP, longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the `top` strongest phrases of each language.

    docs: text, lang, and others, which are ignored. Null text is empty, null lang is `und`; languages without a phrase
    that often have no row; repeated rows count each; an empty table gives an empty result. Of equal scores the more
    frequent phrase comes first, then the lesser one by its bytes.
    """
    tables = count_phrases(docs, longest, least)
    text = lambda t: t.select("lang", F.col("phrase").cast("string").alias("phrase"), "n")
    counts = [text(t) for t in tables]
    single = counts[0].filter("phrase != ''")
    of_length = [single, *counts[1:]]
    found = []
    for k in range(2, longest + 1):
        own = counts[k - 1].withColumn("w", F.split("phrase", " "))
        for cut in range(1, k):
            first, rest = (of_length[j - 1].select("lang", F.col("phrase").alias(name), F.col("n").alias(count)) for j, name, count in ((cut, "first", "l"), (k - cut, "rest", "r")))
            parts = own.select("lang", "phrase", F.col("n").alias("a"), F.array_join(F.slice("w", 1, cut), " ").alias("first"), F.array_join(F.slice("w", cut + 1, k - cut), " ").alias("rest"))
            score = F.expr("cast(1000000 * cast(a as decimal(13,0)) * cast(a as decimal(13,0)) as decimal(38,0)) div cast(cast(l as decimal(19,0)) * cast(r as decimal(19,0)) as decimal(38,0))")
            found.append(parts.join(first, ["lang", "first"]).join(rest, ["lang", "rest"]).select("lang", "phrase", "a", F.struct(score.alias("score"), F.lit(cut).alias("cut"), "l", "r").alias("x"), F.lit(k).alias("k")))
    scored = settle(functools.reduce(DataFrame.unionByName, found).groupBy("lang", "phrase").agg(F.min("a").alias("a"), F.min("x").alias("x"), F.min("k").alias("k")), "phrases-scored")
    # the most frequent longer candidate that a phrase lies in
    inside = scored.filter("k > 2").select("lang", "k", F.col("a").alias("longer"), F.split("phrase", " ").alias("w"))
    parts_of = lambda j: F.transform(F.sequence(F.lit(1), F.size("w") - j + 1), lambda i: F.array_join(F.slice("w", i, j), " "))
    pieces = [inside.filter(F.col("k") > j).select("lang", "longer", F.explode(parts_of(j)).alias("phrase")) for j in range(2, longest)]
    kept = scored
    if pieces:
        most = functools.reduce(DataFrame.unionByName, pieces).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
        kept = scored.join(most, ["lang", "phrase"], "left").filter("longer is null or 100 * longer < 50 * a")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rows = kept.select("lang", "phrase", "a", "x.l", "x.r", "x.score", F.pmod(F.xxhash64("phrase"), F.lit(SALT)).alias("salt"))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    n = counts[0].filter("phrase = ''").select("lang", "n")
    out = settle(rows.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "phrases-top")
    discard(*tables, scored)
    return out
