"""Benchmark decontamination by pigeonhole edit matching.

Test items and documents are read as words (runs of word characters, lower-cased). With a budget of e edits an item is
split into e + 1 pieces: whatever e edits do, one piece is left whole. Pieces are found exactly by hashes of their first
words; around each hit Myers' bit-parallel algorithm gives the edit distance of the whole item.
"""

from __future__ import annotations

import re
import uuid
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import settle, unused

WORD = re.compile(r"\w+")
ERROR_RATE = 0.12
#: Words of a piece by which it is looked up at most; the whole piece is compared at each place found.
PROBE = 6
#: Characters of items in one broadcast, about; more items go in as many blocks, one after another, each held against
#: all documents.
BLOCK_CHARS = 16_000_000
RESULT = "array<struct<item_id:bigint,distance:int,start_word:int,end_word:int>>"
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def read_words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def myers(item: list[int], text: list[int], most: int) -> tuple[int, int] | None:
    """Least distance of the item to any stretch of text, and the place after the stretch's last word (the first of equals).

    None if the distance is over `most`. Python's integers hold the bit vectors, so items may have any length.
    """
    n = len(item)
    places: dict[int, int] = {}
    for i, w in enumerate(item):
        places[w] = places.get(w, 0) | 1 << i
    full, top = (1 << n) - 1, 1 << (n - 1)
    plus, minus, score, best, at = full, 0, n, most + 1, -1
    for j, w in enumerate(text):
        eq = places.get(w, 0)
        d0 = (((eq & plus) + plus) ^ plus) | eq | minus
        hp, hm = minus | (full & ~(d0 | plus)), plus & d0
        if hp & top:
            score += 1
        elif hm & top:
            score -= 1
        hp, hm = (hp << 1) & full, (hm << 1) & full
        plus, minus = hm | (full & ~(d0 | hp)), hp & d0
        if score < best:
            best, at = score, j + 1
    return (best, at) if best <= most else None


class Items:
    """The pieces of a block of items, ready to be looked up."""

    def __init__(self, rows: list[tuple[int, str | None]], error_rate: float):
        self.vocab: dict[str, int] = {}
        self.items, pieces = [], {}
        for item_id, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] or "")):
            found = [self.vocab.setdefault(w, len(self.vocab)) for w in read_words(text)]
            if not found:
                continue
            edits = min(int(error_rate * len(found)), len(found) - 1)
            number = len(self.items)
            self.items.append((item_id, found, edits))
            cuts = [len(found) * i // (edits + 1) for i in range(edits + 2)]
            for a, b in zip(cuts, cuts[1:]):
                pieces.setdefault(min(PROBE, b - a), []).append((number, a, b))
        self.pieces = {}
        for size, own in pieces.items():
            hashes = np.array([self._hash(np.array(self.items[n][1][a : a + size], dtype=np.uint64), size)[0] for n, a, _ in own], dtype=np.uint64)
            order = np.argsort(hashes, kind="stable")
            self.pieces[size] = (hashes[order], [own[i] for i in order])

    @staticmethod
    def _hash(ids: np.ndarray, size: int) -> np.ndarray:
        out = np.zeros(len(ids) - size + 1, dtype=np.uint64)
        for i in range(size):
            out = (out ^ (ids[i : len(ids) - size + 1 + i] + np.uint64(1))) * _FACTOR
            out ^= out >> np.uint64(29)
        return out

    def find(self, text: str | None) -> list[dict]:
        """For each item within its budget the least distance and the first stretch that has it."""
        found = read_words(text)
        get = self.vocab.get
        ids = np.fromiter((get(w, -1) for w in found), dtype=np.int64, count=len(found))
        windows: dict[int, list[tuple[int, int]]] = {}
        for size, (hashes, own) in self.pieces.items():
            if len(ids) < size:
                continue
            h = self._hash(ids.astype(np.uint64), size)
            low = np.searchsorted(hashes, h)
            hit = np.flatnonzero(hashes[np.minimum(low, len(hashes) - 1)] == h)
            for p in hit.tolist():
                for k in range(low[p], len(hashes)):
                    if hashes[k] != h[p]:
                        break
                    number, a, b = own[k]
                    _, item, edits = self.items[number]
                    if ids[p : p + b - a].tolist() == item[a:b]:
                        windows.setdefault(number, []).append((max(0, p - a - edits), min(len(ids), p - a + len(item) + edits)))
        out = []
        for number, spans in windows.items():
            item_id, item, edits = self.items[number]
            spans.sort()
            merged = [list(spans[0])]
            for a, b in spans[1:]:
                if a <= merged[-1][1]:
                    merged[-1][1] = max(b, merged[-1][1])
                else:
                    merged.append([a, b])
            best = None
            for a, b in merged:
                stretch = ids[a:b].tolist()
                if (x := myers(item, stretch, edits)) and (best is None or x[0] < best[1]):
                    back = myers(item[::-1], stretch[: x[1]][::-1], edits)
                    best = (item_id, x[0], a + x[1] - (back[1] if back else x[1]), a + x[1])
            if best:
                out.append(best)
        return [dict(zip(("item_id", "distance", "start_word", "end_word"), x)) for x in sorted(out)]


@lru_cache(maxsize=1)
def _ready(block: str, rows: tuple, error_rate: float) -> Items:
    """The block that a worker is at: a stage reads one block, so that it is built once for each worker."""
    return Items(list(rows), error_rate)


def _column(text: Column, rows: Broadcast, name: str, error_rate: float) -> Column:
    @F.pandas_udf(RESULT)
    def find(texts: pd.Series) -> pd.Series:
        items = _ready(name, rows.value, error_rate)
        return pd.Series([items.find(t) for t in texts], dtype="object")

    return find(text)


def leaks(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE) -> DataFrame:
    """docs with leaks: the items that a text holds, with distance and place in words; other columns stay.

    A column `leaks` of docs is replaced. An item of n words is found where a stretch of the text is within
    floor(error_rate * n) word edits of it, so items of a few words where the text has just these. Of equal distances the
    first place counts. item_id holds whole numbers (one of another type that is no number is refused with an error);
    doc_id may be of any type. Items without words or id are left out; of rows with one id and text each is given. Null and
    empty texts hold nothing; repeated rows are judged each; empty tables give empty results and empty lists.

    Items go through the driver in blocks of a bounded size, one after another: between two blocks the rows so far are
    written to the shared folder. A benchmark of up to BLOCK_CHARS is one block, and then nothing is written.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    chars = items.agg(F.coalesce(F.sum(F.length("text") + 16), F.lit(0))).first()[0]
    blocks = 1 + chars // BLOCK_CHARS
    out, before = docs.drop("leaks").withColumn("leaks", F.array().cast(RESULT)), ()
    (new,) = unused(out, "_leaks")
    for b in range(blocks):
        own = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        rows = spark.sparkContext.broadcast(tuple((r[0], r[1]) for r in own.collect()))
        out = out.withColumn(new, _column(F.col("text").cast("string"), rows, uuid.uuid4().hex, error_rate))
        out = out.withColumn("leaks", F.concat("leaks", new)).drop(new)
        if b < blocks - 1:
            out = settle(out, "leaks-block", *before)
            before = (out,)
            rows.destroy()
    return out


def clean(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE) -> DataFrame:
    """docs without those that hold a test item, with the columns that they have, one named `leaks` too."""
    (own,) = unused(docs, "_own_leaks")
    kept = docs.withColumnRenamed("leaks", own) if "leaks" in docs.columns else docs
    found = leaks(kept, benchmark, error_rate).filter(F.size("leaks") == 0).drop("leaks")
    return found.withColumnRenamed(own, "leaks").select(docs.columns)
