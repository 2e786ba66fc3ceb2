"""Language identification with word-first backoff.

Known words score by their log frequency in each language. An unseen word is scored by its character n-grams of the
greatest length of which any is known, from LONGEST down to single characters. Spark counts the words and n-grams of a
bounded sample of documents for each language; these tables are the model.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import crc_bucket, settle, text_or_empty, unused

LONGEST = 4
#: What is learned from: about so many documents and characters of each language at most (whole texts of documents whose
#: id has a small hash), and about so many documents and characters of all languages together, shared evenly. All their
#: words and n-grams count.
MAX_DOCS, MAX_CHARS, MAX_ALL, MAX_ALL_CHARS = 1500, 20_000_000, 50_000, 80_000_000
#: Rows of so many words are remembered by a worker (a cache: results don't depend on it).
REMEMBERED = 300_000
WORD = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from."""
    return crc_bucket(doc_id, 3) == 1


def gram_counts(docs: DataFrame, max_docs: int = MAX_DOCS, max_chars: int = MAX_CHARS, max_all: int = MAX_ALL) -> DataFrame:
    """lang, size (0: whole words), gram, n: the model's counts, from documents with a lang that are not held out.

    A language's share of its documents is what keeps it, on average, within its bounds.
    """
    rows = docs.filter(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("lang").cast("string").alias("lang"), "doc_id", "text")
    have = settle(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("have"), F.sum(F.coalesce(F.length(F.col("text").cast("string")), F.lit(0))).alias("chars")), "lang-have")
    langs = max(1, have.count())
    most, most_chars = min(float(max_docs), max_all / langs), min(float(max_chars), MAX_ALL_CHARS / langs)
    share = F.least(F.lit(most) / F.col("have"), F.lit(most_chars) / F.greatest("chars", F.lit(1)))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003
    sample = rows.join(have, "lang").filter(part < share)
    words = sample.select("lang", F.explode(F.regexp_extract_all(F.lower(text_or_empty(F.col("text"))), F.lit(r"\p{L}+"), F.lit(0))).alias("gram"))
    words = settle(words.groupBy("lang", "gram").agg(F.count(F.lit(1)).alias("n")), "lang-words")
    out = words.select("lang", F.lit(0).alias("size"), "gram", "n")
    for size in range(1, LONGEST + 1):
        marked = F.concat(F.lit("<"), "gram", F.lit(">"))
        pieces = F.transform(F.sequence(F.lit(1), F.length(marked) - size + 1), lambda i: F.substring(marked, i, F.lit(size)))
        long_enough = words.filter(F.length("gram") + 2 >= size)
        out = out.unionByName(long_enough.select("lang", F.explode(pieces).alias("gram"), "n").groupBy("lang", "gram").agg(F.sum("n").alias("n")).select("lang", F.lit(size).alias("size"), "gram", "n"))
    return out


class LanguageModel:
    """Rows of log frequencies: one for each known word or n-gram, a column for each language."""

    def __init__(self, counts: pd.DataFrame):
        self.langs = sorted(counts["lang"].unique())
        column = {x: i for i, x in enumerate(self.langs)}
        self.grams: list[dict[str, int]] = []
        tables = []
        for size in range(LONGEST + 1):
            own = counts[counts["size"] == size]
            names = {g: i for i, g in enumerate(sorted(own["gram"].unique()))}
            n = np.full((len(names), len(self.langs)), 0.2)
            n[own["gram"].map(names).to_numpy(int), own["lang"].map(column).to_numpy(int)] += own["n"].to_numpy(float)
            tables.append(np.log(n / np.maximum(n.sum(axis=0), 1)))
            self.grams.append(names)
        self.tables = tables
        self.known: dict[str, int] = {}
        self.rows = np.zeros((0, len(self.langs)))

    def row(self, word: str) -> np.ndarray:
        if not word.isalpha():  # numbers among its characters, such as a superscript, part it: only letters were learned
            parts = "".join(c if c.isalpha() else " " for c in word).split()
            return sum((self.row(x) for x in parts), np.zeros(len(self.langs)))
        at = self.grams[0].get(word)
        if at is not None:
            return self.tables[0][at]
        marked = f"<{word}>"
        for size in range(LONGEST, 0, -1):
            get = self.grams[size].get
            found = [k for i in range(len(marked) - size + 1) if (k := get(marked[i : i + size])) is not None and (size > 1 or marked[i] not in "<>")]
            if found:
                return self.tables[size][found].mean(axis=0)
        return np.zeros(len(self.langs))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """The language and its share of the posterior; `und` with 0 where the text has no letter or nothing was learned."""
        if len(self.known) > REMEMBERED:
            self.known = {}
            self.rows = self.rows[:0]
        found = [WORD.findall(t.lower()) if t else [] for t in texts]
        new = [w for w in dict.fromkeys(itertools.chain.from_iterable(found)) if w not in self.known]
        if new and self.langs:
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            self.rows = np.concatenate([self.rows, np.array([self.row(w) for w in new])])
        out = []
        for words in found:
            if not self.langs or not any(any(map(str.isalpha, w)) for w in words):
                out.append((UNKNOWN, 0.0))
                continue
            z = self.rows[np.fromiter(map(self.known.__getitem__, words), dtype=np.int64, count=len(words))].sum(axis=0)
            best = int(z.argmax())
            out.append((self.langs[best], float(1 / np.exp(z - z[best]).sum())))
        return out


def identify(docs: DataFrame, learn_from: DataFrame | None = None, max_docs: int = MAX_DOCS, max_chars: int = MAX_CHARS) -> DataFrame:
    """docs with lang_pred, score (0 to 1) and held_out; columns of these names are replaced, others stay.

    Learns from learn_from (default: docs) by gram_counts(). Only the text is read for a prediction. Null texts and texts
    without a letter are `und` with score 0; ties go to the least language name; an empty table gives an empty result.
    The model's size is bounded by the sample's characters, and it is broadcast; no document moves.
    """
    counts = gram_counts(docs if learn_from is None else learn_from, max_docs, max_chars).toPandas()
    model = docs.sparkSession.sparkContext.broadcast(LanguageModel(counts))

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        rows = texts.astype(object).where(texts.notna(), None).tolist()
        out = [x for k in range(0, len(rows), 500) for x in model.value.predict(rows[k : k + 500])]
        return pd.DataFrame(out, columns=["lang_pred", "score"])

    (p,) = unused(docs, "_prediction")
    out = docs.withColumn(p, predict(F.col("text").cast("string")))
    return out.withColumns({"lang_pred": F.col(p)["lang_pred"], "score": F.col(p)["score"], "held_out": held_out(F.col("doc_id"))}).drop(p)
