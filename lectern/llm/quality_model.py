"""Quality classifier: supervised subword embeddings.

A document is the average of learned vectors: of its words and of their character n-grams, hashed into tables. A softmax
layer gives the classes; all is trained by stochastic gradient descent in numpy on a bounded sample of labelled rows.
As the output is linear in the average, scoring needs one number a word: its features' vectors times the output weights.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Callable
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import crc_bucket, settle

WORD_ROWS, GRAM_ROWS, DIM = 1 << 16, 1 << 17, 8
GRAMS = (2, 3, 4)
#: At most so many labelled rows, and so many bytes of their texts, are used for training, by the hash of their ids.
MAX_ROWS, MAX_BYTES = 3000, 24_000_000
EPOCHS, RATE, SEED = 6, 0.5, 7
THRESHOLD = 0.3
#: Scores of so many words are remembered by a worker (a cache: results don't depend on it).
REMEMBERED = 400_000
#: Tokens that stand for the end of a text and for a word said again at once.
END, AGAIN = "\x03", "\x02"


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of words, one word's after another's, and where each word's begin.

    A word has its own row and a row for each n-gram of its characters between marks; the two tokens have their own
    alone. All n-grams of all words are hashed at once, as sums of mixed code points.
    """
    marked = [w if w in (END, AGAIN) else f"<{w}>" for w in words]
    size = np.array([len(w) for w in marked], dtype=np.int64)
    begin = np.cumsum(size) - size
    code = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    left = np.repeat(begin + size, size) - np.arange(len(code))  # characters up to the word's end, own included
    place = np.arange(len(code)) - np.repeat(begin, size)
    plain = np.repeat([w not in (END, AGAIN) for w in words], size)
    whole = _scatter(np.add.reduceat(_scatter(code + _scatter(place.astype(np.uint64) + np.uint64(77))), begin)) % np.uint64(WORD_ROWS)
    rows, word = [whole.astype(np.int64)], [np.arange(len(words))]
    number = np.repeat(np.arange(len(words)), size)
    for n in GRAMS:
        at = np.flatnonzero((left >= n) & plain)
        h = np.full(len(at), n, dtype=np.uint64)
        for i in range(n):
            h = _scatter(h * np.uint64(0x100000001B3) + code[at + i])
        rows.append((h % np.uint64(GRAM_ROWS)).astype(np.int64) + WORD_ROWS)
        word.append(number[at])
    order = np.argsort(np.concatenate(word), kind="stable")
    count = np.bincount(np.concatenate(word), minlength=len(words))
    return np.concatenate(rows)[order], np.cumsum(count) - count


def _scatter(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class _Numbers(dict):
    """Words by number; a new word gets the next one."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class QualityModel:
    """u: the output weight of each feature row; score = sigmoid(sum over tokens / number of features + bias)."""

    def __init__(self, u: np.ndarray, bias: float):
        self.u, self.bias = u, bias
        self._forget()

    def _forget(self) -> None:
        self.known = _Numbers({END: 0, AGAIN: 1})
        self.sums, self.counts = np.zeros(0), np.zeros(0)

    def __getstate__(self) -> dict:
        return {"u": self.u, "bias": self.bias}

    def __setstate__(self, state: dict) -> None:
        self.__init__(**state)

    def _learn_new(self) -> None:
        """Sums and numbers of features of the words that were met since the last call."""
        have = len(self.sums)
        new = list(itertools.islice(self.known, have, None))
        for k in range(0, len(new), 20_000):
            rows, begin = word_features(new[k : k + 20_000])
            self.sums = np.append(self.sums, np.add.reduceat(self.u[rows], begin))
            self.counts = np.append(self.counts, np.diff(np.r_[begin, len(rows)]))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """The score of each text; a text is its words, the end token, and a token for each word said again at once."""
        if not texts:
            return np.zeros(0)
        if len(self.known) > REMEMBERED:
            self._forget()
        each = []
        for t in texts:
            found = (t or "").split()
            each.append(np.fromiter(map(self.known.__getitem__, itertools.chain(found, (END,))), dtype=np.int64, count=len(found) + 1))
        self._learn_new()
        at, size = np.concatenate(each), np.array([len(x) for x in each])
        begin = np.cumsum(size) - size
        again = np.r_[at[1:] == at[:-1], False]
        again[begin + size - 1] = False
        again[np.maximum(begin + size - 2, 0)] &= size < 2  # a last word like the end token isn't said again
        again = np.add.reduceat(again.astype(np.int64), begin)
        total = np.add.reduceat(self.sums[at], begin) + again * self.sums[1]
        n = np.add.reduceat(self.counts[at], begin) + again * self.counts[1]
        return 1 / (1 + np.exp(-np.clip(total / n + self.bias, -30, 30)))


def train(texts: list[str | None], labels: list[int]) -> QualityModel:
    """Deterministic: the order of the rows, the seed and the constants above fix the model.

    Without rows, or with rows of one class, the model gives the (smoothed) share of label 1 to every text.
    """
    share = (sum(labels) + 0.5) / (len(labels) + 1)
    if len(set(labels)) < 2:
        return QualityModel(np.zeros(WORD_ROWS + GRAM_ROWS), float(np.log(share / (1 - share))))
    number, bags = _Numbers(), []
    for t in texts:
        found = (t or "").split()
        bag = Counter(found)
        bag[AGAIN] += sum(map(eq, found, found[1:]))
        bag[END] += 1
        bags.append(np.array([(number[w], n) for w, n in bag.items() if n], dtype=np.int32))
    known, flat, size = list(number), [], []
    for k in range(0, len(known), 10_000):
        rows, begin = word_features(known[k : k + 10_000])
        flat.append(rows.astype(np.int32))
        size.append(np.diff(np.r_[begin, len(rows)]))
    flat, size = np.concatenate(flat), np.concatenate(size)
    end = np.cumsum(size)
    docs = []
    for bag in bags:
        own = [flat[end[w] - size[w] : end[w]] for w in bag[:, 0]]
        f, at = np.unique(np.concatenate(own), return_inverse=True)
        weight = np.bincount(at, np.repeat(bag[:, 1], size[bag[:, 0]])).astype(np.float32)
        docs.append((f, weight / weight.sum(), min(len(bag), 50)))
    del number, known, bags, flat
    rng = np.random.default_rng(SEED)
    emb = rng.uniform(-1 / DIM, 1 / DIM, (WORD_ROWS + GRAM_ROWS, DIM)).astype(np.float32)
    out, bias = np.zeros((2, DIM), dtype=np.float32), np.zeros(2, dtype=np.float32)
    steps, done = EPOCHS * len(docs), 0
    for _ in range(EPOCHS):
        for d in rng.permutation(len(docs)):
            f, weight, scale = docs[d]
            own = emb[f]
            mean = weight @ own
            z = out @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[d]] -= 1
            rate = RATE * (1 - done / steps)
            back = p @ out
            out -= rate * np.outer(p, mean)
            bias -= 0.05 * rate * p
            own -= (rate * scale) * weight[:, None] * back
            emb[f] = own
            done += 1
    return QualityModel((emb @ (out[1] - out[0])).astype(np.float64), float(bias[1] - bias[0]))


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from."""
    return crc_bucket(doc_id, 5) == 0


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> QualityModel:
    """Learns from at most max_rows labelled documents (labels: doc_id, quality 0 or 1), none of them held out.

    Documents come in the order of their id's hash while their texts together stay within max_bytes; a text that would
    go beyond is passed over, whole. Null ids and null or other labels are left out; of several labels or texts of an id
    the least counts.
    """
    rows = labels.filter("doc_id is not null and quality in (0, 1)").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("label"))
    sample = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    found = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")
    found = settle(found.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label")), "quality-sample")
    size, chosen = 0, []
    for doc, n in found.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id").collect():
        if size + n <= max_bytes:
            size += n
            chosen.append(doc)
    kept = found.filter(F.col("doc_id").isin(chosen)).toPandas().sort_values("doc_id")
    return train([t if isinstance(t, str) else None for t in kept["text"]], kept["label"].astype(int).tolist())


def scorer(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Callable[[Column], Column]:
    """A function from a text column to its score, by a model learned from docs and labels.

    The model (fixed size, 2 MB) is broadcast, no row moves.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, max_rows))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        rows = texts.astype(object).where(texts.notna(), None).tolist()
        return pd.Series(np.concatenate([np.zeros(0), *(model.value.scores(rows[k : k + 500]) for k in range(0, len(rows), 500))]))

    return lambda text: score(text.cast("string"))


def score_quality(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """docs with score (0 to 1; higher: label 1 likelier), predicted and held_out; columns of these names are replaced.

    Only the text is read for a score; null counts as empty, and an empty text has the score of the end token. Equal
    texts have equal scores. An empty table gives an empty result.
    """
    out = docs.withColumn("score", scorer(docs, labels, max_rows)(F.col("text")))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int")).withColumn("held_out", held_out(F.col("doc_id")))


def keep_good(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose text scores `threshold` or more, with the columns that they have."""
    return docs.filter(scorer(docs, labels, max_rows)(F.col("text")) >= threshold)
