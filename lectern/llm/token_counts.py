"""Token counts of a pair-merging tokenizer with byte fallback, by rank-synchronous merging of ragged arrays.

A text is cut where no vocabulary piece can span the cut. The distinct pre-tokens of a batch lie end to end in one
array; in each round every sequence merges its own lowest-ranked pair, all at once, and what survives is counted.

Within a sequence the library takes the lowest rank first and the leftmost of equals. All places of the lowest rank are
merged in one round as far as no merge makes a pair that comes before, or along with, the next place; the first that
does is the round's last. So a sequence takes about as many rounds as it has different pairs, not as many as it has
merges.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
NONE = np.iinfo(np.int64).max
#: Symbols that are merged at a time; a longer pre-token is merged alone.
SYMBOLS = 500_000
#: Counts of so many pre-tokens are remembered by a worker; then it starts afresh (a cache: results don't depend on it).
REMEMBERED = 400_000
OVER = 4096


class PieceMerger:
    """Counts tokens as the vocabulary's library does for plain text, without begin or end tokens."""

    def __init__(self, path: str):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        normal = [i for i in range(lib.get_piece_size()) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))]
        self.build({lib.id_to_piece(i): lib.get_score(i) for i in normal})

    def build(self, pieces: dict[str, float]) -> None:
        """Tables of pairs from pieces and their scores."""
        ids = {p: k for k, p in enumerate(pieces)}
        for c in {c for p in pieces for c in p} - ids.keys():
            ids[c] = len(ids)
        self.ids = ids
        # A character that is no piece costs its bytes, as byte tokens
        self.cost = np.array([1 if p in pieces else len(p.encode()) for p in ids], dtype=np.int64)
        ranks = {s: r for r, s in enumerate(sorted(set(pieces.values()), reverse=True))}
        pairs = sorted((ids[p[:k]] * len(ids) + ids[p[k:]], ranks[s], ids[p]) for p, s in pieces.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids)
        self.keys, self.ranks, self.merged = (np.array(x, dtype=np.int64) for x in zip(*pairs))
        # Pieces that can be half of a pair that comes before their own merge, or along with it
        own = np.full(len(ids), -1, dtype=np.int64)
        own[self.merged] = self.ranks
        early = np.full(len(ids), NONE, dtype=np.int64)
        for half in (self.keys // len(ids), self.keys % len(ids)):
            np.minimum.at(early, half, self.ranks)
        self.early = early <= own
        self.known: dict[str, int] = {}
        cuts = "".join(c for c in "\n\r\t" if c not in ids)
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("a piece holds a space after other characters: texts can't be cut at spaces")
        self.cut = re.compile(f"{SPACE}*[^{SPACE}{cuts}]+|{SPACE}+|[{cuts}]" if cuts else f"{SPACE}*[^{SPACE}]+|{SPACE}+")

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Index of each pair in the table of merges, -1 where there is none."""
        key = np.where((left < 0) | (right < 0), -1, left * len(self.ids) + right)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, at, -1)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        at = self.lookup(left, right)
        return np.where(at >= 0, self.ranks[at], NONE)

    def places(self, chars: np.ndarray, who: np.ndarray, best: np.ndarray, rank: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Where pairs merge in this round; least: the lowest rank of each symbol's sequence."""
        at = np.flatnonzero(rank == least)
        new = np.r_[True, (np.diff(at) > 1) | (who[at][1:] != who[at][:-1])]  # of pairs that overlap, every other one from the left
        run = np.flatnonzero(new)
        at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))) % 2 == 0]
        into = self.merged[best[at]]
        odd = np.flatnonzero(self.early[into])
        if len(odd):
            # the neighbours at the time of the merge: the left one as merged in this round, the right one as it was
            p, own = at[odd], into[odd]
            before = np.where((odd > 0) & (at[odd - 1] == p - 2), into[odd - 1], chars[p - 1])
            left = self.rank(np.where((p > 0) & (who[p - 1] == who[p]), before, -1), own)
            nxt = np.minimum(p + 2, len(who) - 1)
            right = self.rank(own, np.where((p + 2 < len(who)) & (who[nxt] == who[p]), chars[nxt], -1))
            stop = odd[np.minimum(left, right) <= rank[p]]
            if len(stop):
                first = np.full(who[-1] + 1, len(at), dtype=np.int64)
                np.minimum.at(first, who[at[stop]], stop)
                at = at[np.arange(len(at)) <= first[who[at]]]
        return at

    def merge(self, tokens: list[str]) -> np.ndarray:
        """The number of tokens of each pre-token (none of them empty)."""
        if not tokens:
            return np.zeros(0, dtype=np.int64)
        lengths = np.array([len(t) for t in tokens])
        chars = np.array([self.ids.get(c, -len(c.encode())) for t in tokens for c in t], dtype=np.int64)
        total, who = np.zeros(len(tokens), dtype=np.int64), np.repeat(np.arange(len(tokens)), lengths)
        best = np.full(len(chars), -1, dtype=np.int64)
        best[:-1] = np.where(who[:-1] == who[1:], self.lookup(chars[:-1], chars[1:]), -1)
        rank = np.where(best >= 0, self.ranks[best], NONE)
        while True:
            starts = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
            sizes = np.diff(np.r_[starts, len(who)])
            least = np.repeat(np.minimum.reduceat(rank, starts), sizes)
            gone = least == NONE
            if gone.any():  # these sequences are done: count and leave them
                left = chars[gone]
                np.add.at(total, who[gone], np.where(left >= 0, self.cost[left], -left))
                chars, who, best, rank, least = (x[~gone] for x in (chars, who, best, rank, least))
                if not len(who):
                    return total
            at = self.places(chars, who, best, rank, least)
            chars[at] = self.merged[best[at]]
            keep = np.ones(len(who), dtype=bool)
            keep[at + 1] = False
            chars, who, best, rank = chars[keep], who[keep], best[keep], rank[keep]
            at -= np.arange(len(at))
            pos = np.concatenate([at, at[at > 0] - 1])
            nxt = np.minimum(pos + 1, len(who) - 1)
            best[pos] = np.where((nxt > pos) & (who[nxt] == who[pos]), self.lookup(chars[pos], chars[nxt]), -1)
            rank[pos] = np.where(best[pos] >= 0, self.ranks[best[pos]], NONE)

    def count(self, texts: list[str]) -> list[int]:
        cut = [self.cut.findall(f"{SPACE}{t.replace(' ', SPACE)}") if t else [] for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = [t for t in set().union(*cut) if t not in self.known]
        some, size = [], 0
        for t in [*sorted(new, key=len), ""]:
            if some and (not t or size + len(t) > SYMBOLS):
                self.known.update(zip(some, self.merge(some).tolist()))
                some, size = [], 0
            some.append(t)
            size += len(t)
        get = self.known.__getitem__
        return [sum(map(get, x)) for x in cut]


@lru_cache(maxsize=2)
def merger(path: str) -> PieceMerger:
    return PieceMerger(path)


def token_counts(docs: DataFrame, model_path: str, over: int = OVER) -> DataFrame:
    """docs with n_bytes (UTF-8), n_tokens and over_limit (more than `over` tokens); other columns stay.

    Columns of these names are replaced. Null text counts as empty and has no tokens; an empty table gives an empty
    result; repeated rows are counted each. model_path is opened by the executors' Python workers: it is where
    every machine has the vocabulary. A narrow stage: no shuffle, one batch of texts in memory at a time.
    """

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        rows = texts.fillna("").tolist()
        return pd.Series([n for k in range(0, len(rows), 500) for n in merger(model_path).count(rows[k : k + 500])], dtype="int64")

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    out = docs.withColumns({"n_bytes": F.octet_length(text).cast("long"), "n_tokens": count(text)})
    return out.withColumn("over_limit", F.col("n_tokens") > over)
