"""Language steps that need a dictionary: words of texts without spaces, words as they are spoken, codes of glyphs.

A dictionary is a table. It goes through the driver and to every worker, so it has a limit; it is made into a trie once
in each worker, and a text is read from left to right, the longest entry at each place first.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a dictionary, values included, at most.
MOST_CHARS = 20_000_000
Step = Callable[[Column], Column]
_END = ""


def _bounded(table: DataFrame, *columns: str) -> list[tuple]:
    """The distinct rows of a dictionary without null or empty keys, in order; an error beyond the limit."""
    rows = table.select(*[F.col(c).cast("string").alias(c) for c in columns]).filter(F.coalesce(F.col(columns[0]) != "", F.lit(False)))
    size = rows.agg(F.coalesce(F.sum(sum((F.length(F.coalesce(c, F.lit(""))) for c in columns), F.lit(0))), F.lit(0))).first()[0]
    if size > MOST_CHARS:
        raise ValueError(f"a dictionary of {size} characters; {MOST_CHARS} are allowed")
    return sorted({tuple(r) for r in rows.collect()}, key=lambda r: tuple(x or "" for x in r))


class Trie:
    """Entries by their characters; of equal entries the first value in order counts."""

    def __init__(self, entries: list[tuple[str, str | None]]):
        self.root: dict = {}
        for key, value in entries:
            node = self.root
            for c in key:
                node = node.setdefault(c, {})
            node.setdefault(_END, key if value is None else value)

    def longest(self, text: str, at: int) -> tuple[int, str] | None:
        """The end and the value of the longest entry that begins at a place."""
        node, found = self.root, None
        for i in range(at, len(text)):
            node = node.get(text[i])
            if node is None:
                break
            if _END in node:
                found = i + 1, node[_END]
        return found

    def pieces(self, text: str) -> list[str]:
        """The values of the entries met, and each other character by itself."""
        out, at = [], 0
        while at < len(text):
            end, value = self.longest(text, at) or (at + 1, text[at])
            out.append(value)
            at = end
        return out

    def words(self, text: str) -> list[str]:
        """The text's runs of letters, marks and digits, replaced where a whole run is an entry, and all between them."""
        out, at = [], 0
        while at < len(text):
            end = at + 1
            if _inside(text[at]):
                while end < len(text) and _inside(text[end]):
                    end += 1
                run = text[at:end]
                found = self.longest(run, 0)
                out.append(found[1] if found and found[0] == len(run) else run)
            else:
                out.append(text[at])
            at = end
        return out


def _inside(c: str) -> bool:
    return unicodedata.category(c)[0] in "LMN"


def _step(rows: list[tuple], use: Callable[[Trie, str], str], context) -> Step:
    shared = context.broadcast(rows)
    made: list[Trie] = []  # a worker's own copy, filled by its first batch

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        if not made:
            made.append(Trie(shared.value))
        return texts.map(lambda t: use(made[0], t), na_action="ignore")

    return lambda text: run(text.cast("string"))


def word_breaker(words: DataFrame, word: str = "word") -> Step:
    """A step that puts a space between the words of a text without spaces: the longest word at each place, else one character."""
    rows = [(w, None) for (w,) in _bounded(words, word)]
    return _step(rows, lambda trie, text: " ".join(trie.pieces(text)), words.sparkSession.sparkContext)


def spoken(pairs: DataFrame, written: str = "written", said: str = "said", whole_words: bool = False) -> Step:
    """A step that replaces what is written by how it is said: readings of characters, or (whole_words) stressed or pointed
    forms of words. A null form leaves its entry as it is."""
    use = (lambda trie, text: "".join(trie.words(text))) if whole_words else (lambda trie, text: "".join(trie.pieces(text)))
    return _step(_bounded(pairs, written, said), use, pairs.sparkSession.sparkContext)


def glyph_codes(glyphs: DataFrame, glyph: str = "glyph", code: str = "code", place: str = "place") -> Step:
    """A step that spells a letter without case (Lo) by its code's characters, `[cj_x]` each, and `[cj_.]`.

    Of glyphs that share a code the one at the least place has the code alone, others its ordinal from 1 besides.
    """
    seen: dict[str, int] = {}
    codes: dict[str, str] = {}
    for key, own, _ in sorted(_bounded(glyphs, glyph, code, place), key=lambda r: (int(r[2] or 0), r[0])):
        n = seen[own] = seen.get(own, -1) + 1
        codes.setdefault(key, "".join(f"[cj_{c}]" for c in f"{own}{n or ''}") + "[cj_.]")
    rows = [(k, v) for k, v in codes.items() if len(k) == 1 and unicodedata.category(k) == "Lo"]
    return _step(rows, lambda trie, text: "".join(trie.pieces(text)), glyphs.sparkSession.sparkContext)


def chinese(words: DataFrame, glyphs: DataFrame) -> Step:
    """Words apart, then glyphs as codes."""
    cut, spell = word_breaker(words), glyph_codes(glyphs)
    return lambda text: spell(cut(text))
