"""Table functions for SQL: `select * from documents, lateral chunk_text(text, 280)`."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from lectern.functions.text import ABBREVIATIONS, DIALOGUE_MARKS, MAX_CHARS, WS

_CLOSERS = r"[\"'”’»)\]}]*\Z"
_END, _LONE, _STEM = re.compile(r"[.!?]" + _CLOSERS), re.compile(r"(?:^|[^.!?])\." + _CLOSERS), re.compile(r"([A-Za-z.]*)\." + _CLOSERS)
_INITIALS, _CLAUSE, _GAPS, _SAID = re.compile(r"[a-z](\.[a-z])*\Z"), re.compile(r"(?<=[,;:—–]) +"), re.compile(WS), re.compile(DIALOGUE_MARKS)


def _ends(word: str) -> bool:
    if not _END.search(word):
        return False
    found = _STEM.search(word)
    stem = found[1].lower() if found else ""
    return not (_LONE.search(word) and (stem in ABBREVIATIONS or _INITIALS.match(stem)))


def _sentences(text: str) -> Iterator[str]:
    for paragraph in re.split(r"\n+", text):
        held: list[str] = []
        for word in _GAPS.sub(" ", paragraph).split(" "):
            if word:
                held.append(word)
                if _ends(word):
                    yield " ".join(held)
                    held = []
        if held:
            yield " ".join(held)


def _packed(units: Iterator[tuple[str, bool, bool]], limit: int) -> Iterator[str]:
    """Units (text, alone, flush) joined by spaces, as text._greedy() joins them."""
    open_ = ""
    for text, alone, flush in units:
        if open_ and (alone or flush or len(open_) + 1 + len(text) > limit):
            yield open_
            open_ = ""
        if alone:
            yield text
        else:
            open_ = f"{open_} {text}" if open_ else text
    if open_:
        yield open_


def _parts(sentence: str, limit: int) -> Iterator[tuple[str, bool, bool]]:
    for clause in filter(None, _CLAUSE.split(sentence)):
        if len(clause) <= limit:
            yield clause, False, False
            continue
        for i, word in enumerate(filter(None, clause.split(" "))):
            if len(word) <= limit:
                yield word, False, i == 0
            else:
                yield from ((word[k : k + limit], True, False) for k in range(0, len(word), limit))


@udtf(returnType="pos int, chunk string")
class ChunkText:
    """The chunks of a text in order, by the rules of text.pack_chunks(); none of a null text or one without words."""

    def eval(self, text: str, limit: int = MAX_CHARS) -> Iterator[tuple[int, str]]:
        units = ((piece, len(s) >= 80 and _SAID.search(s) is not None, False) for s in _sentences(text or "") for piece in ([s] if len(s) <= limit else _packed(_parts(s, limit), limit)))
        yield from enumerate(_packed(units, limit))


def register(spark: SparkSession) -> None:
    """Makes chunk_text(text, limit) known to the session's SQL."""
    spark.udtf.register("chunk_text", ChunkText)
