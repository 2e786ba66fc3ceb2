"""Replacing single characters: dictionary codes and Hangul syllables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: First code points of syllables, leading consonants, vowels and trailing consonants, and how many vowels and tails there are.
SYLLABLES, LEADS, VOWELS, TAILS = 0xAC00, 0x1100, 0x1161, 0x11A7
N_VOWELS, N_TAILS, N_SYLLABLES = 21, 28, 11172


def dictionary_code(text: Column, glyphs: Iterable[tuple[str, str]]) -> Column:
    """Each glyph of the dictionary becomes its code, and its ordinal among the glyphs of that code unless it is the first."""
    seen: dict[str, int] = {}
    codes: dict[str, str] = {}
    for glyph, code in glyphs:
        n = seen[code] = seen.get(code, -1) + 1
        codes[glyph] = f"{code}{n or ''}"
    table = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])
    return F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), "")


def _char(code: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE")


def decompose_hangul(text: Column) -> Column:
    """Hangul syllables as their letters, other characters unchanged, spaces trimmed at both ends."""

    def parts(c):
        i = F.ascii(c) - SYLLABLES
        tail = F.when(i % N_TAILS > 0, _char(TAILS + i % N_TAILS)).otherwise(F.lit(""))
        lead = _char(LEADS + F.floor(i / (N_VOWELS * N_TAILS)).cast("int"))
        vowel = _char(VOWELS + F.floor(i % (N_VOWELS * N_TAILS) / N_TAILS).cast("int"))
        return F.when((i >= 0) & (i < N_SYLLABLES), F.concat(lead, vowel, tail)).otherwise(c)

    return F.trim(F.array_join(F.transform(F.split(text, ""), parts), ""))
