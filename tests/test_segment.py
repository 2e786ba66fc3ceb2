"""Dictionary steps against brute force and literals."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lectern.functions import multilingual, segment, tables
from lectern.functions import text as T


def brute(text, entries):
    """The longest entry at each place, found by trying all."""
    out, at = [], 0
    while at < len(text):
        best = max((w for w in entries if text.startswith(w, at)), key=len, default=text[at])
        out.append(best)
        at += len(best)
    return out


def test_longest_match_against_brute_force(spark):
    rng = random.Random(1)
    words = {"".join(rng.choice("ab國語") for _ in range(rng.randrange(1, 6))) for _ in range(40)}
    texts = ["".join(rng.choice("ab國語c ") for _ in range(rng.randrange(0, 60))) for _ in range(80)] + [None, "", "zz"]
    table = spark.createDataFrame([(w, 1) for w in words] + [(None, 1), ("", 1), (next(iter(words)), 2)], "word string, n long")
    cut = segment.word_breaker(table)
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").withColumn("cut", cut(F.col("t"))).collect()
    for r in got:
        assert r["cut"] == (None if r["t"] is None else " ".join(brute(r["t"], words)))
    assert spark.createDataFrame([("ab",)], "t string").select(segment.word_breaker(table.limit(0))(F.col("t"))).first()[0] == "a b"


def test_words_as_they_are_said(spark):
    pairs = spark.createDataFrame([("замок", "за́мок"), ("дом", "до́м"), ("мир", None)], "written string, said string")
    texts = spark.createDataFrame([("замок, дом и домик; мир!",)], "t string")
    assert texts.select(segment.spoken(pairs, whole_words=True)(F.col("t"))).first()[0] == "за́мок, до́м и домик; мир!"
    kana = spark.createDataFrame([("日本", "にほん"), ("日", "ひ"), ("本", "ほん")], "written string, said string")
    assert spark.createDataFrame([("日本の本と日",)], "t string").select(segment.spoken(kana)(F.col("t"))).first()[0] == "にほんのほんとひ"


def test_prompts_of_a_language_without_spaces(spark):
    words = spark.createDataFrame([("中國",), ("人",), ("中",)], "word string")
    glyphs = spark.createDataFrame([("中", "l", 0), ("國", "wirm", 1), ("囯", "wirm", 2), ("人", "o", 3), ("A", "a", 4)], "glyph string, code string, place long")
    prompts = spark.createDataFrame([("<zh>[START]中國人A[STOP]",), ("<zh>囯",), ("<en>中",), (None,)], "prompt string")
    steps = dict(multilingual.STEPS) | {"zh": segment.chinese(words, glyphs)}
    got = [r["normalized"] for r in multilingual.normalize_multilingual(prompts, steps=steps).collect()]
    code = lambda c: "".join(f"[cj_{x}]" for x in c) + "[cj_.]"
    assert got == [f"[START][zh]{code('l')}{code('wirm')}[SPACE]{code('o')}[SPACE]a[STOP]", f"[zh]{code('wirm1')}", "[en]中", None]


def test_dictionaries_have_a_limit(spark, monkeypatch):
    monkeypatch.setattr(segment, "MOST_CHARS", 5)
    with pytest.raises(ValueError, match=re.escape("6 characters")):
        segment.word_breaker(spark.createDataFrame([("abc",), ("def",)], "word string"))


def test_table_function_equals_the_column(spark):
    """Hard texts in SQL by lateral join, at several limits, null and blank ones too."""
    rng = random.Random(5)
    bits = ["Dr. Rivera", "e.g.", "J. R.", "said:", "\"Sit down!\"", "then;", "x" * 70, "y" * 300, "—", "« long", "»", "…", "3.5", "p.m.", "Really?!", "\n", "\n\n", "\u00a0", "a,b", "word", "end.", "mr.)", "A.", "...", "é.”"]
    texts = [" ".join(rng.choice(bits) for _ in range(rng.randrange(0, 90))) for _ in range(150)] + [None, "", " \n ", "Mr. " * 90 + "said \"" + "so " * 60 + "\"."]
    tables.register(spark)
    spark.createDataFrame(list(enumerate(texts)), "i int, t string").createOrReplaceTempView("hard_texts")
    for limit in (40, 280):
        got = spark.sql(f"select i, sort_array(collect_list(struct(pos, chunk))).chunk c from hard_texts, lateral chunk_text(t, {limit}) group by i")
        want = spark.table("hard_texts").select("i", T.pack_chunks(T.sentences(F.col("t")), limit).alias("c")).filter("size(c) > 0")
        assert {r["i"]: r["c"] for r in got.collect()} == {r["i"]: r["c"] for r in want.collect()}
