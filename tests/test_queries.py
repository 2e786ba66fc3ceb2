"""Every query with a SQL twin gives DuckDB's rows; literals for what SQL can't say."""

import pytest
from conftest import SF, same_rows
from pyspark.sql import functions as F

from lectern.functions import tables as table_functions
from lectern.functions import text as T
from lectern.operators import intervals, signals, vectors
from lectern import queries as Q
from lectern.plans import status, timeline
import __spark_entry__  # noqa: F401
from lectern.registry import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_twin(spark, duck, name):
    same_rows(QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLE_SQL[name]).df())


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first()[0]


def test_sentences(spark):
    assert one(spark, T.sentences, 'Prof. Okoye paid 7.25 at the gate. "Wait here?" Nobody did.') == ["Prof. Okoye paid 7.25 at the gate.", '"Wait here?"', "Nobody did."]
    assert one(spark, T.sentences, "") == []
    assert one(spark, T.sentences, "One.\n\nTwo") == ["One.", "Two"]


def test_long_word(spark):
    parts = one(spark, lambda t: T.split_oversized(t, 100), "Two words " + "q" * 230 + "!")
    assert parts == ["Two words", "q" * 100, "q" * 100, "q" * 30 + "!"]


def test_dialogue_stands_alone(spark):
    quoted = "“" + "word " * 18 + "end.”"
    assert len(one(spark, lambda t: T.pack_chunks(T.sentences(t), 280), f"Before it. {quoted} After it.")) == 3


def test_initials(spark):
    assert one(spark, T.expand_initials, "Near A.B.C. Hall, N.Z. coast") == "Near A B C Hall, N Z coast"


def test_clean(spark):
    row = T.clean_text(spark.createDataFrame([('She read “no”[7] in the note.41 left/right • up .',)], "text string")).first()
    assert row["cleaned"] == "She read no  in the note. left right   up."
    assert [row[c] for c in T.CHANGES] == [2, 0, 2, 0, 1, 0, 2]


def test_clean_order_and_counts(spark):
    texts = ["Q.R.S. Tam;\tsaid² ok\u0007 …", "", "  ", None, "x.A.B.C. and U.K.", "word.7} end", "tail.12"]
    rows = T.clean_text(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")).orderBy("i").collect()
    assert [r["cleaned"] for r in rows] == ["Q R S Tam, said  ok,", "", "  ", None, "x.A B C and U K", "word.7  end", "tail."]
    assert [rows[0][c] for c in T.CHANGES] == [1, 1, 0, 2, 2, 1, 0]
    assert [rows[4]["initialisms"], rows[5]["symbols"], rows[5]["footnotes"], rows[6]["footnotes"]] == [2, 1, 0, 1]
    assert all(rows[3][c] is None for c in T.CHANGES) and not any(rows[1][c] for c in T.CHANGES)


def test_first_letter_is_raised_to_one_letter(spark, duck):
    texts = ["ßachzu ein", "ŉ x", "ﬁn", "ᾳ", "ᾠ b", "ǆ", "ﬗ", "ä", "Ab", "1", "", None]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string").createOrReplaceTempView("raised")
    got = [r[0] for r in spark.table("raised").orderBy("doc_id").select(T.punc_norm(F.col("text"))).collect()]
    assert got[:8] == ["ẞachzu ein.", "ŉ x.", "ﬁn.", "ᾼ.", "ᾨ b.", "Ǆ.", "ﬗ.", "Ä."]
    sql = Q._norm_sql("t")
    assert got == [r[0] for r in duck.execute(f"select {sql} from (select unnest(?::varchar[]) t)", [texts]).fetchall()]


def test_prompt_of_a_text_that_begins_with_sharp_s(spark, duck, tmp_path):
    duck.sql("copy (select 1 doc_id, 'ßheit, nicht' \"text\", 'de' lang) to '%s/documents.parquet'" % tmp_path)
    want = duck.sql(ORACLE_SQL["wrap_prompt"].replace("from documents", f"from '{tmp_path}/documents.parquet'")).df()
    same_rows(QUERIES["wrap_prompt"](spark, str(tmp_path)).toPandas(), want)


@pytest.mark.parametrize("name", ["wrap_prompt", "clean_chars"])
def test_prompts_of_rare_code_points(spark, duck, tmp_path, name):
    texts = ["noted .7 .8", "a.1 !2 ?3", "𠀀² ok", "z𐄇³. 𝟗.7 𝟗x", "a\u0378b\uffff", "\u0870 x", "ⱟ x\u1ac1", "ƛ x", "ɤ x", "a\u0890\U00011f50.5", "\U0001f600 .4 \u200b", "x²\n³ A.B. 𠀀A.B."]
    duck.execute(f"copy (select row_number() over () doc_id, t \"text\", 'de' lang from (select unnest(?::varchar[]) t)) to '{tmp_path}/documents.parquet'", [texts])
    want = duck.sql(ORACLE_SQL[name].replace("from documents", f"from '{tmp_path}/documents.parquet'")).df()
    same_rows(QUERIES[name](spark, str(tmp_path)).toPandas(), want)


def balanced(text):
    """All cuts tried, by places in the text."""
    t = " ".join(text.split())
    ends = [i for i in range(1, len(t)) if t[i] == " " and t[i - 1] in ".!?"]  # the test's texts have no abbreviations
    after = [i + 1 for i in range(1, len(t)) if t[i] == " " and t[i - 1] in ",;:—–"]
    spaces = [i for i in range(len(t)) if t[i] == " "]
    if ends:
        at = min(ends, key=lambda i: abs(i - (len(t) - i - 1)))
    elif after or spaces:
        at = min(after or spaces, key=lambda i: abs(2 * i - len(t)))
    else:
        return [t]
    return [t[:at].strip(), t[at:].strip()]


def test_recovery_split(spark):
    texts = ["Boats left. Rain came early! Who stayed?", "a long wharf, with nets; and ropes", "one two", "single", "", "  ", "tie ab ba tie", "A, b, c, d", "Up he went – down\n\nshe came",
             "Salt.  Salt. Salt. Salt.", "word " * 400, "Sea wall: " * 60]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "i int, t string").select("i", T.recovery_split(F.col("t")).alias("x")).orderBy("i").collect()
    assert [r["x"] for r in rows] == [*map(balanced, texts), None]


def test_punc_norm(spark):
    assert one(spark, T.punc_norm, "") == T.NO_TEXT
    assert one(spark, T.punc_norm, "so… be it") == "So,  be it."


def test_intervals_of_clips(spark):
    clips = spark.createDataFrame([(1, 10), (2, 8), (3, 0), (4, 5)], "clip long, n long")
    rows = [(1, -3, 2), (1, 2, 4), (1, 7, 30), (1, 7, 30), (1, 5, 5), (1, 12, 15), (2, 9, 20), (2, None, 3), (7, 0, 4)]
    merged = intervals.merge_intervals(spark.createDataFrame(rows, "clip long, start long, end long"), clips)
    assert {tuple(r) for r in merged.select("clip", "start", "end").collect()} == {(1, 0, 4), (1, 7, 10)}
    assert {tuple(r) for r in intervals.interval_gaps(merged, clips).collect()} == {(1, 4, 7), (2, 0, 8), (4, 0, 5)}
    assert intervals.interval_gaps(merged.filter("false"), clips.filter("false")).count() == 0


def test_frame_signal(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0, 5.0]), (2, [1.0]), (3, []), (4, None), (5, [6.0, 7.0])], "i int, samples array<double>")
    got = [tuple(r) for r in signals.frame_signal(rows, 2).orderBy("i", "frame_no").collect()]
    assert got == [(1, 0, [1.0, 2.0]), (1, 1, [3.0, 4.0]), (5, 0, [6.0, 7.0])]


def test_size_caps(spark):
    rows = [("a", 1, 4), ("a", 20_001, 5), ("a", 2, None), ("b", 1, 11), ("b", 2, 1), ("c", 5, 6), ("c", 10_007, 6), ("c", 9_999, 8), (None, 1, 3), (None, 2, 10)]
    got = {tuple(r) for r in status.size_caps(spark.createDataFrame(rows, "book string, pos long, bytes long"), 10, 19).select("book", "pos", "running", "over", "book_failed").collect()}
    want = set()
    for book in {r[0] for r in rows}:
        own, total = sorted(r[1:] for r in rows if r[0] == book), 0
        found = [(p, total := total + (n or 0), (n or 0) > 10 or total > 19) for p, n in own]
        want |= {(book, *x, any(y[2] for y in found)) for x in found}
    assert got == want
    assert status.size_caps(spark.createDataFrame([], "book string, pos long, bytes long")).count() == 0


def test_trim_tokens(spark):
    long = [7, *range(10, 3000)]
    rows = spark.createDataFrame([(1, [5, 7, 1, 99, 2, 8, 3]), (2, [1, 2]), (3, []), (4, None), (5, long), (6, [8, 1, 7, 2])], "i int, t array<int>")
    got = [r["x"] for r in rows.select("i", vectors.trim_tokens(F.col("t"), 7, 8, 5000).alias("x")).orderBy("i").collect()]
    assert got == [[1, 99, 2], [1, 2], [], None, long[1:1001], []]


def test_runs_against_loops(spark):
    rows = [(c, i, (i * 7 + c) % 5 < 2, (i * 3 + c) % 7 < 5) for c in range(3) for i in range(60)]
    frames = spark.createDataFrame(rows, "clip long, frame_no long, flag boolean, support boolean")
    expected = set()
    for c in range(3):
        flag, support = [r[2] for r in rows if r[0] == c], [r[3] for r in rows if r[0] == c]
        spans, i = [], 0
        while i < 60:
            j = i
            while j < 60 and flag[j]:
                j += 1
            if j - i >= 2:
                a, b = i, j
                while a and support[a - 1]:
                    a -= 1
                while b < 60 and support[b]:
                    b += 1
                if spans and a <= spans[-1][1]:
                    spans[-1] = (min(a, spans[-1][0]), max(b, spans[-1][1]))
                else:
                    spans.append((a, b))
            i = max(j, i + 1)
        expected |= {(c, *s) for s in spans}
    got = {tuple(r) for r in intervals.expand_runs(frames, 2).select("clip", "start", "end").collect()}
    # support frames inside a run may be off: a run's own frames are never cut
    assert got == expected


def test_segments_tile_the_timeline(spark):
    rows = {}
    for r in QUERIES["balance_segments"](spark, SF).collect():
        rows.setdefault(r["book"], []).append((r["segment_no"], r["first_entry"], r["last_entry"]))
    for parts in rows.values():
        parts.sort()
        assert parts[0][1] == 0
        assert all(a[2] + 1 == b[1] and a[1] <= a[2] for a, b in zip(parts, parts[1:]))


def test_timeline_of_nothing(spark):
    empty = spark.createDataFrame([], "book long, pos long, chapter long, samples long")
    assert timeline.chapter_markers(timeline.timeline(empty, 1000), 1000).count() == 0


def test_rest_works_without_training_data(monkeypatch):
    import builtins

    import __spark_entry__

    real = builtins.__import__

    def without(name, *args, **kwargs):
        if name.startswith(("corpus_pipeline", "lectern.llm")):
            raise ModuleNotFoundError(name, name=name)
        return real(name, *args, **kwargs)

    monkeypatch.setattr(builtins, "__import__", without)
    assert "corpus_summary" in __spark_entry__.queries()


def test_sentences_and_chunks_by_patterns_are_those_of_the_rules(spark):
    """Against the table function's plain code, and without a fold where texts come from sentences()."""
    texts = ["Mr. A. B. C. D. E. F. G. H. I. J. x.y.z.a.b.c.d.e.f.g.h. End. no.’ He e.g. said: \"No.\" Yes!) done", " \n\t a  b  c.\u0085 D?! \n \n E.. f ...no. g x.no. h No.) i", "", " ", "\n",
             "One two. " * 60, "w" * 450 + " b, " + "clause of words " * 20 + "; c", ("“Said " + "very " * 30 + "long.” ") * 3 + "After.", "é😀 " * 150 + ". 😀b. c", "z" * 200 + ". " + "y" * 400]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for limit in (1, 20, 200):
        got = [r.c for r in df.orderBy("i").select(T.pack_chunks(T.sentences(F.col("t")), limit).alias("c")).collect()]
        want = [list(table_functions._packed(((p, len(s) >= 80 and table_functions._SAID.search(s) is not None, False) for s in table_functions._sentences(t) for p in ([s] if len(s) <= limit else table_functions._packed(table_functions._parts(s, limit), limit))), limit)) for t in texts]
        assert got == want
    said = [r.c for r in df.orderBy("i").select(T.sentences(F.col("t")).alias("c")).collect()]
    assert said == [list(table_functions._sentences(t)) for t in texts]
    tabs = spark.createDataFrame([(["a\tb", "c\nd", "e"],)], "s array<string>").select(T.pack_chunks(F.col("s"), 5).alias("c")).first().c
    assert tabs == ["a\tb", "c\nd e"]


def test_books_are_chunked_once_for_their_manifest(spark):
    plan = QUERIES["book_manifest"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.split("\n") if "Filter" in x and "lambda" in x]


def test_a_prompt_is_normalised_once(spark):
    """The pass over the marks stands once in the plan, not in each branch that adds a full stop or doesn't (F10)."""
    out = spark.createDataFrame([(" a  \n b:  ",), ("c!",), ("",)], "t string").select(T.punc_norm(F.col("t")).alias("x"))
    assert [r[0] for r in out.collect()] == ["a b,", "C!", T.NO_TEXT]
    kept = spark.range(1).select(T.punc_norm(F.col("id").cast("string")).alias("x"))
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("rtrim(") == 1
