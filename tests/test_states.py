"""State files, replaced results, recovered texts and multilingual prompts, against literals and brute force."""

import unicodedata
import zlib

import pytest
from conftest import SF
from pyspark.sql import functions as F

import lectern.recovery_queries as queries
from lectern.functions import multilingual
from lectern.functions import text as T
from lectern.plans import recovery
from lectern.sources import states

GOOD = '{"schema_version": 3, "detector_version": 7, "verified_clean_chunks": {"4": {"size": 90, "mtime_ns": 0}, "012": {"size": 8, "mtime_ns": 1700000000000000000}}}'
BROKEN = [
    None, "", "{", "[1]", GOOD.replace("3,", "4,"), GOOD.replace("3,", '"3",'), GOOD.replace("7,", "7.5,"), GOOD.replace("}}}", "}}, \"more\": 1}"), GOOD.replace("90", "0"), GOOD.replace("90", "true"),
    GOOD.replace("90", '"90"'), GOOD.replace("90", "9.5"), GOOD.replace('"mtime_ns": 0', '"mtime_ns": -1'), GOOD.replace('"mtime_ns": 0', '"m": 0'), GOOD.replace('"4"', '"-4"'), GOOD.replace('"4"', '"x"'), GOOD.replace('"4"', '"12"'), GOOD.replace('"size": 90,', ""),
    '{"schema_version": 3, "detector_version": 7, "verified_clean_chunks": [4]}', '{"schema_version": 3, "verified_clean_chunks": {}}',
]


def test_verified_entries(spark):
    files = spark.createDataFrame([("good", GOOD), ("none", '{"schema_version": 3, "detector_version": 7, "verified_clean_chunks": {}}')] + [(f"b{i}", x) for i, x in enumerate(BROKEN)], "project string, content string")
    got = states.verified_entries(files, 3, 7)
    assert {tuple(r) for r in got.collect()} == {("good", 4, 90, 0), ("good", 12, 8, 1700000000000000000)}
    assert states.verified_entries(files.limit(0), 3, 7).count() == 0


def test_text_files(spark, tmp_path):
    for name in ("a b", "c+d"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "scan.json").write_text('{\n"x": 1}\n')
    got = states.text_files(spark, f"{tmp_path}/*/scan.json")
    assert {tuple(r) for r in got.collect()} == {("a b", '{\n"x": 1}\n'), ("c+d", '{\n"x": 1}\n')}


def test_project_states(spark):
    m = spark.createDataFrame([("a", '{"completed_chunks": 1, "scheduled_chunks": 9, "model_id": "m2"}'), ("b", '{"completed_chunks": 2, "scheduled_chunks": 8}'), ("c", '{"output_file": "x.m4b", "completed_chunks": 5}'), ("d", "{"), ("e", None), ("f", '{"model_id": "gone", "completed_chunks": 4, "scheduled_chunks": 6}')], "project string, content string")
    p = spark.createDataFrame([("a", '{"completed_chunks": 3, "scheduled_chunks": "7"}'), ("b", '{"completed_chunks": "?", "scheduled_chunks": 1}'), ("f", "nothing"), ("z", "{}")], "project string, content string")
    got = {r["project"]: tuple(r)[1:] for r in states.project_states(m, p, "m1", ["m1", "m2"]).collect()}
    assert got == {"a": (3, 7, "m2", None), "b": (2, 8, "m1", None), "c": (5, None, "m1", "complete"), "d": (None, None, "m1", "unreadable"), "e": (None, None, "m1", "unreadable"), "f": (4, 6, "gone", "model")}


def test_replace_result(spark, tmp_path):
    at = f"{tmp_path}/result"
    assert states.current_result(spark, at) is None
    assert states.replace_result(spark.range(3), at) == 1
    assert states.replace_result(states.current_result(spark, at).filter("id > 0"), at) == 2
    with pytest.raises(Exception):
        states.replace_result(spark.range(5).select(F.raise_error(F.lit("no"))), at)
    assert [r[0] for r in states.current_result(spark, at).orderBy("id").collect()] == [1, 2]
    states.drop_versions(spark, at)
    assert not (tmp_path / "result/version=1").exists() and states.current_result(spark, at).count() == 2


def test_recovery_resolve(spark):
    made = [(f"{n}-{k}", " ".join(f"{'Pause, then ' * (i % 3)}say {i} of {k}." for i in range(n))) for n in (1, 2, 3, 9, 20, 40) for k in range(20)]
    chunks = spark.createDataFrame([*made, ("null", None), (None, "One. Two.")], "id string, text string")
    got = {r["id"]: tuple(r)[1:] for r in recovery.resolve(chunks, queries.attempts(chunks)).collect()}

    known, new = {}, {t for _, t in made} | {""}
    while new:
        rows = spark.createDataFrame([(t,) for t in new], "t string").select("t", F.size(T.sentences(F.col("t"))), T.recovery_split(F.col("t"))).collect()
        known |= {r[0]: (r[1], r[2]) for r in rows}
        new = {p for r in rows for p in r[2]} - set(known)

    def verdict(id, path, attempt):
        drawn = zlib.crc32(f"{id}/{path}/{attempt}".encode()) % 10
        return "clean" if drawn < 4 else "issue" if drawn < 8 else "invalid"

    def part(id, path, text):
        """warned, pieces, silent of a text or a part."""
        if path and "clean" in (verdict(id, path, 1), verdict(id, path, 2)):
            return False, 1, 0
        n, parts = known[text]
        if n <= 1 or len(parts) < 2 or (path and (len(path) >= 4 or max(map(len, parts)) >= len(text))):
            return True, 1, int(verdict(id, path, 2) == "invalid")
        below = [part(id, path + str(i + 1), p) for i, p in enumerate(parts)]
        pieces, silent, joined = sum(b[1] for b in below), sum(b[2] for b in below), verdict(id, path, 0)
        return joined != "clean" or any(b[0] for b in below), pieces, pieces if not path and joined == "invalid" else silent

    def whole(id, text):
        if verdict(id, "", 1) == "clean":
            return "clean", False, False, 1, 0
        if verdict(id, "", 2) == "clean":
            return "fixed", True, False, 1, 0
        warned, pieces, silent = part(id, "", text)
        return ("retained" if warned else "fixed"), True, warned, pieces, silent

    want = {id: whole(id, text) for id, text in made} | {"null": whole("null", "")}
    assert got == want
    assert {w[0] for w in want.values()} == {"clean", "fixed", "retained"} and max(w[3] for w in want.values()) > 4
    assert recovery.resolve(chunks.limit(0), queries.attempts(chunks.limit(0))).count() == 0


def test_normalize_multilingual(spark):
    cases = {
        "<fr>[START]Été À la MER[STOP]": "[START][fr]" + unicodedata.normalize("NFKD", "été[SPACE]à[SPACE]la[SPACE]mer") + "[STOP]",
        "<KO>x": "[ko]x", "<ko>[START] 한 [STOP]": "[START][ko]" + unicodedata.normalize("NFKD", "한") + "[STOP]", "No tag [STOP] here": "no[SPACE]tag[SPACE][stop][SPACE]here",
        "<de>A > B": "[de]a[SPACE]", "<>ﬁ": "fi", "<en": None, "": "", None: None, "[STOP]": "[STOP]",
    }
    rows = multilingual.normalize_multilingual(spark.createDataFrame([(k,) for k in cases], "t string"), "t").collect()
    assert {r[0]: r[1] for r in rows} == cases


def test_queries(spark):
    assert queries.recovery_resolve(spark, SF).count() == queries.chunks(spark, SF).count()
    n = spark.read.parquet(f"{SF}/documents.parquet").filter("text is not null and lang is not null").count()
    assert queries.normalize_multilingual(spark, SF).filter("normalized_md5 is not null").count() == n
