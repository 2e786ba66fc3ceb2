"""Books and WAV files that the tests write, and visible text by literals for its rules."""

import wave
import zipfile

import numpy as np
from conftest import SF
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401
from lectern.registry import QUERIES
from lectern.sources import files

CONTAINER = '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf"/></rootfiles></container>'
OPF = """<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title> The  Book </dc:title><dc:creator>A</dc:creator><dc:creator>B</dc:creator><meta name="cover" content="pic"/></metadata>
<manifest><item id="two" href="b.xhtml" media-type="application/xhtml+xml"/><item id="one" href="a%20a.xhtml" media-type="application/xhtml+xml"/><item id="pic" href="p.png" media-type="image/png"/><item id="bad" href="../../x" media-type="text/html"/></manifest>
<spine><itemref idref="one"/><itemref idref="none"/><itemref idref="two"/></spine></package>"""


def test_books(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "x.epub", "w") as z:
        for name, text in (("META-INF/container.xml", CONTAINER), ("OEBPS/content.opf", OPF), ("OEBPS/a a.xhtml", "<p>First <b>o</b>ne</p><nav>no</nav>"), ("OEBPS/b.xhtml", "<h1>Two</h1><p>&amp;</p>"), ("OEBPS/p.png", "")):
            z.writestr(name, text)
    (tmp_path / "broken.epub").write_bytes(b"nothing")
    books = files.read_books(spark, str(tmp_path))
    assert [r["text"] for r in files.readable_chapters(books).orderBy("pos").collect()] == ["First one", "Two\n\n&"]
    m = files.book_metadata(books).collect()
    assert [(r["title"], r["authors"], r["language"]) for r in m] == [("The Book", ["A", "B"], None)]
    assert files.cover(books).first()["item"] == "OEBPS/p.png"
    assert books.filter("kind = 'reject'").count() == 2


def test_large_and_broken_books(spark, tmp_path):
    """Documents of the spine have limits, one by one and together; what isn't read has none; broken archives are told."""
    texts = {"OEBPS/a a.xhtml": "<p>" + "a" * 93 + "</p>", "OEBPS/b.xhtml": "<p>" + "b" * 193 + "</p>", "OEBPS/p.png": "x" * 5000}
    for name in ("fits", "cut", "locked"):
        with zipfile.ZipFile(tmp_path / f"{name}.epub", "w", zipfile.ZIP_DEFLATED) as z:
            for member, text in (("META-INF/container.xml", CONTAINER), ("OEBPS/content.opf", OPF.replace("<dc:title>", "<dc:description>About it</dc:description><dc:date>1901</dc:date><dc:title>")), *texts.items()):
                z.writestr(member, text)
    whole = (tmp_path / "cut.epub").read_bytes()
    (tmp_path / "cut.epub").write_bytes(whole[: len(whole) // 2])
    data = bytearray(whole)
    data[6] |= 1  # the first entry is marked as encrypted
    data[data.index(b"PK\x01\x02") + 8] |= 1
    (tmp_path / "locked.epub").write_bytes(bytes(data))

    def rejects(**limits):
        rows = files.read_books(spark, str(tmp_path), **limits).filter("kind = 'reject' and pos = 0").collect()
        return {r["book"].rsplit("/", 1)[-1]: r["name"] or r["value"] for r in rows}

    assert set(rejects(document_bytes=200, book_bytes=300)) == {"cut.epub", "locked.epub"}
    assert set(rejects(document_bytes=199)) == set(rejects(book_bytes=299)) == {"cut.epub", "locked.epub", "fits.epub"}
    meta = files.book_metadata(files.read_books(spark, str(tmp_path), "fits.epub")).first()
    assert (meta["description"], meta["date"]) == ("About it", "1901")


def test_wavs(spark, tmp_path):
    for name, channels, n in (("good", 1, 50), ("stereo", 2, 50), ("empty", 1, 0)):
        with wave.open(str(tmp_path / f"{name}.wav"), "wb") as w:
            w.setnchannels(channels), w.setsampwidth(2), w.setframerate(1000)
            w.writeframes(np.arange(n * channels, dtype="<i2").tobytes())
    whole = (tmp_path / "good.wav").read_bytes()
    (tmp_path / "cut.wav").write_bytes(whole[:-20])
    (tmp_path / "none.wav").write_bytes(b"x")
    rows = {r["path"].rsplit("/", 1)[-1][:-4]: r for r in files.read_wavs(spark, str(tmp_path), 1000).collect()}
    assert rows["good"]["samples"] == list(range(50)) and rows["good"]["reason"] is None
    assert [rows[k]["reason"] for k in ("stereo", "empty", "cut")] == ["channels", "empty", "truncated"]
    assert rows["none"]["reason"].startswith("unreadable") and rows["cut"]["samples"] is None


def test_members(spark):
    rows = [("a%20b.html#x", "OEBPS/a b.html"), ("../c+d/./e", "c+d/e"), ("../../up", None), ("/etc", None), ("x/../y", "OEBPS/y")]
    got = spark.createDataFrame(rows, "h string, want string").select(files.safe_member(F.lit("OEBPS"), F.col("h")).alias("got"), "want")
    assert all(r["got"] == r["want"] for r in got.collect())


VISIBLE = [
    ("<p>one</p><p>two  three</p>", ["one", "two three"]),
    ("a<br>b<br/>c", ["a", "b", "c"]),
    ("<nav>skip<nav>deep</nav>still</nav>seen", ["seen"]),
    ("<nav>never closed <p>so nothing follows</p>", []),
    ("</nav>stray ends do no harm<nav>x</nav>", ["stray ends do no harm"]),
    ("<svg/>an empty element hides nothing", ["an empty element hides nothing"]),
    ("<script>if (a < b) { x('</p>') }</script>left<style>p > a {}</style> over", ["left over"]),
    ("<div>body</div><footer>and its footer</footer>", ["body", "and its footer"]),
    ("<b>in</b>line <i>marks</i> &amp; &eacute;", ["inline marks & é"]),
    ("<!-- note <p>no</p> -->text<?x y?><!DOCTYPE html>", ["text"]),
    ("1 < 2", ["1 < 2"]),
    ("", []),
    (None, []),
]


def test_visible_text(spark):
    rows = spark.createDataFrame([(i, html) for i, (html, _) in enumerate(VISIBLE)], "i long, html string")
    got = {r["i"]: r["lines"] for r in rows.select("i", files.visible_text(F.col("html")).alias("lines")).collect()}
    assert got == {i: lines for i, (_, lines) in enumerate(VISIBLE)}


def test_visible_text_of_pages(spark):
    """The pages' lines hold no markup, and every page gives its heading once."""
    rows = QUERIES["visible_text"](spark, SF).collect()
    assert rows and all(r["line"] == " ".join(r["line"].split()) and "</" not in r["line"] and "track(" not in r["line"] for r in rows)
