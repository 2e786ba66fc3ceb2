"""Files as relations: visible text of pages, books in archives, signals in WAV files. A file is read within one task.

Files that can't be read become rows with a reason; they stop nothing.
"""

from __future__ import annotations

import html
import io
import posixpath
import re
import wave
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import unquote
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Elements whose content is not read, and elements that begin and end a line.
HIDDEN = ("head", "nav", "noscript", "script", "style", "svg")
BLOCKS = ("address", "article", "aside", "blockquote", "br", "div", "figcaption", "footer", "h1", "h2", "h3", "h4", "h5", "h6", "header", "li", "main", "p", "pre", "section", "table", "td", "th", "tr")

_TOKEN = re.compile(r"<!--.*?-->|<!doctype[^>]*>|<\?[^>]*>|<(script|style)\b[^>]*>.*?</\1\s*>|<(/?)([a-z][\w:-]*)[^>]*?(/?)>|([^<]+|<)", re.I | re.S)
TEXT_TYPES = ("application/xhtml+xml", "text/html")


def _lines(page: str) -> list[str]:
    out, depth = [], 0
    for token in _TOKEN.finditer(page):
        closing, tag, empty, data = token.group(2), (token.group(3) or "").lower(), token.group(4), token.group(5)
        if data is not None:
            out.append("" if depth else data)
        elif tag in HIDDEN:
            if not empty:
                depth = max(0, depth - 1) if closing else depth + 1
        elif tag in BLOCKS and not depth:
            out.append("\n")
    lines = (" ".join(x.split()) for x in html.unescape("".join(out)).splitlines())
    return [x for x in lines if x]


@F.pandas_udf(ArrayType(StringType()))
def visible_text(pages: pd.Series) -> pd.Series:
    """The non-empty lines that a reader sees: hidden elements share one depth, block elements break lines. Null: none."""
    return pd.Series([_lines(p) if p else [] for p in pages], dtype="object")


def safe_member(base: Column, href: Column) -> Column:
    """The archive member that href names, seen from the folder `base` (empty: the root); null where it leaves the root."""
    plain = F.url_decode(F.replace(F.substring_index(href, "#", 1), F.lit("+"), F.lit("%2B")))
    steps = F.filter(F.concat(F.split(base, "/"), F.split(plain, "/")), lambda s: ~s.isin("", "."))
    start = F.struct(F.array().cast("array<string>").alias("path"), F.lit(False).alias("out"))

    def step(state, s):
        up, path = s == "..", state["path"]
        shorter = F.slice(path, 1, F.greatest(F.size(path) - 1, F.lit(0)))
        return F.struct(F.when(up, shorter).otherwise(F.concat(path, F.array(s))).alias("path"), (state["out"] | (up & (F.size(path) == 0))).alias("out"))

    joined = F.aggregate(steps, start, step, lambda s: F.when(~s["out"], F.array_join(s["path"], "/")))
    return F.when(~plain.startswith("/"), joined)


def _local(element) -> str:
    return element.tag.rsplit("}", 1)[-1]


def _book(content: bytes, document_bytes: int, book_bytes: int) -> Iterator[tuple]:
    """Rows (kind, pos, name, value, type, properties, text) of an archive: its metadata, spine and items. Texts are those
    of the documents in the spine, or of all where there is no spine; their sizes are checked before one is unpacked."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        sizes = {i.filename: i.file_size for i in z.infolist()}
        root = next(e.get("full-path") for e in ElementTree.fromstring(z.read("META-INF/container.xml")).iter() if _local(e) == "rootfile")
        folder = posixpath.dirname(root)
        tree = list(ElementTree.fromstring(z.read(root)).iter())
        spine = [e.get("idref") for e in tree if _local(e) == "itemref"]
        items = {}
        for pos, e in enumerate(tree):
            if _local(e) == "item":
                member = posixpath.normpath(posixpath.join(folder, unquote((e.get("href") or "").split("#")[0])))
                items[pos] = e.get("id"), member, e.get("media-type") or "", e.get("properties") or ""
        last = {name: (member, media) for name, member, media, _ in items.values()}
        read = [last[i][0] for i in (spine or last) if i in last and last[i][0] in sizes and last[i][1] in (*TEXT_TYPES, "")]
        for member in read:
            if sizes[member] > document_bytes:
                raise TooLarge(f"a document of {sizes[member]} bytes: {member}")
        if sum(sizes[m] for m in read) > book_bytes:
            raise TooLarge(f"documents of {sum(sizes[m] for m in read)} bytes together")
        for pos, e in enumerate(tree):
            kind = _local(e)
            if kind == "itemref":
                yield "spine", pos, e.get("idref"), None, None, None, None
            elif kind == "meta" and e.get("name"):
                yield "meta", pos, e.get("name"), e.get("content"), None, None, None
            elif kind == "item":
                name, member, media, properties = items[pos]
                if member.startswith(("../", "/")):
                    yield "reject", pos, name, "path outside the archive", None, None, None
                    continue
                readable = member in read and media in (*TEXT_TYPES, "")
                text = "\n\n".join(_lines(z.read(member).decode("utf-8", "replace"))) if readable else None
                yield "item", pos, name, member, media, properties, text
            elif e.text and e.text.strip() and e.tag.startswith("{http://purl.org/dc/"):
                yield "data", pos, kind, " ".join(e.text.split()), None, None, None


# Bytes of a document and of all of a book's documents, and archives that can't be read
DOCUMENT_BYTES, BOOK_BYTES = 8 << 20, 64 << 20
UNREADABLE = (zipfile.BadZipFile, zipfile.LargeZipFile, zlib.error, EOFError, OSError, KeyError, StopIteration, NotImplementedError, RuntimeError, UnicodeError, ElementTree.ParseError)


class TooLarge(ValueError):
    """An archive with more text than is read."""


def read_books(spark: SparkSession, path: str, glob: str = "*.epub", document_bytes: int = DOCUMENT_BYTES, book_bytes: int = BOOK_BYTES) -> DataFrame:
    """book (path), kind, pos, name, value, type, properties, text of the archives in a folder.

    An archive that is broken or encrypted, lacks a part, or whose documents have more bytes than one or all may have
    (by the sizes that it states, before anything is unpacked) has one row of kind reject.

    Kinds: data (metadata by element name), meta, spine (references to item ids), item (member, its type and visible
    text) and reject (with the reason).
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for book, content in zip(batch["path"], batch["content"]):
                try:
                    rows = list(_book(bytes(content), document_bytes, book_bytes))
                except (TooLarge, *UNREADABLE) as e:
                    rows = [("reject", 0, None, f"{type(e).__name__}: {e}", None, None, None)]
                yield pd.DataFrame([(book, *r) for r in rows], columns=["book", "kind", "pos", "name", "value", "type", "properties", "text"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")
    return files.mapInPandas(parse, "book string, kind string, pos int, name string, value string, type string, properties string, text string")


def readable_chapters(books: DataFrame) -> DataFrame:
    """book, pos, text of the readable items in spine order, or in the order of the items where a book has no spine.

    Of items with one id the last counts; unknown references are skipped, repeated ones stay; empty texts go.
    """
    items = books.filter("kind = 'item'").groupBy("book", "name").agg(F.max_by(F.struct("type", "text", F.col("pos").alias("at")), "pos").alias("x")).select("book", "name", "x.*")
    spine = books.filter("kind = 'spine'").select("book", "name", "pos")
    listed = spine.join(items, ["book", "name"]).filter(F.col("type").isin(*TEXT_TYPES, "")).select("book", "pos", "text")
    rest = items.join(spine.select("book").distinct(), "book", "left_anti").filter(F.col("type").isin(*TEXT_TYPES)).select("book", F.col("at").alias("pos"), "text")
    return listed.unionByName(rest).filter("text != ''")


def book_metadata(books: DataFrame) -> DataFrame:
    """book, title (else the file's stem), authors in order, language, publisher, identifier, description, date."""
    data = books.filter("kind = 'data'")
    first = lambda name: F.min_by(F.when(F.col("name") == name, F.col("value")), F.when(F.col("name") == name, F.col("pos")))
    authors = F.transform(F.sort_array(F.collect_list(F.when(F.col("name") == "creator", F.struct("pos", "value")))), lambda x: x["value"])
    found = data.groupBy("book").agg(authors.alias("authors"), *[first(n).alias(n) for n in ("title", "language", "publisher", "identifier", "description", "date")])
    stem = F.regexp_extract("book", r"([^/]*?)(\.[^./]*)?$", 1)
    out = books.filter("kind != 'reject'").select("book").distinct().join(found, "book", "left")
    return out.withColumn("title", F.coalesce("title", stem))


def cover(books: DataFrame) -> DataFrame:
    """book, item: the item that the metadata names, else one marked cover-image, else an image whose id has `cover`."""
    named = books.filter("kind = 'meta' and name = 'cover'").select("book", F.col("value").alias("name"), F.lit(True).alias("named")).distinct()
    items = books.filter("kind = 'item'").join(named, ["book", "name"], "left")
    tier = F.when(F.col("named"), 0).when(F.array_contains(F.split("properties", r"\s+"), "cover-image"), 1).when(F.lower("name").contains("cover") & F.col("type").startswith("image/"), 2)
    return items.withColumn("tier", tier).filter("tier is not null").groupBy("book").agg(F.min_by("value", F.struct("tier", "pos")).alias("item"))


def read_wavs(spark: SparkSession, path: str, rate: int | None = None) -> DataFrame:
    """path, length, modified, frames, rate, samples (16-bit) and reason of the WAV files in a folder.

    The reason is null for a mono 16-bit file of the expected rate whose frames are all there; else samples are null.
    Files of no bytes at all are not listed: the reader of binary files passes over them.
    """

    def check(content: bytes) -> tuple:
        try:
            with wave.open(io.BytesIO(content)) as w:
                n, own = w.getnframes(), w.getframerate()
                data = w.readframes(n)
                faults = (("channels", w.getnchannels() != 1), ("width", w.getsampwidth() != 2), ("rate", rate is not None and own != rate), ("empty", n == 0), ("truncated", len(data) != n * w.getsampwidth() * w.getnchannels()))
        except (wave.Error, EOFError) as e:
            return None, None, None, f"unreadable: {e}"
        reason = next((name for name, bad in faults if bad), None)
        return n, own, None if reason else np.frombuffer(data, dtype="<i2"), reason

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [check(bytes(c)) for c in batch["content"]]
            out = pd.DataFrame(rows, columns=["frames", "rate", "samples", "reason"]).astype({"frames": "Int64", "rate": "Int64"})
            yield pd.concat([batch[["path", "length", "modified"]].reset_index(drop=True), out], axis=1)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(path)
    files = files.select("path", "length", F.col("modificationTime").alias("modified"), "content")
    return files.mapInPandas(parse, "path string, length long, modified timestamp, frames long, rate long, samples array<short>, reason string")
