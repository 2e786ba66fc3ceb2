"""Marker sheets of books as rows of lines, so that a book's size is no limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as T


def escape(value: Column) -> Column:
    """White space collapsed, and a backslash before each backslash, equals sign, semicolon and number sign."""
    return F.regexp_replace(T.collapse_ws(value), r"([\\=;#])", r"\\$1")


def marker_sheet(tags: DataFrame, markers: DataFrame) -> DataFrame:
    """book, line_no, line: the tags of a book (columns beside book; empty ones are left out), then its chapters.

    Markers are (book, chapter_no, start_ms, end_ms, title); a chapter's five lines are numbered from ten times its number.
    """
    names = [c for c in tags.columns if c != "book"]
    head = F.explode(F.array(*[F.struct(F.lit(i + 1).cast("long").alias("line_no"), escape(F.col(c).cast("string")).alias("v"), F.lit(c).alias("k")) for i, c in enumerate(names)]))
    head = tags.select("book", head.alias("x")).filter("x.v != ''").select("book", "x.line_no", F.concat("x.k", F.lit("="), "x.v").alias("line"))
    at = lambda c, k: F.concat(F.lit(k), F.col(c).cast("string"))
    block = F.array(F.lit("[CHAPTER]"), F.lit("TIMEBASE=1/1000"), at("start_ms", "START="), at("end_ms", "END="), F.concat(F.lit("title="), escape(F.coalesce("title", F.lit("")))))
    body = markers.select("book", "chapter_no", F.posexplode(block).alias("k", "line"))
    return head.unionByName(body.select("book", (F.col("chapter_no") * 10 + F.col("k")).cast("long").alias("line_no"), "line"))


MANIFEST = "title string, completed long, total long, chunks array<struct<index: int, text: string, audio_file: string>>"


def manifest(title: Column, chunks: Column, completed: Column) -> Column:
    """A book's manifest as JSON: its chunks in order, with the name of a file for the first `completed` ones."""
    name = lambda i: F.when(i < completed, F.format_string("chunks/%06d.wav", i))
    each = F.transform(chunks, lambda t, i: F.struct(i.alias("index"), t.alias("text"), name(i).alias("audio_file")))
    return F.to_json(F.struct(title.alias("title"), completed.alias("completed"), F.size(chunks).cast("long").alias("total"), each.alias("chunks")))
