"""Resumable processing: durable prefixes, verified caches and plan differences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def durable_prefix(files: DataFrame) -> DataFrame:
    """How many leading indices of each project are all valid (project, idx, valid)."""
    bad = F.min(F.when(~F.col("valid"), F.col("idx")))
    return files.groupBy("project").agg(F.coalesce(bad, F.count(F.lit(1))).cast("long").alias("prefix"), F.count(F.lit(1)).alias("scheduled"))


def resume_index(prefixes: DataFrame, batch: int) -> DataFrame:
    """Where work resumes: after a complete prefix, else at the batch that holds the frontier."""
    return prefixes.withColumn("resume_at", F.when(F.col("prefix") == F.col("scheduled"), F.col("prefix")).otherwise(F.floor(F.col("prefix") / batch) * batch).cast("long"))


def known_clean(cache: DataFrame, prefixes: DataFrame, version: int | None = None) -> DataFrame:
    """The entries of a cache (project, idx, size, mtime, and detector_version where a version is asked for) that count:
    those below the project's durable prefix, of this version of the detector. Entries of other projects go."""
    c = cache if version is None else cache.filter(F.col("detector_version") == version)
    within = c.alias("c").join(prefixes.select("project", "prefix").alias("p"), "project").filter(F.col("c.idx") < F.col("p.prefix"))
    return within.select("project", "idx", "size", "mtime").distinct()


def scan_work(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Files whose identity (project, idx, size, mtime) is not in the verified cache."""
    return files.filter("valid").join(cache, ["project", "idx", "size", "mtime"], "left_anti")


def scan_plan(files: DataFrame, cache: DataFrame, version: int | None = None) -> tuple[DataFrame, DataFrame]:
    """What a resumed project still has to scan, and the numbers of its plan.

    The first table has the files (project, idx, size, mtime) below the durable prefix that no counting entry of the cache
    has; the second project, durable, to_scan, cached_skipped, and stale (entries at or beyond the prefix, or without a
    project's files, of whatever version: they are dropped). (project, idx) is unique in files.
    """
    prefixes = durable_prefix(files)
    known = known_clean(cache, prefixes, version)
    durable = files.join(prefixes.select("project", "prefix"), "project").filter(F.col("idx") < F.col("prefix"))
    work = durable.join(known, ["project", "idx", "size", "mtime"], "left_anti").select("project", "idx", "size", "mtime")
    beyond = cache.join(prefixes.select("project", "prefix"), "project", "left").filter(F.col("prefix").isNull() | (F.col("idx") >= F.col("prefix")))
    stale = beyond.groupBy("project").agg(F.count(F.lit(1)).alias("stale"))
    todo = work.groupBy("project").agg(F.count(F.lit(1)).alias("to_scan"))
    n = prefixes.select("project", F.col("prefix").alias("durable")).join(todo, "project", "left").join(stale, "project", "full_outer")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return work, n.select("project", zero("durable").alias("durable"), zero("to_scan").alias("to_scan"), (zero("durable") - zero("to_scan")).alias("cached_skipped"), zero("stale").alias("stale"))


def debris_guard(finals: DataFrame, temps: DataFrame) -> DataFrame:
    """The least index per project of a temporary file that no newer valid final file covers."""
    covered = finals.filter("valid").select("project", "idx", F.col("mtime").alias("done"))
    left = temps.join(covered, ["project", "idx"], "left").filter(F.col("done").isNull() | (F.col("done") <= F.col("mtime")))
    return left.groupBy("project").agg(F.min("idx").alias("cap"))


def plan_diff(saved: DataFrame, now: DataFrame) -> DataFrame:
    """Per book the first index at which two chunk plans differ, and both lengths; books that agree are left out."""
    a, b = saved.withColumn("in_a", F.lit(1)).alias("a"), now.withColumn("in_b", F.lit(1)).alias("b")
    both = a.join(b, ["book", "idx"], "full_outer")
    differ = ~F.col("a.text").eqNullSafe(F.col("b.text"))
    out = both.groupBy("book").agg(F.min(F.when(differ, F.col("idx"))).alias("first_difference"), F.count("a.in_a").alias("saved"), F.count("b.in_b").alias("now"))
    return out.filter("first_difference is not null")


def cache_merge(old: DataFrame, touched: DataFrame) -> DataFrame:
    """The verified set after a scan: old entries that were not touched, and the touched ones found clean."""
    kept = old.join(touched.select("project", "idx"), ["project", "idx"], "left_anti")
    return kept.select("project", "idx", "size").unionByName(touched.filter("clean").select("project", "idx", "size"))


def cache_changes(old: DataFrame, new: DataFrame, identity: tuple[str, ...] = ("size",)) -> DataFrame:
    """project, added, removed and changed: how two verified sets (project, idx, identity) differ, projects that don't
    left out. A null in an identity is a value like others; (project, idx) is unique in each."""
    of = lambda t, name: t.select("project", "idx", F.struct(*identity).alias(name), F.lit(True).alias(f"in_{name}"))
    both = of(old, "old").join(of(new, "new"), ["project", "idx"], "full_outer")
    kinds = {"added": F.col("in_old").isNull(), "removed": F.col("in_new").isNull(), "changed": F.col("in_old") & F.col("in_new") & ~F.col("old").eqNullSafe(F.col("new"))}
    out = both.groupBy("project").agg(*[F.count_if(F.coalesce(cond, F.lit(False))).alias(name) for name, cond in kinds.items()])
    return out.filter("added + removed + changed > 0")
