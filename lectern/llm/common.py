"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import re
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.sources.tables import spread

#: The ASCII white space that separates words.
GAP = r"[\x20\x09-\x0D]+"
NOT_GAP = r"[^\x20\x09-\x0D]"


def text_or_empty(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit(""))


def words(col: Column) -> Column:
    """The words of a text, an empty array for a null or blank one."""
    return F.array_remove(F.split(text_or_empty(col), GAP), "")


def n_words(col: Column) -> Column:
    return F.size(words(col)).cast("long")


def crc_bucket(col: Column, n: int) -> Column:
    """crc32 of an id's decimal text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % n


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has, letter case aside."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


_owners: list[list[DataFrame]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, as in tests, a folder of the warehouse; an error if that is on a local disk and the master isn't
    local, for executors of a cluster would not see it.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/lectern-shared"
        if path.startswith(("file:", "/")) and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors share: {path} is on a local disk")
    return path.rstrip("/")


def settle(df: DataFrame, name: str, *done: DataFrame, keep: bool = False) -> DataFrame:
    """Write df to the shared folder and read it again; tables `done`, settled before and not needed any more, are deleted.

    Cuts the lineage, so a lost executor costs a read and not the work behind it, and gives the planner real sizes:
    whether a side is small enough to broadcast is then decided on the bytes that were written. What is not deleted
    before goes at the end of the scratch() that it was written in, unless it is to keep, and at the latest when the driver
    ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lectern-tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_at = path
    at, store = _stored(out)
    store.deleteOnExit(at)
    if _owners and not keep:
        _owners[-1].append(out)
    discard(*done)
    return out


def _stored(table: DataFrame):
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table.settled_at)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def discard(*tables: DataFrame) -> None:
    """Delete what settle() wrote for these tables. Nothing that is still to be read may depend on them."""
    for t in tables:
        at, store = _stored(t)
        store.delete(at, True)
        store.cancelDeleteOnExit(at)


@contextlib.contextmanager
def scratch() -> Iterator[None]:
    """Deletes, at its end, every table settled inside it: for callers that have written their results by then."""
    _owners.append([])
    try:
        yield
    finally:
        discard(*_owners.pop())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, in as many partitions as there are cores where its files give fewer: texts are worked on row by row."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in ("documents", "pages") else df
