"""The driver's tables, and views of them as the relations that the operators work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions.text import let


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are cores, where its files give fewer (one file of one row group is one task)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; texts, on which most work is done row by row, are spread over all cores."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in ("documents", "pages") else df


def flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of clips with a flag and a support level: the events of a user in time order."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("clip"), (F.row_number().over(order) - 1).cast("long").alias("frame_no"), (F.col("value") >= 35).alias("flag"), (F.col("value") >= 15).alias("support"), "value")


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of clips in whole seconds: an event lasts as many minutes as its value."""
    start = F.unix_timestamp(F.date_trunc("second", "ts"))
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("clip"), start.alias("start"), (start + F.ceil(60 * F.col("value"))).alias("end"))


def narration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of books: the turns of a conversation, two to a chapter."""
    return read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("book"), F.col("turn").alias("pos"), F.floor(F.col("turn") / 2).alias("chapter"), (100 * F.coalesce(F.length("text"), F.lit(0))).cast("long").alias("samples"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk files of projects: the lines of an order."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("project"), (F.row_number().over(order) - 1).cast("long").alias("idx"), (F.col("l_returnflag") != "R").alias("valid"), F.col("l_partkey").alias("size"), F.col("l_shipdate").alias("mtime"), (F.col("l_linestatus") == "F").alias("cached"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarter-second frames of signals: vectors as samples, with quiet stretches."""
    no = (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).cast("long")
    f = read(spark, sf_dir, "embeddings").withColumn("frame_no", no)
    amp = F.when(F.floor(F.col("frame_no") / 13) % 3 == F.col("label") % 3, 0.0001).otherwise(1.0)
    return f.select("vec_id", F.col("label").alias("clip"), "frame_no", let(amp, lambda a: F.transform("embedding", lambda x: x.cast("double") * a)).alias("samples"))


def pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frames as pieces of their clips' signals; the last frame of a clip is cut short, so lengths are no multiples."""
    f = frames(spark, sf_dir).withColumn("last", F.max("frame_no").over(Window.partitionBy("clip")))
    short = F.slice("samples", F.lit(1), (21 + 4 * F.pmod("clip", F.lit(10))).cast("int"))
    return f.select("clip", (F.col("frame_no") * 64).alias("pos"), F.when(F.col("frame_no") == F.col("last"), short).otherwise(F.col("samples")).alias("samples"))
