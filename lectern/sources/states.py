"""State files of projects as relations, and results that are replaced as a whole.

A file's text comes as a row (project, content), as text_files() reads them. A file that breaks a rule voids itself only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The keys of a file of verified entries, and the variant type of one entry.
SCAN_KEYS = ("detector_version", "schema_version", "verified_clean_chunks")
ENTRY = "OBJECT<mtime_ns: BIGINT, size: BIGINT>"


def text_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """project (the folder a file is in) and content of text files, each read whole within one task."""
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return spark.read.text(paths, wholetext=True).select(F.url_decode(F.replace(folder, F.lit("+"), F.lit("%2B"))).alias("project"), F.col("value").alias("content"))


def _map(json: Column, path: str = "$") -> Column:
    return F.try_variant_get(json, path, "map<string,variant>")


def verified_entries(files: DataFrame, schema_version: int, detector_version: int) -> DataFrame:
    """project, idx, size and mtime of each entry of files of verified work (project, content).

    A file counts only as a whole: it has the keys SCAN_KEYS and no others, both versions as asked, and only entries of
    a decimal index (18 digits at most, no two alike) with a whole size above 0 and a whole time from 0 on, and nothing
    else. Otherwise, as for null, empty or broken content, it gives no rows, and its project is scanned anew.
    """
    f = files.select("project", F.try_parse_json("content").alias("_j"))
    f = f.withColumn("_top", _map(F.col("_j"))).withColumn("_entries", _map(F.col("_j"), "$.verified_clean_chunks"))
    whole = lambda v: F.schema_of_variant(v) == "BIGINT"
    version = lambda key, asked: whole(F.col("_top")[key]) & (F.try_variant_get("_j", f"$.{key}", "long") == asked)
    f = f.filter(F.array_sort(F.map_keys("_top")) == F.array(*map(F.lit, SCAN_KEYS)))
    f = f.filter(version("schema_version", schema_version) & version("detector_version", detector_version) & F.col("_entries").isNotNull())
    rows = F.map_entries("_entries")

    def good(e: Column) -> Column:
        named = e["key"].rlike("^[0-9]{1,18}$") & (F.schema_of_variant(e["value"]) == ENTRY)
        return F.coalesce(named & (F.try_variant_get(e["value"], "$.size", "long") > 0) & (F.try_variant_get(e["value"], "$.mtime_ns", "long") >= 0), F.lit(False))

    ids = F.transform(F.map_keys("_entries"), lambda k: F.regexp_replace(k, "^0+(?=[0-9])", ""))
    f = f.filter(F.forall(rows, good) & (F.size(F.array_distinct(ids)) == F.size("_entries"))).select("project", F.explode(rows).alias("e"))
    number = lambda key: F.try_variant_get("e.value", f"$.{key}", "long")
    return f.select("project", F.col("e.key").cast("long").alias("idx"), number("size").alias("size"), number("mtime_ns").alias("mtime"))


def project_states(metadata: DataFrame, progress: DataFrame, legacy_model: str, models: list[str]) -> DataFrame:
    """project, completed, scheduled, model and fault of each metadata row; progress rows (project, content) override counts.

    fault: `unreadable` (no JSON object), `complete` (an output file is named), `model` (none of `models`), else null.
    A project without a model has `legacy_model`. A progress file counts as far as it can be read: its completed count,
    then its scheduled count, unless the first is there and is no number. One progress row a project at most.
    """
    p = progress.select(F.col("project").alias("_project"), F.try_parse_json("content").alias("_p"))
    m = metadata.select("project", F.try_parse_json("content").alias("_m")).join(p, F.col("project") == F.col("_project"), "left")
    count = lambda j, key: F.try_variant_get(j, f"$.{key}", "long")
    done, keys = count("_p", "completed_chunks"), F.map_keys(_map(F.col("_p")))
    broken = F.coalesce(F.array_contains(keys, "completed_chunks"), F.lit(False)) & done.isNull()
    planned = F.when(~broken, count("_p", "scheduled_chunks"))
    model = F.coalesce(F.try_variant_get("_m", "$.model_id", "string"), F.lit(legacy_model))
    named = F.coalesce(F.try_variant_get("_m", "$.output_file", "string"), F.lit(""))
    fault = F.when(_map(F.col("_m")).isNull(), "unreadable").when(named != "", "complete").when(~model.isin(*models), "model")
    return m.select("project", F.coalesce(done, count("_m", "completed_chunks")).alias("completed"), F.coalesce(planned, count("_m", "scheduled_chunks")).alias("scheduled"), model.alias("model"), fault.alias("fault"))


def _complete(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the versions below `path` whose job has committed."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(path, "version=*/_SUCCESS")) or []
    return sorted(int(x.getPath().getParent().getName().split("=")[1]) for x in found)


def replace_result(rows: DataFrame, path: str) -> int:
    """Writes rows as the next version of the result at `path`, and returns its number.

    A version counts once its job has committed (the `_SUCCESS` mark), so that a job that fails leaves the version
    before it in place, rows may be read from the result that they replace, and readers never see half a result.
    One writer at a time. Older versions stay until drop_versions().
    """
    number = (_complete(rows.sparkSession, path) or [0])[-1] + 1
    rows.write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(f"{path}/version={number}")
    return number


def current_result(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest complete version of the result at `path`, None where there is none."""
    done = _complete(spark, path)
    return spark.read.parquet(f"{path}/version={done[-1]}") if done else None


def drop_versions(spark: SparkSession, path: str, keep: int = 1) -> None:
    """Deletes complete versions of the result at `path` but for the newest `keep` (1 at least)."""
    for n in _complete(spark, path)[: -max(1, keep)]:
        old = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version={n}")
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
