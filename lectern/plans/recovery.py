"""What becomes of texts whose speech failed: tried again, split and tried in parts, kept with a warning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as T

#: How deep parts are split, and how often a text and a part are tried.
DEPTH, TRIES = 4, 2


def split_tree(chunks: DataFrame, depth: int = DEPTH) -> DataFrame:
    """id, path, part and splits for each text of chunks (id, text) and every part that it may be split into.

    A path has a digit for each split, 1 or 2; the text itself has an empty one. splits: the part has more than one
    sentence, is cut in two, and, but for the text itself, both are shorter and the depth is not reached. One narrow
    job: each round puts a row's parts beside it. Null texts count as empty.
    """
    rows = chunks.select("id", F.lit("").alias("path"), F.coalesce("text", F.lit("")).alias("part"), F.lit(True).alias("fresh"), F.lit(False).alias("splits"))
    for level in range(depth):  # explode_outer: a plain explode has a filter on its array, for which the parts are computed again
        parts = F.when(F.col("fresh") & (F.size(T.sentences(F.col("part"))) > 1), T.recovery_split(F.col("part")))
        rows = rows.withColumn("parts", parts)
        two = F.size("parts") == 2
        if level:
            two &= F.forall("parts", lambda p: F.length(p) < F.length("part"))
        rows = rows.withColumn("two", F.coalesce(two, F.lit(False)))
        node = lambda path, part, fresh, splits: F.struct(path.alias("path"), part.alias("part"), F.lit(fresh).alias("fresh"), splits.alias("splits"))
        own = F.array(node(F.col("path"), F.col("part"), False, F.col("splits") | F.col("two")))
        below = F.transform("parts", lambda p, i: node(F.concat("path", (i + 1).cast("string")), p, True, F.lit(False)))
        rows = rows.select("id", F.explode_outer(F.when(F.col("two"), F.concat(own, below)).otherwise(own)).alias("x")).select("id", "x.*")
    return rows.drop("fresh")


def _tried(attempts: DataFrame) -> DataFrame:
    """Per id and path: the first clean try, the verdict of the last one, and of the joined parts (attempt 0)."""
    verdict, tries = F.col("verdict"), F.col("attempt").between(1, TRIES)
    return attempts.groupBy("id", "path").agg(
        F.min(F.when(tries & (verdict == "clean"), F.col("attempt"))).alias("clean"),
        F.max_by(F.when(tries, verdict), F.when(tries, F.col("attempt"))).alias("last"),
        F.max(F.when(F.col("attempt") == 0, verdict)).alias("joined"),
    )


def resolve(chunks: DataFrame, attempts: DataFrame) -> DataFrame:
    """id, outcome, detected, retained, pieces and silent of each of chunks (id, text), from attempts at it and its parts.

    attempts: id, path as in split_tree(), attempt (1 or 2; 0 for the joined parts of a text or part that was split)
    and verdict, `clean`, `issue` (kept if nothing better comes) or `invalid` (silence in its place); one row each.
    What was not tried counts as an issue. outcome: `clean` at first, `fixed` by a later try or by clean parts whose
    joined sound is clean too, else `retained`. pieces: how many parts make up the result; silent: how many of them are
    silence, all if the joined whole is invalid. A text and its parts, 31 rows at most, meet in one group; only texts
    that failed twice are split. ids are unique; rows with a null id are left out.
    """
    known = chunks.filter("id is not null")
    tried = _tried(attempts)
    first = known.join(tried.filter("path = ''").select("id", F.col("clean").alias("at")), "id", "left")
    failed = split_tree(first.filter("at is null").select("id", "text"))
    nodes = failed.join(tried, ["id", "path"], "left").select("id", F.struct("path", "splits", F.col("clean").isNotNull().alias("clean"), F.coalesce("last", F.lit("issue")).alias("last"), F.coalesce("joined", F.lit("issue")).alias("joined")).alias("node"))
    n = nodes.groupBy("id").agg(F.collect_list("node").alias("all"))
    above = lambda x: lambda a: (F.length(a["path"]) < F.length(x["path"])) & x["path"].startswith(a["path"])
    reached = F.filter("all", lambda x: ~F.exists("all", lambda a: above(x)(a) & a["clean"]))
    n = n.withColumn("live", reached)
    ends = lambda x: x["clean"] | ~x["splits"]
    n = n.withColumn("pieces", F.filter("live", ends))
    warned = F.exists("live", lambda x: ~x["clean"] & (~x["splits"] | (x["joined"] != "clean")))
    mute = F.exists("live", lambda x: (x["path"] == "") & x["splits"] & (x["joined"] == "invalid"))
    still = F.size(F.filter("pieces", lambda x: ~x["clean"] & (x["last"] == "invalid")))
    n = n.select("id", warned.alias("warned"), F.size("pieces").alias("n"), F.when(mute, F.size("pieces")).otherwise(still).alias("still"))
    r = first.join(n, "id", "left")
    outcome = F.when(F.col("at") == 1, "clean").when(F.col("at").isNotNull() | ~F.col("warned"), "fixed").otherwise("retained")
    some = lambda c, other: F.coalesce(c, F.lit(other)).cast("long")
    return r.select("id", outcome.alias("outcome"), (outcome != "clean").alias("detected"), (outcome == "retained").alias("retained"), some("n", 1).alias("pieces"), some("still", 0).alias("silent"))
