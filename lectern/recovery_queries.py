"""Queries on recovered texts and multilingual prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import multilingual, segment
from lectern.functions import text as T
from lectern.plans import recovery
from lectern.registry import query
from lectern.sources import tables as S

#: All paths of split texts: up to DEPTH digits, 1 or 2.
PATHS = [format(i, "b")[1:].replace("1", "2").replace("0", "1") for i in range(1, 2 ** (recovery.DEPTH + 1))]


def attempts(chunks):
    """Verdicts by arithmetic on the id, path and attempt, for every path that a text could have."""
    tries = chunks.select("id", F.explode(F.array(*map(F.lit, PATHS))).alias("path")).select("id", "path", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("attempt"))
    drawn = F.crc32(F.concat_ws("/", "id", "path", F.col("attempt").cast("string")).cast("binary")) % 10
    verdict = F.when(drawn < 4, "clean").when(drawn < 8, "issue").otherwise("invalid")
    return tries.withColumn("verdict", verdict)


def chunks(spark, d):
    c = S.read(spark, d, "conversations").groupBy("conv_id", "turn").agg(F.max("text").alias("text"))
    return c.select(F.concat_ws("-", "conv_id", "turn").alias("id"), "text")


@query()
def recovery_resolve(spark, d):
    """What becomes of each turn whose speech fails as the arithmetic verdicts say."""
    c = chunks(spark, d)
    return recovery.resolve(c, attempts(c))


@query()
def normalize_multilingual(spark, d):
    """Each document as a prompt of the multilingual model, normalised."""
    docs = T.clean_text(S.read(spark, d, "documents").filter("text is not null and lang is not null").select("doc_id", "lang", "text"))
    prompt = F.concat(F.lit("<"), "lang", F.lit(">[START]"), T.punc_norm(F.col("cleaned")), F.lit("[STOP]"))
    done = multilingual.normalize_multilingual(docs.select("doc_id", prompt.alias("prompt")))
    return done.select("doc_id", F.md5(F.col("normalized").cast("binary")).alias("normalized_md5"))


@query(r"""with recursive names as (select p_partkey, replace(p_name, ' ', '') t from part), dict as (select distinct unnest(string_split(p_name, ' ')) w from part where p_partkey % 3 = 0),
    places as (select distinct t from names), seg as (select t, t rest, '' done from places union all
      select t, substr(rest, n + 1), done || case when done = '' then '' else ' ' end || left(rest, n) from (select s.t, s.rest, s.done, coalesce(max(length(w)), 1) n from seg s left join dict on starts_with(s.rest, w) and w != '' where s.rest != '' group by all))
    select p_partkey, done words from names join seg using (t) where rest = ''""")
def word_segments(spark, d):
    """Names of parts without their spaces, cut into words by the words of every third name."""
    part = S.read(spark, d, "part")
    words = part.filter("p_partkey % 3 = 0").select(F.explode(F.split("p_name", " ")).alias("word"))
    return part.select("p_partkey", segment.word_breaker(words)(F.replace("p_name", F.lit(" "), F.lit(""))).alias("words"))
