"""URL filter: explicit rules first, then a path-template tree learned per host.

Paths are generalised into templates: segments made of numbers or long codes become wildcards at once, and a position
whose values hardly repeat becomes one too. Labels (true: bad) are counted per template; sibling branches whose bad
shares do not differ beyond chance are merged. A template is rejected when its purity, the bad share of its labels smoothed
step by step along the way down from the host, is high; the strength of the smoothing is all that asks for evidence.
Only DataFrame functions: no Python runs on the executors.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import settle

LEAST_VALUES, LEAST_NEW = 20, 0.3
Z = 1.96
STRENGTH, PURE = 2.0, 0.8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_CODE = r"^(?:[0-9]+|[0-9a-fA-F]{12,}|[0-9a-fA-F]{8}-[0-9a-fA-F-]{27})(\.[a-zA-Z]{1,5})?$"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls (host, path and one column `row` of all else) with rule and rule_verdict, null where none fits.

    rules: host, path, verdict (allow or block). A rule fits its host and all subdomains where the path starts with the
    rule's; the longest (host and path together) wins, block before allow between equals. A url meets rules by equality:
    of each suffix of its host and the start of its path, in each length that the suffix's rules have. So both tables may
    be large, and a host's array holds lengths, never rules.
    """
    rules = rules.filter("host is not null and host != ''").groupBy("host", F.coalesce("path", F.lit("")).alias("path")).agg(F.max("verdict").alias("verdict"))
    rules = settle(rules.select(F.col("host").alias("suffix"), F.col("path").alias("start"), "verdict"), "url-rules")
    lengths = rules.groupBy("suffix").agg(F.collect_set(F.length("start")).alias("lengths"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    spread = urls.select("host").distinct().filter("host != ''").select("host", F.explode(suffixes).alias("suffix"))
    tries = settle(spread.join(lengths, "suffix").select("host", "suffix", F.explode("lengths").alias("n")), "url-tries")
    own = urls.select("host", "path").distinct().join(tries, "host").filter(F.length("path") >= F.col("n"))
    met = own.withColumn("start", F.left("path", F.col("n"))).join(rules, ["suffix", "start"])
    rule = F.concat("suffix", "start")
    best = met.groupBy("host", "path").agg(F.max(F.struct(F.length(rule).alias("n"), rule.alias("rule"), "verdict")).alias("best"))
    joined = urls.join(settle(best, "url-best", tries), ["host", "path"], "left")
    return joined.withColumn("rule", F.col("best.rule")).withColumn("rule_verdict", F.col("best.verdict")).drop("best")


def shape(path: Column) -> Column:
    """The path's segments joined by /: numbers and codes become *."""
    parts = F.array_remove(F.split(path, "/"), "")
    return F.array_join(F.transform(parts, lambda x: F.when(x.rlike(_CODE), F.concat(F.lit("*"), F.regexp_extract(x, r"\.[a-zA-Z]{1,5}$", 0))).otherwise(x)), "/")


def _replaced(branch: str, d: int, by: str) -> Column:
    return F.transform(branch, lambda x, i: F.when(i == d, F.lit(by)).otherwise(x))


def templates(labelled: DataFrame) -> DataFrame:
    """host, shape, branch (the template's segments), and the numbers of urls n and of labels bad and good.

    labelled: host, shape, bad (boolean; null: no label). Counts are summed by host and shape before anything else, so
    a host with most of the urls is a few rows from there on. From the first segment down, a position below which a
    host's urls go on with many and hardly repeated values becomes a wildcard. A branch with too few shapes below it
    for that is finished, so a round handles what may still be generalised and there is no greatest depth.
    """
    rows = labelled.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("bad")).alias("bad"), F.count_if(~F.col("bad")).alias("good"))
    rows = settle(rows.withColumn("branch", F.split("shape", "/")), "url-shapes")
    finished, d = [], 0
    while True:
        at = rows.withColumn("parent", F.slice("branch", 1, d))
        deeper = F.size("branch") > d
        many = at.filter(deeper).groupBy("host", "parent").agg(F.count(F.lit(1)).alias("shapes")).filter(F.col("shapes") >= LEAST_VALUES)
        at = settle(at.join(many, ["host", "parent"], "left").withColumn("live", deeper & F.col("shapes").isNotNull()), "url-live")
        finished.append(at.filter("not live").select(rows.columns))
        live = at.filter("live").withColumn("value", F.get("branch", F.lit(d)))
        if live.isEmpty():
            return functools.reduce(DataFrame.unionByName, finished)
        values = live.groupBy("host", "parent", "value").agg(F.sum("n").alias("n"))
        wide = values.groupBy("host", "parent").agg(F.count(F.lit(1)).alias("values"), F.sum("n").alias("urls"))
        wide = wide.filter((F.col("values") >= LEAST_VALUES) & (F.col("values") >= LEAST_NEW * F.col("urls"))).select("host", "parent", F.lit(True).alias("wide"))
        live = live.join(wide, ["host", "parent"], "left")
        rows = settle(live.withColumn("branch", F.when(F.col("wide"), _replaced("branch", d, "*")).otherwise(F.col("branch"))).select(rows.columns), "url-branches")
        d += 1


def merge_branches(branches: DataFrame) -> DataFrame:
    """branches (host, branch, bad, good; a row each) with `node`: the branch after merging.

    Siblings are branches that differ in one segment only. From the deepest position up, where several siblings have
    labels, each of these is compared with all pooled: within Z standard errors (and half a count) it joins the branch
    ``~``; others, and those without labels, stay. Pools are sums by key that are joined back, so a host with very many
    branches is no one task's.
    """
    known = settle(branches.filter("bad + good > 0").select("host", "branch", F.col("branch").alias("node"), "bad", "good"), "url-known")
    for d in reversed(range(known.agg(F.coalesce(F.max(F.size("branch")), F.lit(0))).first()[0])):
        own = known.filter(F.size("node") > d).groupBy("host", "node").agg(F.sum("bad").alias("b"), F.sum(F.col("bad") + F.col("good")).alias("n"))
        own = own.withColumns({"kin": _replaced("node", d, ""), "value": F.get("node", F.lit(d))})
        pool = own.groupBy("host", "kin").agg((F.sum("b") / F.sum("n")).alias("p"), (F.min("value") != F.max("value")).alias("several")).filter("several")
        near = F.abs(F.col("b") / F.col("n") - F.col("p")) <= Z * F.sqrt(F.col("p") * (1 - F.col("p")) / F.col("n")) + 0.5 / F.col("n")
        alike = own.join(pool, ["host", "kin"]).filter(near).select("host", "node", _replaced("node", d, "~").alias("into"))
        known = settle(known.join(alike, ["host", "node"], "left").select("host", "branch", F.coalesce("into", "node").alias("node"), "bad", "good"), "url-merged", known)
    return branches.join(known.select("host", "branch", "node"), ["host", "branch"], "left").withColumn("node", F.coalesce("node", "branch"))


def judged(branches: DataFrame) -> DataFrame:
    """host, branch, template, purity and rejected of every branch (host, branch, node, bad, good).

    A node of the tree is a host with the first segments of its branches. Its purity is the bad share of the labels
    below it, smoothed towards its parent's (a host's towards the share of all labels) with STRENGTH labels' weight. A
    node that has just the labels of its parent says nothing new and has its purity, and so has one without labels. From
    PURE on a branch is rejected.
    """
    prior = branches.agg((F.coalesce(F.sum("bad"), F.lit(0)) / F.greatest(F.coalesce(F.sum(F.col("bad") + F.col("good")), F.lit(0)), F.lit(1))).alias("p")).first()[0]
    steps = branches.select("host", "node", "bad", "good").withColumn("k", F.explode(F.sequence(F.lit(0), F.size("node"))))
    nodes = steps.groupBy("host", F.expr("slice(node, 1, k)").alias("prefix")).agg(F.sum("bad").alias("b"), F.sum(F.col("bad") + F.col("good")).alias("n"))
    ways = branches.select("host", "node").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.size("node")))).withColumn("prefix", F.expr("slice(node, 1, k)"))
    ways = ways.join(settle(nodes, "url-nodes"), ["host", "prefix"]).groupBy("host", "node").agg(F.sort_array(F.collect_list(F.struct("k", "b", "n"))).alias("way"))
    start = F.struct(F.lit(float(prior)).alias("p"), F.lit(-1).cast("long").alias("n"))

    def down(above: Column, x: Column) -> Column:
        p = F.when(x["n"] == above["n"], above["p"]).otherwise((x["b"] + STRENGTH * above["p"]) / (x["n"] + STRENGTH))
        return F.struct(p.alias("p"), x["n"].alias("n"))

    ways = ways.select("host", "node", F.aggregate("way", start, down)["p"].alias("purity"))
    verdicts = ways.select("host", "node", F.concat(F.lit("/"), F.array_join("node", "/")).alias("template"), "purity", (F.col("purity") >= PURE).alias("rejected"))
    return branches.select("host", "branch", "node").join(verdicts, ["host", "node"]).select("host", "branch", "template", "purity", "rejected")


def filter_urls(pages: DataFrame, rules: DataFrame, bad: Column | None = None) -> DataFrame:
    """pages (url and others) with host, path, rule, template, purity and verdict; columns of these names are replaced.

    Labels: a page with a rule is bad where the rule blocks it, any other has the boolean `bad`, if given (null: no
    label). verdict: the rule's, else block where the tree rejects the url's template, else allow. Null and malformed
    urls have an empty host and path, fit no rule and are judged like any other template; repeated urls are judged
    each; empty tables give empty results.
    """
    host, path = host_and_path(F.col("url"))
    label = bad.cast("boolean") if bad is not None else F.lit(None).cast("boolean")
    keep = [c for c in pages.columns if c not in ("host", "path", "rule", "template", "purity", "verdict")]
    urls = pages.select(F.struct(*keep).alias("row"), host.alias("host"), path.alias("path"), label.alias("label"))
    urls = urls.select(F.struct("row", "label").alias("row"), "host", "path")
    urls = settle(match_rules(urls, rules).withColumn("shape", shape(F.col("path"))), "url-matched")
    label = F.coalesce(F.col("rule_verdict") == "block", F.col("row.label"))
    shapes = settle(templates(urls.select("host", "shape", label.alias("bad"))), "url-templates")
    branches = settle(shapes.groupBy("host", "branch").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")), "url-counts")
    tree = judged(settle(merge_branches(branches), "url-tree"))
    tree = settle(shapes.select("host", "shape", "branch").join(tree, ["host", "branch"]).drop("branch"), "url-verdicts")
    verdict = F.coalesce("rule_verdict", F.when(F.col("rejected"), F.lit("block")).otherwise(F.lit("allow")))
    return urls.join(tree, ["host", "shape"], "left").select("row.row.*", "host", "path", "rule", "template", "purity", verdict.alias("verdict"))
