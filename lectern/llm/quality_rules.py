"""Quality rules whose thresholds follow the data.

Each text is measured by built-in functions in one narrow stage. Per language and source, KLL quantile sketches of the
measures are built and merged upwards (source -> language -> all); fences beyond the middle half of each group's values
replace fixed cutoffs, and the fences are joined back to filter. A group's quantiles are drawn towards its language's,
and these towards those of all, by the number of values that they rest on; there is no least size. Only DataFrame
functions: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import GAP, NOT_GAP, settle, text_or_empty, unused, words

SYMBOLS = "#*$%&|<>"
#: measure -> which side is judged. Sketches hold the values above 0: where a measure is mostly 0 (repeats), documents
#: that have some are compared with others that have some, and 0 is never too much.
MEASURES = {"mean_word_chars": "both", "other_share": "high", "upper_share": "high", "dup_line_share": "high", "repeat_share": "high"}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Widths of the middle half from a quartile to the fence, and documents for which the wider group counts.
REACH, PRIOR = 8.0, 100
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SKETCH_K = 400


def _repeat_positions(grams: str, ranked: str) -> Column:
    """Positions of the windows whose hash occurs again; ranked: (hash, position) in order."""
    twin = F.transform(ranked, lambda x, i: F.struct(x["p"].alias("p"), (F.coalesce(F.get(ranked, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(ranked, i + 1)["h"] == x["h"], F.lit(False))).alias("again")))
    return F.sort_array(F.transform(F.filter(twin, lambda x: x["again"]), lambda x: x["p"]))


def measure(docs: DataFrame) -> DataFrame:
    """Adds the counts, base_failed and the measures; columns of these names are replaced, all others stay.

    Null text counts as empty; without words every share is 0. Windows of three words compare by 64-bit hash.
    """
    t, w, g, s, r, l, n_lines, upper, other = own = unused(docs, *(f"own_{i}" for i in range(9)))
    d = docs.withColumn(t, text_or_empty(F.col("text"))).withColumn(w, words(F.col(t)))
    gram = lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    d = d.withColumn(g, F.when(F.size(w) > 2, F.transform(F.sequence(F.lit(0), F.size(w) - 3), gram)))
    repeats = F.size(F.array_distinct(g)) < F.size(g)
    d = d.withColumn(s, F.when(repeats, F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))))
    d = d.withColumn(r, F.when(F.col(s).isNotNull(), _repeat_positions(g, s)))
    covered = F.aggregate(r, F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")), lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(3), x - a["last"])).alias("n")), lambda a: a["n"])
    d = d.withColumn(l, F.filter(F.split(t, "\n"), lambda x: x.rlike(NOT_GAP)))
    size = lambda c: F.size(c).cast("long")
    d = d.withColumns({
        "n_words": size(w), "word_chars": F.length(F.regexp_replace(t, GAP, "")).cast("long"),
        "n_dup_lines": size(l) - size(F.array_distinct(l)), "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
        "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"), n_lines: size(l),
        upper: F.length(t) - F.length(F.regexp_replace(t, r"\p{Lu}+", "")), other: F.length(F.regexp_replace(t, r"[\p{L}\p{N}\p{M}\s]+", "")),
    })
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    d = d.withColumns({
        "base_failed": (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT),
        "mean_word_chars": share("word_chars", "n_words"), "other_share": share(other, "word_chars"), "upper_share": share(upper, "word_chars"),
        "dup_line_share": share("n_dup_lines", n_lines), "repeat_share": share("n_repeat_words", "n_words"),
    })
    return d.drop(*own)


def sketch(measured: DataFrame) -> DataFrame:
    """Per language and source, for each measure, a mergeable sketch of its values above 0 and their number n_, over the
    documents that pass the base rules."""
    rows = measured.filter(~F.col("base_failed"))
    some = {m: F.when(F.col(m) > 0, F.col(m)) for m in MEASURES}
    return rows.groupBy("lang", "source").agg(*[x for m, v in some.items() for x in (F.count(v).alias(f"n_{m}"), F.kll_sketch_agg_double(v, F.lit(SKETCH_K)).alias(m))])


def _merged(sketches: DataFrame, *keys: str) -> DataFrame:
    return sketches.groupBy(*keys).agg(*[x for m in MEASURES for x in (F.sum(f"n_{m}").alias(f"n_{m}"), F.kll_merge_agg_double(m, F.lit(SKETCH_K)).alias(m))])


def _quartiles(group: str, m: str) -> list[Column]:
    """A group's quartiles of a measure, null without a value."""
    return [F.when(F.col(f"{group}.n_{m}") > 0, F.kll_sketch_get_quantile_double(F.col(f"{group}.{m}"), F.lit(q))) for q in (0.25, 0.75)]


def fences(sketches: DataFrame, reach: float = REACH, prior: float = PRIOR) -> DataFrame:
    """Per language and source the low and high fence of each measure.

    sketches: as sketch() returns them, from one table or united from several; equal groups are merged first. A group's
    quartiles weigh n / (n + prior) against its language's, and these as much against those of all documents. Where the
    quartiles that come out are equal the measure has no spread to go by, and no fence (infinity).
    """
    fine = _merged(sketches, "lang", "source")
    coarse = _merged(fine, "lang")
    rows = fine.alias("f").join(coarse.alias("c"), F.col("f.lang").eqNullSafe(F.col("c.lang"))).join(_merged(coarse).alias("a"))
    out = []
    for m, side in MEASURES.items():
        drawn = _quartiles("a", m)
        for group in ("c", "f"):
            weight = F.col(f"{group}.n_{m}") / (F.col(f"{group}.n_{m}") + prior)
            drawn = [F.coalesce(weight * own + (1 - weight) * wide, wide) for own, wide in zip(_quartiles(group, m), drawn)]
        low, high = drawn
        some = F.coalesce(high > low, F.lit(False))
        out += [F.when(some & F.lit(side == "both"), low - reach * (high - low)).otherwise(float("-inf")).alias(f"{m}_low"), F.when(some, high + reach * (high - low)).otherwise(float("inf")).alias(f"{m}_high")]
    return rows.select("f.lang", "f.source", *out)


def judge(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """Adds kept: false where a base rule failed, else whether every measure lies inside its group's fences."""
    m, g = measured.alias("m"), limits.alias("g")
    inside = ~F.col("base_failed")
    for name in MEASURES:
        inside &= F.col(f"m.{name}").between(F.col(f"g.{name}_low"), F.col(f"g.{name}_high"))
    joined = m.join(g, F.col("m.lang").eqNullSafe(F.col("g.lang")) & F.col("m.source").eqNullSafe(F.col("g.source")), "left")
    return joined.select("m.*", F.coalesce(inside, F.lit(False)).alias("kept"))


def quality_rules(docs: DataFrame, reach: float = REACH) -> DataFrame:
    """docs (text, lang, source and any others) with the counts, base_failed, the measures and kept.

    Documents are measured once and written to the shared folder with their columns (leave text out of `docs` by
    selecting after measure() where only verdicts are wanted: see verdicts()); columns of the new names are replaced;
    null lang and null source are groups of their own; repeated rows are judged each; an empty table gives an empty result.
    """
    measured = settle(measure(docs.drop("kept")), "quality-measured")
    return judge(measured, settle(fences(sketch(measured), reach), "quality-fences"))


def verdicts(docs: DataFrame, reach: float = REACH) -> DataFrame:
    """As quality_rules() without the text: only doc_id, lang and source go along."""
    measured = settle(measure(docs.select("doc_id", "lang", "source", "text")).drop("text"), "quality-measured")
    return judge(measured, settle(fences(sketch(measured), reach), "quality-fences"))
