"""Normalising prompts of a multilingual model, `<xx>[START]…[STOP]`."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lectern.functions.glyphs import decompose_hangul

# The marks of a prompt
START, STOP, SPACE = "[START]", "[STOP]", "[SPACE]"
STEPS: Mapping[str, Callable[[Column], Column]] = {"ko": decompose_hangul}


@F.pandas_udf(StringType())
def lower_nfkd(texts: pd.Series) -> pd.Series:
    """Texts in lower case and compatibility decomposition, which no built-in function gives."""
    return texts.map(lambda t: unicodedata.normalize("NFKD", t.lower()), na_action="ignore")


def normalize_multilingual(rows: DataFrame, prompt: str = "prompt", steps: Mapping[str, Callable[[Column], Column]] = STEPS) -> DataFrame:
    """rows with `normalized`: the prompt with `[xx]` before its text, which is lowered, decomposed, and put through its language's step.

    The language is what follows a leading `<`; the text is then what stands between the first `>` and the next, null
    where there is no `>`. The marks at its ends are kept as they are. Every space becomes `[SPACE]`. steps: a function
    on the text's column by language; those of languages that need a dictionary or a model are the caller's, such as
    glyphs.dictionary_code() with a table. Null gives null. Each step is a column of its own, computed once.
    """
    tagged = F.startswith(prompt, F.lit("<"))
    language = F.when(tagged, F.substring_index(F.get(F.split(prompt, "<"), F.lit(1)), ">", 1)).otherwise("")
    r = rows.withColumns({"_lang": language, "_text": F.when(tagged, F.get(F.split(prompt, ">"), F.lit(1))).otherwise(F.col(prompt))})
    r = r.withColumns({"_start": F.when(F.startswith("_text", F.lit(START)), START).otherwise(""), "_stop": F.when(F.endswith("_text", F.lit(STOP)), STOP).otherwise("")})
    body = F.substring("_text", F.length("_start") + 1, F.length("_text") - F.length("_start") - F.length("_stop"))
    r = r.withColumn("_body", lower_nfkd(body))
    spoken = F.col("_body")
    for code, step in steps.items():
        spoken = F.when(F.col("_lang") == code, step(F.col("_body"))).otherwise(spoken)
    tag = F.when(F.col("_lang") != "", F.concat(F.lit("["), F.lower("_lang"), F.lit("]"))).otherwise("")
    out = F.replace(F.concat("_start", tag, spoken, "_stop"), F.lit(" "), F.lit(SPACE))
    return r.withColumn("normalized", out).drop("_lang", "_text", "_start", "_stop", "_body")
