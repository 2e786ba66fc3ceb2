"""A pipeline over documents: each stage gets what its predecessor kept, written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.llm import decontaminate, jaccard_join, mixing, quality_model, quality_rules
from lectern.llm.common import scratch, settle, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the classifier predicts to be good, with the columns that they have.

    Null and empty texts have the score of an empty text, equal texts equal scores; an empty table gives an empty one.
    """
    return quality_model.keep_good(docs, table(spark, sf_dir, "labels"))


def adaptive_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents inside the fences of their language and source; null and empty texts fail the base rules."""
    return quality_rules.quality_rules(docs).filter("kept").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by five-word shingles at a similarity of 0.8: that of the least doc_id.

    Texts without words link with nothing; rows without doc_id all stay; rows that repeat an id and its text are one.
    """
    return jaccard_join.one_of_each(docs, k=5, percent=80).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that hold no benchmark item; null and empty texts hold none."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix with size, copies and taken, which replace columns of these names; no copies: left out."""
    return mixing.mixed_documents(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", adaptive_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing_sources),
]

#: The classifier, the sketches and the cube method have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that all stages leave. What a stage wrote for itself goes when its result is written, and that when
    the next one is."""
    docs, before = table(spark, sf_dir, "documents"), ()
    for k, (_, stage) in enumerate(STAGES):
        with scratch():
            docs = settle(stage(spark, docs, sf_dir), f"pipeline-{k}", *before, keep=True)
        before = (docs,)
    return docs
