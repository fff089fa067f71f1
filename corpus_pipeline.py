"""The corpus pipeline: stages that each apply one operator to what the stage before has kept.

For all stages: null texts count as empty, null sources are a source of their own, rows that repeat are
rows, an empty table gives an empty result, and columns beside doc_id, text and source pass along, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydroframe.llm import exact_dedup, jaccard, mixing, packing, toxicity
from hydroframe.llm.shared import materialize, release, table

#: Near copies share this share of their shingles of so many words.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; labels of held-out documents are not read. Empty texts have a score as others do; a score of exactly a half counts as toxic."""
    return toxicity.clean_documents(docs, table(spark, sf_dir, "labels"))


def stage_exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays, one of them if it repeats; null and empty texts are equal."""
    return exact_dedup.kept_documents(docs)


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked documents the one with the smallest doc_id stays; texts without words are linked with nothing."""
    return jaccard.one_of_each(docs, NEAR_WORDS, NEAR_PERCENT)


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; rows with equal identifier and text are taken alike."""
    return mixing.mixed_documents(docs)


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their ids, each a sequence of its own; an empty text is its end id."""
    return packing.pack(docs, packing.tokenizer_path()).withColumn("offset", F.lit(0).cast("long"))


STAGES = [
    ("toxicity", stage_toxicity),
    ("exact dedup", stage_exact_dedup),
    ("n-gram Jaccard join", stage_near_duplicates),
    ("mixing", stage_mixing),
    ("packing", stage_packing),
]

#: Learnt scores and tokenizer ids can't be expressed in SQL; tests hold the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, name.replace(" ", "-"))
            if before is not None:
                release(before)  # what it kept is written by now
            before = docs
    return docs
