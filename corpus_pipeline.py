"""A corpus pipeline: quality rules, near-duplicates, decontamination, PII and packing.

Each stage takes the documents that the one before kept. All but the last return the columns
of ``documents``, extra ones too, whatever their names; ``n_chars`` follows a changed text.

Defined cases, for the whole: an empty ``documents`` gives no pieces; without ``labels`` only the base
rules reject, and without ``benchmark`` nothing is contaminated. Null and empty texts have no ten
words, so the first stage drops them; a stage that is given some all the same keeps them as its
operator says. Texts of any length are worked on whole. Rows with the same id are rows of their
own until the second stage, which keeps one row of each group of linked fingerprints; ties
there go to the smallest id, a null id counting as larger than all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.llm import decontaminate, packing, pii, quality_rules, simhash
from basketry.llm.shared import stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the certified cutoffs keep; a null text fails the base rules."""
    return quality_rules.passing(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints: that with the smallest id.

    Texts without words, null ones too, have one fingerprint and so are one group.
    """
    return simhash.distinct_documents(docs)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark passages; a null text has no words and stays."""
    return decontaminate.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; a null text stays null."""
    n_chars = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text"))
    return pii.masked(docs).withColumn("n_chars", n_chars.cast(docs.schema["n_chars"].dataType))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences; a null or empty text is its end id."""
    return packing.pack(packing.pieces(docs))


STAGES = [
    ("quality rules", quality),
    ("near-duplicates", near_duplicates),
    ("decontamination", contamination),
    ("personal data", personal_data),
    ("packing", packed),
]

#: Token ids and packing have no SQL form; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over ``documents``; each stage is stored for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
