"""A training corpus in five stages: language, repeated lines, near duplicates, mixing, packing.

Every stage takes the documents its predecessor kept and returns documents, the last one packed sequences. ``run``
writes each stage's result as Parquet to the shared scratch folder and reads it again.

Defined cases: null, empty and letterless texts are no known language and go in the first stage; repeated rows are one
document from the third stage on; null ids are kept as documents of their own; other columns pass unchanged up to the
last stage; texts of any length are taken whole; an empty table gives empty tables of the same columns.

The result is not expressed in SQL: language models, chunk hashes and tokenizers are not. Stages are tested one by one
against brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm import jaccard_join, language_id, line_dedup, mixing, packing
from evidentia.llm.common import WORD, materialize


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is one of the known ones."""
    return language_id.accepted(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that stand elsewhere before. ``n_chars`` follows the text.

    Documents that lose four fifths of their words or more go: what was cut is kept elsewhere, and the rest is the
    remnant of a near copy at the similarity of 0.8 that the next stage takes, which cannot see it any more.
    """
    left = F.regexp_count("text", F.lit(WORD))
    remnant = F.when(F.col("removed_words") > 0, 5 * F.col("removed_words") >= 4 * (F.col("removed_words") + left)).otherwise(False)
    cut = line_dedup.dedup_lines(docs).filter(~F.coalesce(remnant, F.lit(False)))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        cut = cut.withColumn("n_chars", F.when(F.col("removed_words") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return cut.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group, one row of it."""
    return jaccard_join.deduplicate(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents until the sources have their weights, in the order of the schedule."""
    return mixing.mixed_documents(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 1024 tokens, which ``ids`` hold."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", language),
    ("line_dedup", lines),
    ("near_duplicates", near_duplicates),
    ("mixing", mixture),
    ("packing", sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        out = materialize(stage(spark, out, sf_dir), name)
    return STAGES[-1][1](spark, out, sf_dir)
