"""The corpus pipeline: stages over ``documents``, each written and read again.

Toxic documents go, lines found in many documents go, of each group of near-duplicates one
document stays, documents with benchmark items go, and what is left is encoded.

Every stage takes null and empty texts, very long ones, rows that repeat or have no doc_id,
empty tables and further columns of any name, which pass through all stages but the last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import bpe, decontam, line_dedup, ngram_join, toxicity
from lodestrata.llm.queries import TOKENIZER
from lodestrata.runtime import settle, table

#: Lines with a letter or so that stand in at least so many documents are boilerplate.
MIN_DOCS = 10


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the factorization machine calls toxic.

    Null and empty texts have no terms and get the score of the bias alone, so they stay
    unless three of ten labelled documents are toxic. Equal rows are judged alike.
    """
    machine = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, machine).where("predicted = 0").select(*docs.columns)


def lines_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the lines found in many documents; n_chars follows the text.

    All documents stay. A null text becomes an empty one. Equal rows count as one document.
    """
    out = line_dedup.dedup_lines(docs, min_docs=MIN_DOCS)
    return out.withColumn("text", F.col("kept_text")).withColumn("n_chars", F.length("kept_text").cast("long")).select(*docs.columns)


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates.

    That is the one with the smallest doc_id, or of those without, any. Of equal rows one
    stays, and of all documents without words too.
    """
    return ngram_join.keep_one(docs)


def benchmark_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that contain a benchmark item.

    Documents without words contain none. Equal rows are judged alike.
    """
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left, one row for each; a null text counts as empty."""
    return bpe.digests(docs, TOKENIZER)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxic_out),
    ("line_dedup", lines_out),
    ("ngram_join", near_copies_out),
    ("decontamination", benchmark_out),
    ("bpe", encoded),
]

#: A trained model decides in the first stage, which SQL can't express; the tests compare
#: the other stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to ``documents``; the last one's rows are the result."""
    docs = table(spark, sf_dir, "documents")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = settle(docs, name)
    return docs
