"""Corpus pipeline: quality rules, exact dedup, near-dedup, PII, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns a DataFrame that is written as Parquet and read again as the next
stage's ``docs``.  All but the last return the columns of ``documents``.

Defined results
---------------
* a null, empty or blank text has no words: the quality rules reject it;
* rows without doc_id are judged like any other; where one of several equal or
  near-equal texts must stay, rows with an id come first, the smallest id before others;
* repeated rows are copies of each other: one stays;
* a very long text is judged, compared and cut into pieces whole;
* an empty table gives no pieces, with the columns of the last stage;
* further columns of ``documents`` pass through every stage but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from finelens.llm import exact_dedup, hyperminhash, packing, pii_surrogates, quality_rules
from finelens.llm.common import read_table, stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line-first cleaning: failing lines are removed, rejected documents go."""
    return quality_rules.clean_documents(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return exact_dedup.drop_copies(docs)


#: Words of a shingle of the near-dedup stage; near copies have at least 0.8 of their shingles in common.
NEAR_WORDS = 5


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return hyperminhash.keep_one_of_each(docs, width=NEAR_WORDS)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by surrogates."""
    return pii_surrogates.anonymised(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in the training sequences."""
    return packing.packed_documents(docs)


STAGES = [
    ("quality_rules", quality),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("pii_surrogates", private),
    ("packing", pack),
]

#: Near-dedup, surrogates and packing are no SQL; the whole is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{name}")
    return docs
