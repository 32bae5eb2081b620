"""Readers for the driver tables and the canonical tables derived from them.

Every canonical table (samples, metric points, runs, ...) is a lazy
projection of a driver table, so Catalyst prunes columns and pushes filters
straight into the Parquet scan.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finelens.session import table_path

DRIVER_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


class Tables:
    """Lazy access to the driver parquet tables of one scale factor."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(table_path(self.sf_dir, name))

    def __getattr__(self, name: str) -> DataFrame:
        if name in DRIVER_TABLES:
            return self.read(name)
        raise AttributeError(name)

    # ------------------------------------------------------------------
    # canonical tables
    # ------------------------------------------------------------------
    @cached_property
    def text_samples(self) -> DataFrame:
        """Text dataset: one dataset per ``source``, ``row_idx = doc_id``."""
        return self.documents.select(
            F.col("source").alias("dataset"),
            F.col("doc_id").alias("row_idx"),
            "text",
        )


def epoch_ms(col: str):
    """Milliseconds since the epoch of a TIMESTAMP_NTZ column (no time zone)."""
    return F.expr(f"timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {col})")
