"""Dataset fingerprints by content, and cache hits by them.

A fingerprint does not depend on the order of rows, the files or the
partitions: it is drawn from a multiset hash, the number of rows and two
sums of independent 60-bit row hashes.  States add up, so new partitions are
added to what is known without reading the old ones, and repeated rows count
(sums do not cancel as exclusive or does).  One partial aggregation a dataset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FINGERPRINT_CHARS = 10  # fixed: the length of a fingerprint in a tag
TAG = "phase-%s-%s-ds%s"  # fixed: phase index, strategy, fingerprint
_HASH_DIGITS = 15  # hexadecimal digits of a row hash: 60 bits


def row_text(columns: list[str]) -> Column:
    """The row as one text that tells any two rows apart: lengths before values, nulls marked."""
    parts = []
    for c in columns:
        s = F.col(c).cast("string")
        parts.append(F.coalesce(F.concat(F.length(s).cast("string"), F.lit(":"), s), F.lit("-")))
    return F.concat_ws(",", *parts)


def _row_hash(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, _HASH_DIGITS), 16, 10).cast("decimal(28,0)")


def fingerprint_state(rows: DataFrame, dataset: str, columns: list[str]) -> DataFrame:
    """Mergeable state per dataset: rows, sum1, sum2."""
    h = rows.select(dataset, row_text(columns).alias("_t")).select(dataset, F.sha2("_t", 256).alias("_a"), F.md5("_t").alias("_b"))
    return h.groupBy(dataset).agg(
        F.count(F.lit(1)).cast("bigint").alias("rows"),
        F.sum(_row_hash(F.col("_a"))).alias("sum1"),
        F.sum(_row_hash(F.col("_b"))).alias("sum2"),
    )


def merged_states(states: DataFrame, dataset: str) -> DataFrame:
    """The state of the union of what the states cover."""
    return states.groupBy(dataset).agg(
        F.sum("rows").cast("bigint").alias("rows"),
        F.sum("sum1").cast("decimal(38,0)").alias("sum1"),
        F.sum("sum2").cast("decimal(38,0)").alias("sum2"),
    )


def fingerprint() -> Column:
    """The short fingerprint of a state's columns."""
    text = F.concat_ws(":", F.col("rows").cast("string"), F.col("sum1").cast("string"), F.col("sum2").cast("string"))
    return F.substring(F.sha2(text, 256), 1, FINGERPRINT_CHARS)


def cache_hits(phases: DataFrame, fingerprints: DataFrame, tags: DataFrame) -> DataFrame:
    """``phases`` with the tag that a cached result must have, and whether it is there.

    ``phases``: dataset, phase_idx, strategy, repo; ``fingerprints``: dataset, fingerprint;
    ``tags``: repo, tag.  A phase whose dataset has no fingerprint is a miss without a tag.
    """
    named = phases.join(fingerprints.select("dataset", "fingerprint"), "dataset", "left")
    tag = F.when(
        F.col("fingerprint").isNotNull(),
        F.format_string(TAG, F.col("phase_idx").cast("string"), F.col("strategy"), F.col("fingerprint")),
    )
    known = tags.select("repo", F.col("tag").alias("expected_tag"), F.lit(True).alias("_hit")).distinct()
    j = named.withColumn("expected_tag", tag).join(known, ["repo", "expected_tag"], "left")
    return j.select(*phases.columns, "expected_tag", F.coalesce("_hit", F.lit(False)).alias("hit"))
