"""Exact deduplication by a tree merge of sorted digest runs (native).

Every input partition is a run: its rows' digests, one entry a text, in the
order of the digest.  Runs are merged in binomial rounds, ceil(log2(runs)) of
them: in round k, run r and run r + 2**k become one by a full outer merge
join on the digest, and for every digest the smallest identifier and the count
survive.  A round's runs are tables bucketed by digest and sorted in every
bucket, so the join reads both sides as they lie: it neither shuffles nor sorts.
A digest that a third of all rows share has one entry a run in any round, and
every run is spread over all buckets, so no task holds a run or a digest.

"Verified": an entry's key is the SHA-256 of the normalised text together
with its length and an independent 64-bit hash, so texts that differ in any of
the three never merge, at any level.

Defined results
---------------
* null text counts as the empty text; empty texts are equal to each other;
* null ids sort after all others; of rows that share the smallest id
  (repeated rows) exactly one is kept;
* an empty table gives an empty result; further columns are ignored by
  ``exact_groups`` and kept by ``drop_copies``, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from finelens.llm.common import WS, new_path, plain_names, restored, stored

#: Partitions beyond this share runs with earlier ones; it bounds the rounds at 16.
RUNS = 1 << 16
#: Entries that a bucket of the run tables should hold, and the most buckets of a table.
BUCKET_ENTRIES, BUCKETS = 1 << 20, 4096


def normalised(text: Column) -> Column:
    """Blank runs become one space; null is the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{WS}]+", " ")


def digest_key(norm: Column) -> Column:
    """Key of a normalised text: SHA-256, length and a second hash to verify it."""
    return F.struct(
        F.unhex(F.sha2(norm, 256)).alias("sha"),
        F.length(norm).alias("chars"),
        F.xxhash64(norm).alias("check"),
    )


def digest_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, key, uid, run) per row, sorted within each run and stored."""
    rows = docs.select(
        F.col(id_col).alias("id"),
        normalised(F.col(text_col)).alias("norm"),
        F.monotonically_increasing_id().alias("uid"),
        (F.spark_partition_id() % RUNS).alias("run"),
    ).select("id", digest_key(F.col("norm")).alias("key"), "uid", "run")
    return stored(rows.sortWithinPartitions("key.sha"), "digest-runs")


#: Parts of a digest entry; the digest comes first: tables are bucketed and sorted by it.
KEY = ("sha", "chars", "check")


def run_table(entries: DataFrame, buckets: int, k: int) -> str:
    """Writes entries (sha, chars, check, run, first, n) as the runs of round ``k``; the table's name.

    A table in the shared folder, bucketed by digest: each bucket is one file, sorted by digest, then the
    pair of runs that the round merges, then the other parts of the key.
    """
    name = f"digest_runs_{k}_{uuid.uuid4().hex}"
    rows = entries.withColumn("pair", F.shiftright("run", k + 1)).withColumn("late", F.shiftright("run", k) % 2 == 1)
    order = ["sha", "pair", "chars", "check"]
    rows = rows.repartition(buckets, "sha").sortWithinPartitions(*order)
    path = new_path(entries.sparkSession, f"digest-runs-{k}")
    rows.write.bucketBy(buckets, "sha").sortBy(*order).format("parquet").option("path", path).saveAsTable(name)
    return name


def merged(level: DataFrame) -> DataFrame:
    """The runs of one round merged: run r and run r + 2**k, entry by entry."""
    names = ["sha", "pair", "chars", "check"]
    sides = []
    for late in (False, True):
        side = level.where(F.col("late") == late)
        sides.append(side.select(*names, *[F.col(c).alias(f"{c}{int(late)}") for c in ("run", "first", "n")]).hint("merge"))
    both = sides[0].join(sides[1], names, "full")
    return both.select(
        *KEY,
        F.least("run0", "run1").alias("run"),
        # structs: the least of two, or the one that there is
        F.when(F.col("first0") <= F.col("first1"), F.col("first0")).otherwise(F.coalesce("first1", "first0")).alias("first"),
        (F.coalesce("n0", F.lit(0)) + F.coalesce("n1", F.lit(0))).alias("n"),
    )


#: Spark relies on the order inside a bucket of one file, and on buckets of the digest alone for a join on the digest and more.
SETTINGS = {
    "spark.sql.legacy.bucketedTableScan.outputOrdering": "true",
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
}


@contextmanager
def as_they_lie(spark: SparkSession) -> Iterator[None]:
    """While the runs are merged: joins take the bucketed tables without shuffle and sort."""
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    try:
        for k, v in SETTINGS.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def merge_runs(runs: DataFrame) -> DataFrame:
    """Merge the sorted runs in binomial rounds to one entry per key: (key, first, n).

    ``first`` is the smallest (id is null, id, uid).
    """
    spark = runs.sparkSession
    entry = F.struct(F.col("id").isNull().alias("no_id"), "id", "uid")
    entries = runs.groupBy("run", "key").agg(F.min(entry).alias("first"), F.count("*").alias("n"))
    entries = entries.select("run", *[F.col(f"key.{c}").alias(c) for c in KEY], "first", "n")
    size = runs.agg(F.coalesce(F.max("run"), F.lit(0)).alias("last"), F.count("*").alias("rows")).first()
    buckets = min(BUCKETS, max(spark.sparkContext.defaultParallelism, size["rows"] // BUCKET_ENTRIES))
    rounds = size["last"].bit_length()
    with as_they_lie(spark):
        tables = []
        for k in range(rounds):
            tables.append(run_table(entries, buckets, k))
            entries = merged(spark.table(tables[-1]))
        entries = stored(entries, "digest-entries")
    for name in tables:  # names only: the files are the shared folder's
        spark.sql(f"DROP TABLE {name}")
    return entries.select(F.struct(*KEY).alias("key"), "first", "n")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, the id that stays, group size, kept flag, digest."""
    rows = digest_rows(docs, id_col, text_col)
    winners = merge_runs(rows)
    joined = rows.join(winners, "key")
    return joined.select(
        F.col("id").alias("doc_id"),
        F.col("first.id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("uid") == F.col("first.uid")).alias("kept"),
        F.lower(F.hex("key.sha")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, the one with the smallest id.

    The texts move once, to be joined with the merged digests; where several
    rows share the kept id and text, one of them is taken.
    """
    plain, names = plain_names(docs)
    id_col, text_col = names[id_col], names[text_col]
    rows = digest_rows(plain, id_col, text_col)
    winners = stored(
        rows.join(merge_runs(rows), "key")
        .where(F.col("id").eqNullSafe(F.col("first.id")))
        .groupBy("key", F.col("first.id").alias("keep_id"))
        .agg(F.count("*").alias("ties")),
        "digest-winners",
    )
    keyed = plain.withColumn("__key", digest_key(normalised(F.col(text_col))))
    # one match a row at most: the key decides, the id narrows it to the kept row
    hit = (F.col("__key") == F.col("__w.key")) & F.col(id_col).eqNullSafe(F.col("__w.keep_id"))
    w = winners.select(F.struct("key", "keep_id", "ties").alias("__w"))
    out = keyed.join(w.where("__w.ties = 1"), hit, "left_semi")
    if not winners.where("ties > 1").isEmpty():  # repeated rows of a kept id: the texts move a second time for them
        tied = keyed.join(w.where("__w.ties > 1"), hit, "left_semi").dropDuplicates(["__key", id_col])
        out = out.unionByName(tied)
    return restored(out, names)
