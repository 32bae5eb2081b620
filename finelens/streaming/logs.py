"""Ingest of growing log files: every line once, across appends, truncations and rotations.

A file source of Structured Streaming knows a file by its name and never looks
at it again; logs grow under one name.  ``LogIngest`` keeps a table of files
(length, lines delivered, bytes delivered, first line's digest, generation) and on each
run looks only at files whose length or time has changed:

* longer, same first line: the lines behind those delivered are new;
* shorter than what was delivered, or another first line: the file was truncated or
  rotated, a new generation begins and all its lines are new;
* an empty file is as good as none, a file that is gone keeps its place in the table;
* a last line without its line feed is still being written and waits.

Lines keep their place in the file (``with_position``: a huge file is read and
numbered by many tasks).  Lines and file table of a run are one version of a
``CommitLog``: a run that breaks off leaves nothing that a reader sees, and the next
run does its work again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finelens.operators.ordering import with_position
from finelens.sources.commits import CommitLog

FILES_SCHEMA = (
    "path string, length long, modified timestamp, generation int, lines long, bytes long, first_md5 string"
)
LINES_SCHEMA = "path string, generation int, line_no long, line string"
#: Files read by one job; further ones follow in the next.
FILES_A_JOB = 10_000


class LogIngest:
    """Incremental ingest of the files that match ``pattern`` into ``out``."""

    def __init__(self, spark: SparkSession, pattern: str, out: str):
        self.spark, self.pattern, self.log = spark, pattern, CommitLog(spark, out)

    def listing(self) -> DataFrame:
        """Path, length and time of the files there are; their content is not read."""
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(self.pattern)
        return files.select("path", "length", F.col("modificationTime").alias("modified"))

    def files(self) -> DataFrame:
        """The table of files as of the last commit."""
        last = self.log.latest()
        if last is None:
            return self.spark.createDataFrame([], FILES_SCHEMA)
        return self.spark.read.schema(FILES_SCHEMA).parquet(self.log.version(last) + "/files")

    def lines(self) -> DataFrame:
        """All lines delivered, of all generations: path, generation, line_no, line."""
        done = [self.log.version(n) + "/lines" for n in self.log.numbers()]
        if not done:
            return self.spark.createDataFrame([], LINES_SCHEMA)
        return self.spark.read.schema(LINES_SCHEMA).parquet(*done)

    def changed(self) -> DataFrame:
        """Files that must be read, with what is known of them."""
        known = self.files().select("path", *[F.col(c).alias(f"old_{c}") for c in ("length", "modified", "generation", "lines", "bytes", "first_md5")])
        now = self.listing().join(known, "path", "left")
        same = F.col("length").eqNullSafe(F.col("old_length")) & F.col("modified").eqNullSafe(F.col("old_modified"))
        return now.where(~same)

    def read(self, paths: list[str]) -> DataFrame:
        """path, line_no, line, bytes of each line of the files, in any order."""
        text = self.spark.read.option("lineSep", "\n").text(paths)
        rows = text.select(
            F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_block"),
            F.monotonically_increasing_id().alias("_at"), F.col("value").alias("line"),
        )
        # rows of one block are read in order by one task
        return with_position(rows, ["path"], [F.col("_block"), F.col("_at")], "line_no").drop("_block", "_at")

    def run(self) -> int:
        """Deliver what is new; the number of files that had changed."""
        changed = self.changed().checkpoint()
        paths = [r["path"] for r in changed.select("path").toLocalIterator()]
        if not paths:
            return 0
        number = (self.log.latest() if self.log.latest() is not None else -1) + 1
        home = self.log.version(number)
        self.log.clear(home)
        kept = self.files().join(changed.select("path"), "path", "left_anti")
        kept.write.parquet(home + "/files")
        for at in range(0, len(paths), FILES_A_JOB):
            batch = paths[at : at + FILES_A_JOB]
            self._deliver(changed.where(F.col("path").isin(batch)) if len(paths) > FILES_A_JOB else changed, batch, home)
        self.log.commit(number)
        return len(paths)

    def _deliver(self, changed: DataFrame, paths: list[str], home: str) -> None:
        key = lambda c: F.regexp_replace(c, "^file:/+", "file:/")  # noqa: E731  both listings write local paths in their own way
        rows = self.read(paths).withColumn("_key", key(F.col("path"))).drop("path")
        size = F.octet_length("line") + 1
        seen = rows.groupBy("_key").agg(
            F.count(F.lit(1)).alias("_lines"), F.sum(size).alias("_bytes"),
            F.max_by(size, "line_no").alias("_last"), F.md5(F.min_by("line", "line_no")).alias("_first"),
        )
        j = changed.withColumn("_key", key(F.col("path"))).join(seen, "_key", "left")
        # one byte more than the file has: its last line has no line feed yet
        open_ = F.coalesce(F.col("_bytes") > F.col("length"), F.lit(False))
        first = F.when(~open_ | (F.col("_lines") > 1), F.col("_first"))
        lines = F.coalesce(F.col("_lines"), F.lit(0)) - open_.cast("long")
        bytes_ = F.coalesce(F.col("_bytes"), F.lit(0)) - F.when(open_, F.col("_last")).otherwise(0)
        fresh = (F.col("length") < F.col("old_bytes")) | (F.col("old_first_md5").isNotNull() & ~F.col("old_first_md5").eqNullSafe(first))
        state = j.select(
            "path", "_key", "length", "modified",
            (F.coalesce("old_generation", F.lit(0)) + F.coalesce(fresh, F.lit(False)).cast("int")).alias("generation"),
            lines.alias("lines"), bytes_.alias("bytes"), first.alias("first_md5"),
            F.when(F.coalesce(fresh, F.lit(False)), 0).otherwise(F.coalesce("old_lines", F.lit(0))).alias("_from"),
        ).checkpoint()
        state.select([c.split()[0] for c in FILES_SCHEMA.split(", ")]).write.mode("append").parquet(home + "/files")
        new = rows.join(state, "_key").where((F.col("line_no") >= F.col("_from")) & (F.col("line_no") < F.col("lines")))
        new.select("path", "generation", "line_no", "line").write.mode("append").parquet(home + "/lines")
