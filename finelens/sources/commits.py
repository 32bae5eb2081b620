"""Versions of a result that readers see whole or not at all.

A folder holds versions and a log of commits.  A writer fills a version's
folder and then creates the commit file; file systems create it under its
final name in one step, so a reader finds either the version before or the new one.
What a writer leaves without a commit is never read, and replaced when the same
number is written again.  Paths are those of Spark's file systems.
"""

from __future__ import annotations

from pyspark.sql import SparkSession


class CommitLog:
    """Commits of one folder, numbered from 0."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.log = f"{self.folder}/_commits"
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        """Committed numbers, ascending."""
        log = self._path(self.log)
        if not self.fs.exists(log):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(log)]
        return sorted(int(n) for n in names if n.isdigit())

    def latest(self) -> int | None:
        return max(self.numbers(), default=None)

    def version(self, number: int) -> str:
        """The folder of a version, committed or not."""
        return f"{self.folder}/version={number}"

    def commit(self, number: int) -> None:
        """Make a version visible; fails if another writer has committed the number."""
        self.fs.mkdirs(self._path(self.log))
        draft = self._path(f"{self.log}/.{number}")
        self.fs.create(draft, True).close()
        if self.fs.exists(self._path(f"{self.log}/{number}")) or not self.fs.rename(draft, self._path(f"{self.log}/{number}")):
            raise RuntimeError(f"version {number} of {self.folder} was committed by another writer")

    def clear(self, path: str) -> None:
        """Remove what an unfinished write has left at ``path``."""
        self.fs.delete(self._path(path), True)

    def exists(self, path: str) -> bool:
        return self.fs.exists(self._path(path))
