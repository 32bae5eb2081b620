"""Reports as tables: many sections, one commit.

A report's sections are written one after another into a version's folder,
each by its own Spark job, with a table of sections beside them; then the
version is committed.  Readers see the last committed version and nothing of
one that is being written.  A section that fails leaves no rows and an error in
the table of sections; the others are as good as ever.  Writing a report again
replaces it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from finelens.sources.commits import CommitLog

SECTIONS_SCHEMA = "section string, pos int, status string, error string"
#: Versions before the last that are kept for readers who have begun with them.
KEEP_VERSIONS = 1
_ERROR_CHARS = 500


class ReportStore:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _log(self, report_id: str) -> CommitLog:
        return CommitLog(self.spark, f"{self.folder}/report={report_id}")

    def write(self, report_id: str, sections: dict[str, Callable[[], DataFrame]]) -> int:
        """Write all sections and commit them; the number of the version."""
        log = self._log(report_id)
        latest = log.latest()
        number = 0 if latest is None else latest + 1
        home = log.version(number)
        log.clear(home)
        rows = []
        for pos, (name, make) in enumerate(sections.items()):
            place = f"{home}/section={name}"
            try:
                make().write.parquet(place)
                rows.append((name, pos, "ok", None))
            except Exception as e:  # noqa: BLE001  whatever a section's job raises is its row
                log.clear(place)
                rows.append((name, pos, "failed", f"{type(e).__name__}: {e}"[:_ERROR_CHARS]))
        self.spark.createDataFrame(rows, SECTIONS_SCHEMA).coalesce(1).write.parquet(f"{home}/sections")
        log.commit(number)
        for old in log.numbers()[: -1 - KEEP_VERSIONS]:
            log.clear(log.version(old))
        return number

    def sections(self, report_id: str) -> DataFrame:
        """section, pos, status, error of the report as last committed."""
        return self.spark.read.schema(SECTIONS_SCHEMA).parquet(f"{self._home(report_id)}/sections")

    def read(self, report_id: str, section: str) -> DataFrame:
        """The rows of a section as last committed."""
        return self.spark.read.parquet(f"{self._home(report_id)}/section={section}")

    def _home(self, report_id: str) -> str:
        log = self._log(report_id)
        number = log.latest()
        if number is None:
            raise FileNotFoundError(f"no report {report_id} in {self.folder}")
        return log.version(number)
