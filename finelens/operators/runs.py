"""Run catalogs: run trees, attempts, resume points, lineage, log tails.

Trees are walked with a bounded number of self-joins (the reference reads
at most three levels below a root), never with driver loops over runs.
"Latest per key" is ``max_by`` (an aggregation with partial combine, so a
hot key is not a single window partition); per-group top-N uses
``row_number() <= n`` which Spark plans with a partial group limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finelens.functions.text import py_strip
from finelens.operators.ordering import with_position

# fixed values that must equal the reference
RESUME_STATUSES = ("failed", "interrupted", "pending", "running", "stale")
LOG_TAIL_LINES = 30


def children(runs: DataFrame) -> DataFrame:
    """Each run with its parent (self equi-join on ``parent_run_id``)."""
    p = runs.select(F.col("run_id").alias("parent_run_id"), F.col("run_name").alias("parent_name"))
    c = runs.where(F.col("parent_run_id").isNotNull()).select("parent_run_id", "run_id", "run_name", "start_ms")
    return c.join(p, "parent_run_id")


def descendants(runs: DataFrame, roots: DataFrame, max_depth: int) -> DataFrame:
    """(root_run_id, run_id, depth) for every run up to ``max_depth`` below a root.

    A run met again on a cycle of parents is not followed a second time.
    """
    edges = runs.where(F.col("parent_run_id").isNotNull()).select(F.col("parent_run_id").alias("_p"), "run_id")
    frontier = roots.select(F.col("run_id").alias("root_run_id"), F.col("run_id").alias("_p"), F.array("run_id").alias("_seen"))
    out = None
    for depth in range(1, max_depth + 1):
        level = frontier.join(edges, "_p").where(~F.array_contains("_seen", F.col("run_id")))
        level = level.select("root_run_id", "run_id", F.lit(depth).alias("depth"), F.array_append("_seen", F.col("run_id")).alias("_seen"))
        out = level if out is None else out.unionByName(level)
        frontier = level.select("root_run_id", F.col("run_id").alias("_p"), "_seen")
    return out.drop("_seen")


def phase_runs(runs: DataFrame, roots: DataFrame, max_depth: int) -> DataFrame:
    """Descendant runs named ``phase_*`` that carry metrics."""
    d = descendants(runs, roots, max_depth)
    r = runs.where(F.col("run_name").startswith("phase_") & F.col("train_loss").isNotNull())
    return d.join(r.drop("depth"), "run_id")


def training_rollup(phases: DataFrame, by: str = "root_run_id") -> DataFrame:
    """final loss = last non-zero loss (by start, then id), total steps and runtime."""
    truthy = F.col("train_loss").isNotNull() & (F.col("train_loss") != 0)
    order = F.struct("start_ms", "run_id")
    return phases.groupBy(by).agg(
        F.max_by(F.when(truthy, F.col("train_loss")), F.when(truthy, order)).alias("final_loss"),
        F.sum("global_step").cast("bigint").alias("total_steps"),
        F.sum("train_runtime").alias("total_runtime"),
        F.count(F.lit(1)).cast("bigint").alias("phases"),
    )


def best_run(runs: DataFrame, by: str, metric: str, mode: str = "min") -> DataFrame:
    """Top-1 run per group by a metric (ties by run_id) as one aggregation."""
    r = runs.where(F.col(metric).isNotNull())
    key = F.struct(F.col(metric), F.col("run_id")) if mode == "min" else F.struct((-F.col(metric)), F.col("run_id"))
    return r.groupBy(by).agg(F.min_by(F.struct("run_id", "run_name", metric), key).alias("b")).select(by, "b.*")


def resume_stage(attempts: DataFrame, stage_runs: DataFrame) -> DataFrame:
    """First enabled stage of each run's latest attempt that is missing or not finished.

    ``attempts`` carries the attempt's own ``enabled_stages``; attempt numbers count per run.
    """
    latest = attempts.groupBy("run_id").agg(
        F.max("attempt_no").alias("attempt_no"), F.max_by("enabled_stages", "attempt_no").alias("enabled")
    )
    stages = latest.select("run_id", "attempt_no", F.posexplode("enabled").alias("pos", "stage_name"))
    own = stage_runs.select("run_id", "attempt_no", "stage_name", "status")
    j = stages.join(own, ["run_id", "attempt_no", "stage_name"], "left")
    pending = j.where(F.col("status").isNull() | F.col("status").isin(*RESUME_STATUSES))
    first = pending.groupBy("run_id").agg(F.min_by("stage_name", "pos").alias("resume_stage"))
    return latest.join(first, "run_id", "left").select("run_id", "attempt_no", "resume_stage")


def attempt_state(attempts: DataFrame) -> DataFrame:
    """Next attempt number (max + 1) and the last running attempt."""
    return attempts.groupBy("run_id").agg(
        (F.max("attempt_no") + 1).alias("next_attempt_no"),
        F.max(F.when(F.col("status") == "running", F.col("attempt_no"))).alias("running_attempt_no"),
        F.count(F.lit(1)).cast("bigint").alias("attempts"),
        F.max_by("status", "attempt_no").alias("status"),
        F.min("started_at").alias("first_started_at"),
        F.max("completed_at").alias("last_completed_at"),
    )


def latest_lineage(updates: DataFrame) -> DataFrame:
    """Latest output per (run, stage), equal ``seq`` by action and output; a removal drops the stage."""
    last = updates.groupBy("run_id", "stage_name").agg(F.max(F.struct("seq", "action", "output")).alias("l"))
    return last.where(F.col("l.action") != "remove").select("run_id", "stage_name", "l.output", F.col("l.seq").alias("seq"))


def log_tail(lines: DataFrame, n: int = LOG_TAIL_LINES) -> DataFrame:
    w = Window.partitionBy("file").orderBy(F.col("line_no").desc())
    return lines.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def folder_rollup(runs: DataFrame, path: str = "path") -> DataFrame:
    """Per folder prefix: descendant run count and newest start."""
    parts = F.split(F.col(path), "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    ex = runs.where(F.size(parts) > 1).select(F.explode(prefixes).alias("folder"), "start_ms")
    return ex.groupBy("folder").agg(F.count(F.lit(1)).cast("bigint").alias("runs"), F.max("start_ms").alias("newest_start_ms"))


ROOT_GROUP = "(root)"  # fixed value


def grouped_by_folder(runs: DataFrame) -> DataFrame:
    """Runs by the first folder of their path: grp, position (newest first), run_id, status, start_ms, runs, newest_start_ms."""
    parts = F.split("path", "/")
    rows = runs.withColumn("grp", F.when(F.size(parts) > 1, F.get(parts, F.lit(0))).otherwise(ROOT_GROUP)).drop("path")
    sizes = rows.groupBy("grp").agg(F.count(F.lit(1)).cast("bigint").alias("runs"), F.max("start_ms").alias("newest_start_ms"))
    placed = with_position(rows, ["grp"], [F.col("start_ms").desc(), F.col("run_id")], "position")
    return placed.join(sizes, "grp").select("grp", "position", "run_id", "status", "start_ms", "runs", "newest_start_ms")


def checkpoint_retention(ckpts: DataFrame, keep_last: int = 2) -> DataFrame:
    """Checkpoints beyond the newest ``keep_last`` per phase by numeric step (the final one is kept).

    Only the newest few of a phase are ranked (a group limit in the map tasks); the step of the
    last one kept is the bound for all others.  Of checkpoints at that step, those with the
    smaller names stay.
    """
    rows = ckpts.where(F.col("name") != "final")
    w = Window.partitionBy("phase").orderBy(F.col("step").desc(), "name")
    top = rows.select("phase", "step", "name").withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= keep_last)
    bound = top.groupBy("phase").agg(F.min("step").alias("_bound"))
    kept = top.groupBy("phase", "step", "name").agg(F.count(F.lit(1)).alias("_kept"))
    below = rows.join(bound, "phase").where(F.col("step") < F.col("_bound")).drop("_bound")
    # repeated rows of the last step: as many go as are not kept
    edge = rows.join(bound.withColumnRenamed("_bound", "step"), ["phase", "step"]).groupBy("phase", "step", "name").agg(F.count(F.lit(1)).alias("_n"))
    left = edge.join(kept, ["phase", "step", "name"], "left").withColumn("_n", F.col("_n") - F.coalesce("_kept", F.lit(0)))
    left = left.where("_n > 0").withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))))
    return below.select("phase", "step", "name").unionByName(left.select("phase", "step", "name"))


# ---------------------------------------------------------------------------
# last error of a log
# ---------------------------------------------------------------------------
FAILURE_MARKS = ("pipeline failed:", "configuration error:")  # fixed values, as are the patterns below
ERROR_MARK = "error:"


def clean_log_error(message: Column) -> Column:
    """The meaningful part of an error line: without level, pipeline prefix, stage and error codes."""
    out = F.regexp_replace(message, r"^(?:ERROR|WARNING|INFO)\s*-\s*", "")
    for prefix in ("Pipeline failed: ", "pipeline failed: "):
        out = F.when(out.startswith(prefix), F.substring(out, len(prefix) + 1, 1 << 30)).otherwise(out)
    out = F.regexp_replace(out, r"^([\s\S]*?)Stage '[^']+' failed:\s*", "$1")
    return py_strip(F.regexp_replace(out, r"\[[A-Z_]+\]\s*", ""))


def _without_stamp(line: Column) -> Column:
    """A stripped line; of one that begins with a digit and has two wide gaps, what follows the second."""
    s = py_strip(line)
    parts = F.split(s, "  ", 3)
    return F.when(s.rlike("^[0-9]") & (F.size(parts) >= 3), py_strip(F.get(parts, F.lit(2)))).otherwise(s)


def _depth(line: Column) -> Column:
    return F.length(F.regexp_replace(line, "[^{]", "")) - F.length(F.regexp_replace(line, "[^}]", ""))


def last_error(lines: DataFrame) -> DataFrame:
    """The last error of each file: file, line_no, message.

    ``lines``: file, line_no, line.  It is the last line with a failure mark, with the lines that
    follow it until its braces are closed; without one, the last line that names an error.  Only in
    files whose failure line leaves a brace open are the lines behind it looked at, in order.
    """
    low = F.lower("line")
    marked = low.contains(FAILURE_MARKS[0]) | low.contains(FAILURE_MARKS[1])
    at = lambda cond: F.max_by("line", F.when(cond, F.col("line_no")))
    last = lines.where(marked | low.contains(ERROR_MARK)).groupBy("file").agg(
        F.max(F.when(marked, F.col("line_no"))).alias("_at"), at(marked).alias("_line"), F.max("line_no").alias("_any_at"), F.max_by("line", "line_no").alias("_any")
    )
    failed = F.col("_at").isNotNull()
    head = last.select(
        "file", F.coalesce("_at", "_any_at").alias("line_no"), _without_stamp(F.when(failed, F.col("_line")).otherwise(F.col("_any"))).alias("_head"),
        F.when(failed, _depth(_without_stamp(F.col("_line")))).otherwise(0).alias("_open"),
    )
    open_ = head.where("_open > 0").select("file", F.col("line_no").alias("_from"), "_open")
    after = lines.join(open_, "file").where(F.col("line_no") > F.col("_from")).select("file", "line_no", py_strip(F.col("line")).alias("_text"), "_open")
    before = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    rest = after.withColumn("_still", F.col("_open") + F.coalesce(F.sum(_depth(F.col("_text"))).over(before), F.lit(0)))
    # up to the line that closes the last brace: no line behind one at which nothing was open
    ended = rest.where("_still <= 0").groupBy("file").agg(F.min("line_no").alias("_end"))
    rest = rest.join(ended, "file", "left").where(F.col("_end").isNull() | (F.col("line_no") < F.col("_end")))
    more = rest.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("line_no", "_text"))).alias("_more"))
    tail = F.transform(F.coalesce("_more", F.array().cast("array<struct<line_no:bigint,_text:string>>")), lambda x: x["_text"])
    j = head.join(more, "file", "left")
    return j.select("file", "line_no", clean_log_error(F.array_join(F.concat(F.array("_head"), tail), "\n")).alias("message"))


def duration_hms(started: Column, ended: Column) -> Column:
    """``1h 2m 3s`` between two times, without leading zero parts; blank without a start or where it would be negative."""
    s = (F.unix_timestamp(ended.cast("timestamp")) - F.unix_timestamp(started.cast("timestamp"))).cast("bigint")
    h, m, r = F.floor(s / 3600), F.floor(s / 60) % 60, s % 60
    text = F.when(h > 0, F.format_string("%dh %dm %ds", h, m, r)).when(m > 0, F.format_string("%dm %ds", m, r)).otherwise(F.format_string("%ds", r))
    return F.when(s >= 0, text).otherwise("")
