"""Event-log analytics: severity, statistics, memory events, memory health,
issues and run health.  All are per-run aggregations (partial aggregation
before the shuffle) plus ``when`` chains; nothing is collected per run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# fixed values that must equal the reference
# ---------------------------------------------------------------------------
# event type -> (severity text, severity number); anything else is INFO / 9
SEVERITY = {
    "start": ("INFO", 9),
    "complete": ("INFO", 9),
    "info": ("INFO", 9),
    "checkpoint": ("INFO", 9),
    "warning": ("WARN", 13),
    "error": ("ERROR", 17),
}
EVENTS_DISPLAY_LIMIT = 30
OOM_PENALTY_PER_EVENT = 20
WARN_PENALTY_HIGH = 30
WARN_PENALTY_LOW = 10
FRAG_PENALTY = 5
CONFIG_PENALTY = 15  # an OOM means the configuration was too aggressive
CACHE_CLEAR_SECONDS = 0.5
DEFAULT_MAX_RETRIES = 3
WARN_TO_YELLOW, WARN_TO_RED = 3, 5
# insight lines of the memory analysis, in their order
OOM_FAILED = "Training failed: %d OOM events (retry limit %d exceeded)."
OOM_RECOVERED = "There were %d OOM events, but MemoryManager recovered training."
CACHE_LINE = "Memory protection triggered %d times. Approximate time lost: %.1fs."
WARN_LINE = "High number of memory warnings (%d). The system is near its limit."
FRAG_LINE = "Detected %d high-fragmentation events. Memory is available but fragmented."
CONFIG_LINE = "Configuration led to OOM events."
# issue lines of stages, artifacts, datasets and evaluators
STAGE_FAILED, STAGE_INTERRUPTED = "Stage '%s' failed", "Stage '%s' was interrupted"
EVENTS_ARTIFACT = "training_events.json"
EVENTS_MISSING = (
    "Training events (training_events.json) were not found in MLflow artifacts. "
    "This may indicate network connectivity issues to the MLflow server during training. "
    "Check: (1) MLflow is reachable at the configured tracking_uri from the remote PC, "
    "(2) IP addresses in the configuration match the current network."
)
ARTIFACT_BROKEN = "Artifact could not be parsed: %s"
DATASET_FAILED = "Dataset '%s': %d validation plugin(s) failed (%s)"
DATASET_PARTIAL = "Dataset '%s': partial failure (%d/%d plugins failed: %s, below critical threshold of %d)"
EVALUATOR_FAILED, EVALUATOR_NO_ERRORS = "Evaluation plugin '%s' failed: %s", "see metrics"


def severity_cols(event_type: Column) -> list[Column]:
    text = F.lit("INFO")
    num = F.lit(9)
    for k, (s, n) in SEVERITY.items():
        text = F.when(event_type == k, F.lit(s)).otherwise(text)
        num = F.when(event_type == k, F.lit(n)).otherwise(num)
    return [text.alias("severity"), num.alias("severity_number")]


def event_stats(events: DataFrame, by: list[str], order: str = "seq", limit: int = EVENTS_DISPLAY_LIMIT) -> DataFrame:
    """total, errors, warnings, has_errors, shown / hidden counts of the timeline."""
    agg = events.groupBy(*by).agg(
        F.count(F.lit(1)).cast("bigint").alias("total_events"),
        F.count_if(F.col("event_type") == "error").cast("bigint").alias("error_count"),
        F.count_if(F.col("event_type") == "warning").cast("bigint").alias("warning_count"),
        F.max(F.col("event_type") == "error").alias("has_errors"),
        F.max(order).alias("last_seq"),
    )
    return agg.select(
        *by,
        "total_events",
        "error_count",
        "warning_count",
        "has_errors",
        F.least(F.col("total_events"), F.lit(limit)).alias("shown_events"),
        F.greatest(F.col("total_events") - limit, F.lit(0)).alias("hidden_events"),
    )


def memory_events(events: DataFrame) -> DataFrame:
    """Events of the memory manager, typed from their message."""
    msg = F.lower(F.coalesce(F.col("message"), F.lit("")))
    et = F.coalesce(F.col("event_type"), F.lit("info"))
    mtype = (
        F.when(msg.contains("cache cleared"), F.lit("cache_clear"))
        .when(msg.contains("oom") | F.lower(et).contains("oom"), F.lit("oom"))
        .otherwise(et)
    )
    return events.where(F.col("source") == "MemoryManager").withColumn("memory_event_type", mtype)


def memory_health(
    mem_events: DataFrame, by: list[str], max_retries: int = DEFAULT_MAX_RETRIES, limits: DataFrame | None = None
) -> DataFrame:
    """Efficiency score, status and verdict per run from its memory events.

    ``limits`` (by, max_retries): the retry limits that runs were configured with, ``max_retries`` elsewhere.
    Where events carry ``freed_mb``, what cache clears have freed is summed.
    """
    freed = F.coalesce(F.col("freed_mb"), F.lit(0)) if "freed_mb" in mem_events.columns else F.lit(0)
    t = F.col("memory_event_type")
    msg = F.lower(F.col("message"))
    is_warn = t.isin("warning", "critical")
    agg = mem_events.groupBy(*by).agg(
        F.count_if(t == "oom").cast("bigint").alias("oom_count"),
        F.count_if(t == "cache_clear").cast("bigint").alias("cache_clear_count"),
        F.count_if(is_warn).cast("bigint").alias("warning_count"),
        F.count_if(is_warn & (msg.contains("fragmentation") | msg.contains("frag="))).cast("bigint").alias("frag_warnings"),
        F.sum(F.when(t == "cache_clear", freed).otherwise(0)).cast("double").alias("freed_mb"),
    )
    limit = F.lit(max_retries).cast("bigint")
    if limits is None:
        agg = agg.withColumn("max_retries", limit)
    else:
        own = limits.select(*by, F.col("max_retries").cast("bigint").alias("max_retries"))
        agg = agg.join(own, by, "left").withColumn("max_retries", F.coalesce("max_retries", limit))
    max_retries = F.col("max_retries")
    oom, cc, wc, fw = (F.col(c) for c in ("oom_count", "cache_clear_count", "warning_count", "frag_warnings"))
    score = (
        F.lit(100)
        - F.when(oom > max_retries, 100).when(oom > 0, OOM_PENALTY_PER_EVENT * oom).otherwise(0)
        - F.when(cc > 10, F.floor(cc / 5)).otherwise(0)
        - F.when(wc > 5, WARN_PENALTY_HIGH).when(wc > 3, WARN_PENALTY_LOW).otherwise(0)
        - fw * FRAG_PENALTY
        - F.when(oom > 0, CONFIG_PENALTY).otherwise(0)
    )
    bad = oom > max_retries
    warn = (oom > 0) | (cc > 10) | (wc > 3) | (fw > 0)
    status = F.when(bad, "BAD").when(warn, "WARNING").otherwise("GOOD")
    # later rules overwrite the verdict only when there was no OOM
    verdict = (
        F.when(bad, "Critical: OOM loop / failure")
        .when(oom > 0, "OOM (recovered)")
        .when(wc > 5, "Unstable memory")
        .when(wc > 3, "Memory pressure")
        .when(cc > 10, "Warning: high overhead")
        .otherwise("Healthy")
    )
    return agg.select(
        "*",
        F.greatest(F.lit(0), F.least(F.lit(100), score)).cast("bigint").alias("efficiency_score"),
        status.alias("status"),
        verdict.alias("verdict"),
        (cc * CACHE_CLEAR_SECONDS).alias("overhead_seconds"),
    )


def memory_insights(health: DataFrame, by: list[str]) -> DataFrame:
    """The insight lines of the memory analysis, one row each (in order)."""
    max_retries = F.col("max_retries")
    oom, cc, wc, fw = (F.col(c) for c in ("oom_count", "cache_clear_count", "warning_count", "frag_warnings"))
    lines = F.array(
        F.when(oom > max_retries, F.format_string(OOM_FAILED, oom, max_retries))
        .when(oom > 0, F.format_string(OOM_RECOVERED, oom)),
        F.when(cc > 10, F.format_string(CACHE_LINE, cc, cc * CACHE_CLEAR_SECONDS)),
        F.when(wc > 5, F.format_string(WARN_LINE, wc)),
        F.when(fw > 0, F.format_string(FRAG_LINE, fw)),
        F.when(oom > 0, F.lit(CONFIG_LINE)),
    )
    return health.select(*by, F.posexplode(lines).alias("pos", "message")).where(F.col("message").isNotNull())


def _issue(run: str, severity: Column, message: Column, context: Column) -> list[Column]:
    return [F.col(run), severity.alias("severity"), message.alias("message"), context.alias("context")]


def metric_issues(verdicts: DataFrame, run: str = "run_id") -> DataFrame:
    """BAD metric verdicts are errors, WARNING ones warnings."""
    bad = verdicts.where(F.col("status").isin("BAD", "WARNING"))
    severity = F.when(F.col("status") == "BAD", "ERROR").otherwise("WARN")
    return bad.select(*_issue(run, severity, F.concat_ws(": ", "key", "verdict"), F.lit("Metrics")))


def memory_issues(health: DataFrame, run: str = "run_id") -> DataFrame:
    """The insight lines of the memory analysis, each a warning."""
    return memory_insights(health, [run]).select(*_issue(run, F.lit("WARN"), F.col("message"), F.lit("Memory")))


def stage_issues(envelopes: DataFrame, run: str = "run_id") -> DataFrame:
    """A failed stage is an error with its own text where it has one, an interrupted one a warning.

    ``envelopes``: run, stage, status, error.
    """
    stage, failed = F.col("stage"), F.col("status") == "failed"
    own = F.when(F.col("error") != "", F.col("error"))
    message = F.when(failed, F.coalesce(own, F.format_string(STAGE_FAILED, stage))).otherwise(F.format_string(STAGE_INTERRUPTED, stage))
    rows = envelopes.where(F.col("status").isin("failed", "interrupted"))
    return rows.select(*_issue(run, F.when(failed, "ERROR").otherwise("WARN"), message, stage))


def artifact_issues(missing: DataFrame, run: str = "run_id") -> DataFrame:
    """Training events that are not there, and artifacts that cannot be read.

    ``missing``: run, artifact.  An artifact of a stage that did not run is none of them.
    """
    name = F.col("artifact")
    message = F.when(name == EVENTS_ARTIFACT, EVENTS_MISSING).otherwise(F.format_string(ARTIFACT_BROKEN, name))
    return missing.select(*_issue(run, F.lit("WARN"), message, F.lit("Report Generation")))


def dataset_validation(checks: DataFrame, run: str = "run_id") -> DataFrame:
    """Per (run, dataset): total, failed, critical, the failed checks' names by priority, status.

    ``checks``: run, dataset, check_id, priority, passed, critical: one row a check, a handful a dataset.
    """
    rows = checks.groupBy(run, "dataset").agg(
        F.count(F.lit(1)).cast("bigint").alias("total"),
        F.count_if(~F.col("passed")).cast("bigint").alias("failed"),
        F.max("critical").cast("bigint").alias("critical"),
        F.array_sort(F.collect_list(F.when(~F.col("passed"), F.struct("priority", "check_id")))).alias("_names"),
    )
    names = F.array_join(F.transform("_names", lambda c: c["check_id"]), ", ")
    status = F.when(F.col("failed") >= F.col("critical"), "failed").otherwise("passed")
    return rows.select(run, "dataset", "total", "failed", "critical", names.alias("names"), status.alias("status"))


def dataset_issues(validation: DataFrame, run: str = "run_id") -> DataFrame:
    """Datasets that failed, and those with failures below the critical number."""
    name, failed, names = F.col("dataset"), F.col("failed"), F.col("names")
    message = F.when(F.col("status") == "failed", F.format_string(DATASET_FAILED, name, failed, names)).otherwise(
        F.format_string(DATASET_PARTIAL, name, failed, F.col("total"), names, F.col("critical"))
    )
    rows = validation.where((F.col("status") == "failed") | ((failed > 0) & (failed < F.col("critical"))))
    return rows.select(*_issue(run, F.lit("WARN"), message, F.lit("Dataset Validation")))


def evaluation_issues(results: DataFrame, run: str = "run_id") -> DataFrame:
    """Evaluators that did not pass, with their errors.  ``results``: run, evaluator, passed, errors (array)."""
    errors = F.array_join(F.coalesce("errors", F.array().cast("array<string>")), ", ")
    message = F.format_string(
        EVALUATOR_FAILED, F.col("evaluator"), F.when(errors != "", errors).otherwise(EVALUATOR_NO_ERRORS)
    )
    rows = results.where(~F.coalesce("passed", F.lit(False)))
    return rows.select(*_issue(run, F.lit("WARN"), message, F.lit("Model Evaluation")))


def run_health(run_status: DataFrame, issues: DataFrame, by: list[str]) -> DataFrame:
    """GREEN / YELLOW / RED with explanation from run status and issue severities."""
    counts = issues.groupBy(*by).agg(
        F.count_if(F.col("severity") == "ERROR").alias("error_issues"),
        F.count_if(F.col("severity") == "WARN").alias("warn_issues"),
    )
    j = run_status.join(counts, by, "left").fillna(0, ["error_issues", "warn_issues"])
    e, w = F.col("error_issues"), F.col("warn_issues")
    failed = F.col("status") == "FAILED"
    health = F.when(failed | (e > 0) | (w >= WARN_TO_RED), "RED").when(w >= WARN_TO_YELLOW, "YELLOW").otherwise("GREEN")
    why = (
        F.when(failed, F.concat(F.lit("Run status: "), F.col("status")))
        .when(e > 0, F.format_string("%d ERROR issue(s)", e))
        .when(w >= WARN_TO_RED, F.format_string("%d WARN issues (>= %d)", w, F.lit(WARN_TO_RED)))
        .when(w >= WARN_TO_YELLOW, F.format_string("%d WARN issues (>= %d)", w, F.lit(WARN_TO_YELLOW)))
        .otherwise("No critical issues detected")
    )
    return j.select(*by, "status", e.cast("bigint").alias("error_issues"), w.cast("bigint").alias("warn_issues"),
                    health.alias("health"), why.alias("explanation"))
