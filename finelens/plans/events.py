"""Event-log jobs on the driver ``events`` table.

Stand-in event log (fixed rules): a run is a ``user_id``, ``seq =
event_id``; driver event types map to the reference's types (view -> info,
click -> warning, signup -> start, purchase -> complete, error -> error);
``k`` of ``props`` picks the category (k % 4 -> training, memory, system,
pipeline) and memory events come from the ``MemoryManager`` source.  The
message is built from the type and ``k``: errors read as CUDA OOM, warnings
with k % 3 = 0 mention fragmentation, infos with k % 3 = 1 are cache clears.
A run's status is FAILED when its last event is an error.

Issues have four further sources, drawn from the same events (``k`` and
``event_id`` decide): stage result documents (purchases; some failed,
interrupted or cut short), lost event files (every twelfth run), the latest
check results of datasets (clicks) and of evaluators (views).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finelens.operators import events as EV
from finelens.operators import metrics as M
from finelens.operators import records as RC
from finelens.plans.metrics import metric_points
from finelens.plans.registry import job
from finelens.sources.tables import Tables

TYPE_OF_EVENT = {"view": "info", "click": "warning", "signup": "start", "purchase": "complete", "error": "error"}
CATEGORIES = ["training", "memory", "system", "pipeline"]


def event_log(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    et = None
    for a, b in TYPE_OF_EVENT.items():
        et = F.when(F.col("event_type") == a, b) if et is None else et.when(F.col("event_type") == a, b)
    et = et.otherwise(F.col("event_type"))
    cat = F.element_at(F.array(*[F.lit(c) for c in CATEGORIES]), (k % 4 + 1).cast("int"))
    ev = t.events.select(
        F.col("user_id").alias("run_id"),
        F.col("event_id").alias("seq"),
        F.col("ts").alias("timestamp"),
        et.alias("event_type"),
        k.alias("k"),
        cat.alias("category"),
    )
    msg = (
        F.when(F.col("event_type") == "error", F.format_string("CUDA OOM during step %d", F.col("seq")))
        .when((F.col("event_type") == "warning") & (F.col("k") % 3 == 0), F.format_string("High fragmentation frag=%d", F.col("k")))
        .when(F.col("event_type") == "warning", F.format_string("Memory usage high (%d)", F.col("k")))
        .when((F.col("event_type") == "info") & (F.col("k") % 3 == 1), F.format_string("Cache cleared after step %d", F.col("seq")))
        .otherwise(F.format_string("%s event %d", F.col("event_type"), F.col("seq")))
    )
    src = F.when(F.col("category") == "memory", F.lit("MemoryManager")).otherwise(F.lit("Trainer"))
    return ev.select(
        "run_id", "seq", "timestamp", "event_type", *EV.severity_cols(F.col("event_type")),
        msg.alias("message"), "category", src.alias("source"), F.col("k").alias("attr_k"),
    )


TYPE_CASE = "CASE event_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in TYPE_OF_EVENT.items()) + " ELSE event_type END"
EV_SQL = f"""ev0 AS (SELECT user_id AS run_id, event_id AS seq, ts AS timestamp, {TYPE_CASE} AS event_type,
  CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
ev AS (SELECT run_id, seq, timestamp, event_type,
  CASE event_type WHEN 'warning' THEN 'WARN' WHEN 'error' THEN 'ERROR' ELSE 'INFO' END AS severity,
  CASE event_type WHEN 'warning' THEN 13 WHEN 'error' THEN 17 ELSE 9 END AS severity_number,
  CASE WHEN event_type = 'error' THEN printf('CUDA OOM during step %d', seq)
       WHEN event_type = 'warning' AND k % 3 = 0 THEN printf('High fragmentation frag=%d', k)
       WHEN event_type = 'warning' THEN printf('Memory usage high (%d)', k)
       WHEN event_type = 'info' AND k % 3 = 1 THEN printf('Cache cleared after step %d', seq)
       ELSE printf('%s event %d', event_type, seq) END AS message,
  ['training', 'memory', 'system', 'pipeline'][k % 4 + 1] AS category,
  CASE WHEN ['training', 'memory', 'system', 'pipeline'][k % 4 + 1] = 'memory' THEN 'MemoryManager' ELSE 'Trainer' END AS source,
  k AS attr_k FROM ev0)"""

MEM_SQL = """mem AS (SELECT *, CASE WHEN lower(message) LIKE '%cache cleared%' THEN 'cache_clear'
    WHEN lower(message) LIKE '%oom%' OR lower(event_type) LIKE '%oom%' THEN 'oom' ELSE event_type END AS memory_event_type
  FROM ev WHERE source = 'MemoryManager'),
mh0 AS (SELECT run_id,
  CAST(count(*) FILTER (WHERE memory_event_type = 'oom') AS BIGINT) AS oom_count,
  CAST(count(*) FILTER (WHERE memory_event_type = 'cache_clear') AS BIGINT) AS cache_clear_count,
  CAST(count(*) FILTER (WHERE memory_event_type IN ('warning', 'critical')) AS BIGINT) AS warning_count,
  CAST(count(*) FILTER (WHERE memory_event_type IN ('warning', 'critical')
    AND (lower(message) LIKE '%fragmentation%' OR lower(message) LIKE '%frag=%')) AS BIGINT) AS frag_warnings,
  CAST(coalesce(sum(attr_k) FILTER (WHERE memory_event_type = 'cache_clear'), 0) AS DOUBLE) AS freed_mb,
  CAST(CASE WHEN run_id % 10 = 0 THEN 1 ELSE 3 END AS BIGINT) AS max_retries
  FROM mem GROUP BY run_id),
mh AS (SELECT *,
  CAST(greatest(0, least(100, 100
    - CASE WHEN oom_count > max_retries THEN 100 WHEN oom_count > 0 THEN 20 * oom_count ELSE 0 END
    - CASE WHEN cache_clear_count > 10 THEN cache_clear_count // 5 ELSE 0 END
    - CASE WHEN warning_count > 5 THEN 30 WHEN warning_count > 3 THEN 10 ELSE 0 END
    - frag_warnings * 5 - CASE WHEN oom_count > 0 THEN 15 ELSE 0 END)) AS BIGINT) AS efficiency_score,
  CASE WHEN oom_count > max_retries THEN 'BAD'
       WHEN oom_count > 0 OR cache_clear_count > 10 OR warning_count > 3 OR frag_warnings > 0 THEN 'WARNING' ELSE 'GOOD' END AS status,
  CASE WHEN oom_count > max_retries THEN 'Critical: OOM loop / failure' WHEN oom_count > 0 THEN 'OOM (recovered)'
       WHEN warning_count > 5 THEN 'Unstable memory' WHEN warning_count > 3 THEN 'Memory pressure'
       WHEN cache_clear_count > 10 THEN 'Warning: high overhead' ELSE 'Healthy' END AS verdict,
  CAST(cache_clear_count * 0.5 AS DOUBLE) AS overhead_seconds
  FROM mh0)"""


@job("events_by_category", sql="WITH " + EV_SQL + " SELECT * FROM ev WHERE category = 'memory'")
def events_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filter the event log by category (pushed into the scan where possible)."""
    return event_log(Tables(spark, sf_dir)).where(F.col("category") == "memory")


@job(
    "event_stats",
    sql="WITH " + EV_SQL + """ SELECT run_id, CAST(count(*) AS BIGINT) AS total_events,
  CAST(count(*) FILTER (WHERE event_type = 'error') AS BIGINT) AS error_count,
  CAST(count(*) FILTER (WHERE event_type = 'warning') AS BIGINT) AS warning_count,
  bool_or(event_type = 'error') AS has_errors,
  least(count(*), 30) AS shown_events, greatest(count(*) - 30, 0) AS hidden_events
FROM ev GROUP BY run_id""",
)
def event_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return EV.event_stats(event_log(Tables(spark, sf_dir)), ["run_id"])


@job("memory_events", sql="WITH " + EV_SQL + ", " + MEM_SQL + " SELECT * FROM mem")
def memory_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return EV.memory_events(event_log(Tables(spark, sf_dir)))


@job("memory_health", sql="WITH " + EV_SQL + ", " + MEM_SQL + " SELECT * FROM mh")
def memory_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health_of_memory(Tables(spark, sf_dir))


def health_of_memory(t: Tables) -> DataFrame:
    """Memory health of every run; every tenth is configured with a single retry, a cache clear frees ``k`` MB."""
    log = event_log(t)
    limits = log.select("run_id").distinct().where(F.col("run_id") % 10 == 0).withColumn("max_retries", F.lit(1))
    return EV.memory_health(EV.memory_events(log).withColumn("freed_mb", F.col("attr_k")), ["run_id"], limits=limits)


def run_status(t: Tables) -> DataFrame:
    ev = event_log(t)
    last = ev.groupBy("run_id").agg(F.max_by("event_type", "seq").alias("_last"))
    return last.select("run_id", F.when(F.col("_last") == "error", "FAILED").otherwise("FINISHED").alias("status"))


def stage_documents(t: Tables) -> DataFrame:
    """Result documents of stages, one JSON text each, some cut short."""
    k, seq = F.get_json_object("props", "$.k").cast("int"), F.col("event_id")
    status = F.when(seq % 23 == 0, "failed").when(seq % 29 == 0, "interrupted").when(seq % 5 == 0, "skipped").otherwise("passed")
    body = F.struct(
        F.concat(F.lit("stage_"), (k % 6).cast("string")).alias("stage"), status.alias("status"),
        F.when(seq % 2 == 0, F.concat(F.lit("stopped at "), seq.cast("string"))).alias("error"),
    )
    text = F.to_json(body)
    return t.events.where((F.col("event_type") == "purchase") & (k % 4 == 0)).select(
        F.col("user_id").alias("run_id"), F.format_string("stage_%d/%d.json", k % 6, seq).alias("artifact"),
        F.when(seq % 31 == 0, F.left(text, F.lit(12))).otherwise(text).alias("doc"),
    )


def missing_artifacts(t: Tables) -> DataFrame:
    """Unreadable stage documents, and the event files of every twelfth run."""
    broken = RC.stage_results(stage_documents(t)).where("stage IS NULL").select("run_id", "artifact")
    lost = t.events.where(F.col("user_id") % 12 == 0).select(F.col("user_id").alias("run_id")).distinct()
    return broken.unionByName(lost.withColumn("artifact", F.lit(EV.EVENTS_ARTIFACT)))


def run_checks_of(t: Tables) -> DataFrame:
    """The latest result of each check of a run's datasets (click events)."""
    k, seq = F.get_json_object("props", "$.k").cast("int"), F.col("event_id")
    rows = t.events.where((F.col("event_type") == "click") & (k % 8 == 0)).select(
        F.col("user_id").alias("run_id"), F.format_string("ds%d", k % 3).alias("dataset"), F.format_string("check_%d", seq % 4).alias("check_id"),
        (10 - seq % 4).alias("priority"), seq.alias("seq"), (seq % 7 != 0).alias("passed"),
    )
    last = rows.groupBy("run_id", "dataset", "check_id", "priority").agg(F.max_by("passed", "seq").alias("passed"))
    return last.withColumn("critical", F.col("run_id") % 2 + 1)


def evaluator_results(t: Tables) -> DataFrame:
    """The latest result of each evaluator of a run (view events)."""
    k, seq = F.get_json_object("props", "$.k").cast("int"), F.col("event_id")
    errors = F.when(seq % 2 == 0, F.array(F.concat(F.lit("e"), seq.cast("string")), F.lit("late")))
    rows = t.events.where((F.col("event_type") == "view") & (k % 16 == 0)).select(
        F.col("user_id").alias("run_id"), F.format_string("eval_%d", k % 5).alias("evaluator"), seq.alias("seq"),
        F.struct((seq % 3 != 0).alias("passed"), errors.alias("errors")).alias("r"),
    )
    return rows.groupBy("run_id", "evaluator").agg(F.max_by("r", "seq").alias("r")).select("run_id", "evaluator", "r.*")


def issues_of(t: Tables) -> DataFrame:
    """Issues per run from its metrics, memory, stages, artifacts, datasets and evaluators."""
    verdicts = M.metric_verdicts(M.trend(metric_points(t), ["run_id", "key"]))
    memory = health_of_memory(t)
    parts = [
        EV.metric_issues(verdicts),
        EV.memory_issues(memory),
        EV.stage_issues(RC.stage_results(stage_documents(t)).where("stage IS NOT NULL")),
        EV.artifact_issues(missing_artifacts(t)),
        EV.dataset_issues(EV.dataset_validation(run_checks_of(t))),
        EV.evaluation_issues(evaluator_results(t)),
    ]
    return reduce(DataFrame.unionByName, parts)


RUN_STATUS_SQL = """rs AS (SELECT run_id, CASE WHEN arg_max(event_type, seq) = 'error' THEN 'FAILED' ELSE 'FINISHED' END AS status
  FROM ev GROUP BY run_id)"""


def issues_sql() -> str:
    from finelens.plans.metrics import MP_SQL, TREND_SQL

    return (
        "WITH " + MP_SQL + ", " + TREND_SQL + ", " + EV_SQL + ", " + MEM_SQL + ", " + RUN_STATUS_SQL + """,
e6 AS (SELECT user_id AS run_id, event_id AS seq, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
env AS (SELECT run_id, seq, 'stage_' || (k % 6) AS stage, seq % 31 = 0 AS broken,
  CASE WHEN seq % 23 = 0 THEN 'failed' WHEN seq % 29 = 0 THEN 'interrupted' END AS status,
  CASE WHEN seq % 2 = 0 THEN 'stopped at ' || seq END AS error FROM e6 WHERE event_type = 'purchase' AND k % 4 = 0),
chk AS (SELECT run_id, 'ds' || (k % 3) AS dataset, seq % 4 AS c, arg_max(seq % 7 <> 0, seq) AS passed
  FROM e6 WHERE event_type = 'click' AND k % 8 = 0 GROUP BY ALL),
val AS (SELECT run_id, dataset, count(*) AS total, count(*) FILTER (WHERE NOT passed) AS failed, run_id % 2 + 1 AS critical,
  string_agg('check_' || c, ', ' ORDER BY c DESC) FILTER (WHERE NOT passed) AS names FROM chk GROUP BY run_id, dataset),
evr AS (SELECT run_id, 'eval_' || (k % 5) AS evaluator, max(seq) AS seq FROM e6 WHERE event_type = 'view' AND k % 16 = 0 GROUP BY ALL),
mv AS (SELECT run_id, key,
  CASE WHEN lower(key) LIKE '%loss%' THEN
      CASE WHEN min_val > 0 AND max_val / min_val > 10 AND NOT (max_val <= first * 1.1) THEN 'WARNING'
           WHEN direction = 'decreased' THEN 'GOOD' WHEN direction = 'increased' AND change_pct < 5.0 THEN 'WARNING'
           WHEN direction = 'increased' THEN 'BAD' ELSE 'NEUTRAL' END
    WHEN lower(key) LIKE '%accuracy%' OR lower(key) LIKE '%accuracies%' THEN
      CASE WHEN direction = 'increased' THEN 'GOOD' WHEN direction = 'decreased' THEN 'BAD' ELSE 'NEUTRAL' END
    WHEN lower(key) LIKE '%grad_norm%' THEN CASE WHEN max_val > first * 10.0 THEN 'WARNING' ELSE 'GOOD' END
    ELSE 'NEUTRAL' END AS status,
  CASE WHEN lower(key) LIKE '%loss%' THEN
      (CASE WHEN direction = 'decreased' THEN 'Improved by ' || printf('%.1f', abs(change_pct)) || '%'
            WHEN direction = 'increased' AND change_pct < 5.0 THEN 'Small increase (noise?)'
            WHEN direction = 'increased' THEN 'Degradation' ELSE 'Stable' END)
      || CASE WHEN min_val > 0 AND max_val / min_val > 10 AND NOT (max_val <= first * 1.1) THEN ' (high volatility)' ELSE '' END
    WHEN lower(key) LIKE '%accuracy%' OR lower(key) LIKE '%accuracies%' THEN
      CASE WHEN direction = 'increased' THEN 'Improving' WHEN direction = 'decreased' THEN 'Worsening' ELSE 'Stable' END
    WHEN lower(key) LIKE '%grad_norm%' THEN CASE WHEN max_val > first * 10.0 THEN 'Spikes detected' ELSE 'Stable gradients' END
    ELSE 'Stable' END AS verdict
  FROM trend),
iss AS (
  SELECT run_id, CASE WHEN status = 'BAD' THEN 'ERROR' ELSE 'WARN' END AS severity, key || ': ' || verdict AS message,
         'Metrics' AS context FROM mv WHERE status IN ('BAD', 'WARNING')
  UNION ALL SELECT run_id, 'WARN', msg, 'Memory' FROM (
    SELECT run_id, unnest([
      CASE WHEN oom_count > max_retries THEN printf('Training failed: %d OOM events (retry limit %d exceeded).', oom_count, max_retries)
           WHEN oom_count > 0 THEN printf('There were %d OOM events, but MemoryManager recovered training.', oom_count) END,
      CASE WHEN cache_clear_count > 10 THEN printf('Memory protection triggered %d times. Approximate time lost: %.1fs.',
           cache_clear_count, cache_clear_count * 0.5) END,
      CASE WHEN warning_count > 5 THEN printf('High number of memory warnings (%d). The system is near its limit.', warning_count) END,
      CASE WHEN frag_warnings > 0 THEN printf('Detected %d high-fragmentation events. Memory is available but fragmented.',
           frag_warnings) END,
      CASE WHEN oom_count > 0 THEN 'Configuration led to OOM events.' END]) AS msg FROM mh) WHERE msg IS NOT NULL
  UNION ALL SELECT run_id, CASE WHEN status = 'failed' THEN 'ERROR' ELSE 'WARN' END,
    CASE WHEN status = 'failed' THEN coalesce(error, 'Stage ''' || stage || ''' failed') ELSE 'Stage ''' || stage || ''' was interrupted' END,
    stage FROM env WHERE NOT broken AND status IN ('failed', 'interrupted')
  UNION ALL SELECT run_id, 'WARN', 'Artifact could not be parsed: ' || stage || '/' || seq || '.json', 'Report Generation' FROM env WHERE broken
  UNION ALL SELECT DISTINCT user_id, 'WARN', '@LOST@', 'Report Generation' FROM events WHERE user_id % 12 = 0
  UNION ALL SELECT run_id, 'WARN', CASE WHEN failed >= critical
      THEN printf('Dataset ''%s'': %d validation plugin(s) failed (%s)', dataset, failed, names)
      ELSE printf('Dataset ''%s'': partial failure (%d/%d plugins failed: %s, below critical threshold of %d)',
                  dataset, failed, total, names, critical) END, 'Dataset Validation' FROM val WHERE failed > 0
  UNION ALL SELECT run_id, 'WARN', 'Evaluation plugin ''' || evaluator || ''' failed: '
    || CASE WHEN seq % 2 = 0 THEN 'e' || seq || ', late' ELSE 'see metrics' END, 'Model Evaluation' FROM evr WHERE seq % 3 = 0)"""
    ).replace("@LOST@", EV.EVENTS_MISSING)


@job("issues", sql=issues_sql() + " SELECT * FROM iss")
def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return issues_of(Tables(spark, sf_dir))


@job(
    "health",
    sql=issues_sql() + """,
cnt AS (SELECT run_id, count(*) FILTER (WHERE severity = 'ERROR') AS e, count(*) FILTER (WHERE severity = 'WARN') AS w
        FROM iss GROUP BY run_id),
j AS (SELECT rs.run_id, rs.status, CAST(coalesce(e, 0) AS BIGINT) AS e, CAST(coalesce(w, 0) AS BIGINT) AS w
      FROM rs LEFT JOIN cnt USING (run_id))
SELECT run_id, status, e AS error_issues, w AS warn_issues,
  CASE WHEN status = 'FAILED' OR e > 0 OR w >= 5 THEN 'RED' WHEN w >= 3 THEN 'YELLOW' ELSE 'GREEN' END AS health,
  CASE WHEN status = 'FAILED' THEN 'Run status: ' || status WHEN e > 0 THEN printf('%d ERROR issue(s)', e)
       WHEN w >= 5 THEN printf('%d WARN issues (>= %d)', w, 5) WHEN w >= 3 THEN printf('%d WARN issues (>= %d)', w, 3)
       ELSE 'No critical issues detected' END AS explanation
FROM j""",
)
def health(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return EV.run_health(run_status(t), issues_of(t), ["run_id"])
