"""Run-analytics jobs on the driver ``events`` table.

Stand-ins: a run is a ``user_id``; metric points are its events with
``key`` renamed from ``event_type`` (fixed table below), ``step = seq =
event_id``, ``ts_ms`` the event time in epoch milliseconds.  Phases of a run
are its days (epoch day number) spanning the first to the last ``signup``
event of that day; most are a single instant, the short-phase case the
nearest-point fallback exists for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finelens.operators import metrics as M
from finelens.plans.registry import job
from finelens.sources.tables import Tables, epoch_ms

# fixed stand-in key names: event_type -> metric key
KEY_OF_EVENT = {
    "view": "train_loss",
    "click": "eval_accuracy",
    "signup": "grad_norm",
    "purchase": "system/gpu_0_memory_usage_megabytes",
    "error": "system/gpu_0_utilization_percentage",
}
DAY_MS = 24 * 3600 * 1000
GPU_MEM_KEY = "system/gpu_0_memory_usage_megabytes"


def _key_expr(col: str = "event_type"):
    e = None
    for k, v in KEY_OF_EVENT.items():
        e = F.when(F.col(col) == k, v) if e is None else e.when(F.col(col) == k, v)
    return e.otherwise(F.col(col))


def metric_points(t: Tables) -> DataFrame:
    return t.events.select(
        F.col("user_id").alias("run_id"),
        _key_expr().alias("key"),
        F.col("event_id").alias("step"),
        epoch_ms("ts").alias("ts_ms"),
        "value",
        F.col("event_id").alias("seq"),
    )


def phases(t: Tables) -> DataFrame:
    ms = epoch_ms("ts")
    return (
        t.events.where(F.col("event_type") == "signup")
        .select(F.col("user_id").alias("run_id"), ms.alias("ts_ms"))
        .groupBy("run_id", F.floor(F.col("ts_ms") / DAY_MS).alias("phase_idx"))
        .agg(F.min("ts_ms").alias("start_ms"), F.max("ts_ms").alias("end_ms"))
    )


KEY_CASE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in KEY_OF_EVENT.items()) + " ELSE event_type END"
MP_SQL = f"""mp AS (SELECT user_id AS run_id, {KEY_CASE} AS key, event_id AS step, (epoch_us(ts) // 1000) AS ts_ms,
  value, event_id AS seq FROM events)"""
PH_SQL = f"""ph AS (SELECT user_id AS run_id, CAST(floor((epoch_us(ts) // 1000) / {DAY_MS}) AS BIGINT) AS phase_idx,
  min((epoch_us(ts) // 1000)) AS start_ms, max((epoch_us(ts) // 1000)) AS end_ms
  FROM events WHERE event_type = 'signup' GROUP BY 1, 2)"""
TREND_SQL = """tr AS (SELECT run_id, key, arg_min(value, seq) AS first, arg_max(value, seq) AS last,
  min(value) AS min_val, max(value) AS max_val, CAST(count(*) AS BIGINT) AS data_points FROM mp GROUP BY run_id, key),
tr2 AS (SELECT *, CASE WHEN first <> 0 THEN (last - first) / first * 100.0 ELSE 0.0 END AS change_pct FROM tr),
trend AS (SELECT *, CASE WHEN change_pct < -5.0 THEN 'decreased' WHEN change_pct > 5.0 THEN 'increased'
  ELSE 'stable' END AS direction FROM tr2)"""


@job("metric_trend", sql="WITH " + MP_SQL + ", " + TREND_SQL + " SELECT * FROM trend")
def metric_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.trend(metric_points(Tables(spark, sf_dir)), ["run_id", "key"])


#: One key or more for each of the twelve families of verdicts, and one of none.
FAMILY_KEYS = [
    "train_loss", "mean_token_accuracy", "grad_norm", "learning_rate", "train_samples_per_second", "entropy", "total_flos",
    "rewards/margins", "reward", "kl", "completion_length", "logps/chosen", "logps/rejected", "epoch",
]
FAMILY_SQL = f"""mp AS (SELECT user_id AS run_id, {FAMILY_KEYS}[(user_id + event_id) % {len(FAMILY_KEYS)} + 1] AS key, event_id AS step,
  epoch_us(ts) // 1000 AS ts_ms, value * CASE WHEN (user_id + event_id) % {len(FAMILY_KEYS)} = 6 THEN pow(1000.0, 2 + user_id % 4) ELSE 1 END AS value,
  event_id AS seq FROM events)"""


def family_points(t: Tables) -> DataFrame:
    """Points whose keys run through all families; the counts of operations span all their units."""
    at = (F.col("user_id") + F.col("event_id")) % len(FAMILY_KEYS)
    scale = F.when(at == FAMILY_KEYS.index("total_flos"), F.pow(F.lit(1000.0), 2 + F.col("user_id") % 4)).otherwise(1.0)
    return t.events.select(
        F.col("user_id").alias("run_id"), F.get(F.array(*map(F.lit, FAMILY_KEYS)), at.cast("int")).alias("key"),
        F.col("event_id").alias("step"), epoch_ms("ts").alias("ts_ms"), (F.col("value") * scale).alias("value"), F.col("event_id").alias("seq"),
    )


VERDICT_SQL = """r AS (SELECT *, lower(key) AS k, direction = 'increased' AS inc, direction = 'decreased' AS dec,
  min_val > 0 AND max_val / min_val > 10 AND NOT (max_val <= first * 1.1) AS volatile FROM trend)
SELECT * EXCLUDE (k, inc, dec, volatile),
  CASE WHEN k LIKE '%loss%' THEN CASE WHEN volatile THEN 'WARNING' WHEN dec THEN 'GOOD' WHEN inc AND change_pct < 5.0 THEN 'WARNING'
         WHEN inc THEN 'BAD' ELSE 'NEUTRAL' END
    WHEN k LIKE '%accuracy%' OR k LIKE '%accuracies%' THEN CASE WHEN inc THEN 'GOOD' WHEN dec THEN 'BAD' ELSE 'NEUTRAL' END
    WHEN k LIKE '%grad_norm%' THEN CASE WHEN max_val > first * 10.0 THEN 'WARNING' ELSE 'GOOD' END
    WHEN k LIKE '%learning_rate%' OR k LIKE '%per_second%' THEN 'NEUTRAL'
    WHEN k LIKE '%entropy%' THEN CASE WHEN dec THEN 'GOOD' WHEN inc THEN 'WARNING' ELSE 'NEUTRAL' END
    WHEN k LIKE '%flos%' THEN 'NEUTRAL'
    WHEN k LIKE '%margin%' THEN CASE WHEN inc THEN 'GOOD' WHEN dec THEN 'WARNING' ELSE 'NEUTRAL' END
    WHEN k LIKE '%reward%' THEN CASE WHEN inc THEN 'GOOD' WHEN dec THEN 'BAD' ELSE 'NEUTRAL' END
    WHEN k LIKE '%kl%' THEN CASE WHEN max_val > 10.0 THEN 'WARNING' WHEN inc THEN 'NEUTRAL' ELSE 'GOOD' END
    WHEN k LIKE '%logp%' AND k LIKE '%rejected%' AND dec THEN 'GOOD' ELSE 'NEUTRAL' END AS status,
  CASE WHEN k LIKE '%loss%' THEN CASE WHEN dec THEN 'Improved by ' || printf('%.1f', abs(change_pct)) || '%'
         WHEN inc AND change_pct < 5.0 THEN 'Small increase (noise?)' WHEN inc THEN 'Degradation' ELSE 'Stable' END
         || CASE WHEN volatile THEN ' (high volatility)' ELSE '' END
    WHEN k LIKE '%accuracy%' OR k LIKE '%accuracies%' THEN CASE WHEN inc THEN 'Improving' WHEN dec THEN 'Worsening' ELSE 'Stable' END
    WHEN k LIKE '%grad_norm%' THEN CASE WHEN max_val > first * 10.0 THEN 'Spikes detected' ELSE 'Stable gradients' END
    WHEN k LIKE '%learning_rate%' THEN 'Follows schedule'
    WHEN k LIKE '%per_second%' THEN '~' || printf('%.1f', last) || ' samples/sec'
    WHEN k LIKE '%entropy%' THEN CASE WHEN dec THEN 'Model becoming more confident' WHEN inc THEN 'Rising model uncertainty' ELSE 'Stable confidence' END
    WHEN k LIKE '%flos%' THEN CASE WHEN last >= 1e15 THEN printf('%.2f', last / 1e15) || ' PFLOPs' WHEN last >= 1e12 THEN printf('%.2f', last / 1e12) || ' TFLOPs'
         WHEN last >= 1e9 THEN printf('%.2f', last / 1e9) || ' GFLOPs' ELSE printf('%.0f', last) || ' FLOPs' END
    WHEN k LIKE '%margin%' THEN CASE WHEN inc THEN 'Margin increasing (confidence)' WHEN dec THEN 'Margin decreasing' ELSE 'Stable' END
    WHEN k LIKE '%reward%' THEN CASE WHEN inc THEN 'Reward increasing (training progressing)' WHEN dec THEN 'Reward decreasing (degradation)'
         ELSE 'Stable reward' END
    WHEN k LIKE '%kl%' THEN CASE WHEN max_val > 10.0 THEN 'High divergence (mode collapse risk)' WHEN inc THEN 'Divergence increasing (normal)'
         ELSE 'Stable' END
    WHEN k LIKE '%length%' THEN '~' || printf('%.0f', last) || ' tokens'
    WHEN k LIKE '%logp%' AND k LIKE '%chosen%' AND dec THEN 'Decreasing (expected for DPO)'
    WHEN k LIKE '%logp%' AND k LIKE '%rejected%' AND dec THEN 'Model picks rejected less often' ELSE 'Stable' END AS verdict
FROM r"""


@job("metric_verdict", sql="WITH " + FAMILY_SQL + ", " + TREND_SQL + ", " + VERDICT_SQL)
def metric_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status and verdict of every metric of every run, over keys of all families."""
    return M.metric_verdicts(M.trend(family_points(Tables(spark, sf_dir)), ["run_id", "key"]))


PCT_SQL = """SELECT run_id, key, avg(value) AS avg, min(value) AS min_val, max(value) AS max_val,
  list_sort(list(value))[CAST(least(floor(count(*) * 0.95), count(*) - 1) AS BIGINT) + 1] AS p95,
  list_sort(list(value))[CAST(least(floor(count(*) * 0.99), count(*) - 1) AS BIGINT) + 1] AS p99,
  CAST(count(*) AS BIGINT) AS data_points"""


@job("percentile_stats", sql="WITH " + MP_SQL + " " + PCT_SQL + " FROM mp WHERE value IS NOT NULL GROUP BY run_id, key")
def percentile_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """avg, min, max, p95, p99 (index rule) and n per (run, metric)."""
    return M.index_percentiles(metric_points(Tables(spark, sf_dir)), ["run_id", "key"])


@job(
    "resource_summary",
    sql="WITH " + MP_SQL + " " + PCT_SQL + " FROM mp WHERE value IS NOT NULL AND key LIKE 'system/%' GROUP BY run_id, key",
)
def resource_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentile stats of the system metrics of each run (run-level series)."""
    pts = metric_points(Tables(spark, sf_dir)).where(F.col("key").startswith("system/"))
    return M.index_percentiles(pts, ["run_id", "key"])


SLICE_SQL = """SELECT ph.run_id, ph.phase_idx, mp.key, mp.step, mp.ts_ms, mp.value, mp.seq
FROM ph JOIN mp ON mp.run_id = ph.run_id AND mp.ts_ms BETWEEN ph.start_ms AND ph.end_ms"""

NEAREST_SQL = """keys AS (SELECT DISTINCT run_id, key FROM mp),
pairs AS (SELECT ph.run_id, ph.phase_idx, ph.start_ms, ph.end_ms, keys.key FROM ph JOIN keys USING (run_id)),
inside AS (SELECT DISTINCT ph.run_id, ph.phase_idx, mp.key FROM ph JOIN mp
           ON mp.run_id = ph.run_id AND mp.ts_ms BETWEEN ph.start_ms AND ph.end_ms),
empty AS (SELECT p.* FROM pairs p ANTI JOIN inside i USING (run_id, phase_idx, key)),
cand AS (SELECT e.run_id, e.phase_idx, e.key, mp.step, mp.ts_ms, mp.value, mp.seq,
           abs(mp.ts_ms - (e.start_ms + e.end_ms) / CAST(2 AS DOUBLE)) AS distance_ms
         FROM empty e JOIN mp ON mp.run_id = e.run_id AND mp.key = e.key),
nearest AS (SELECT * FROM cand WHERE distance_ms < 30000
  QUALIFY row_number() OVER (PARTITION BY run_id, phase_idx, key ORDER BY distance_ms, seq) = 1)"""


@job("slice_by_phase", sql="WITH " + MP_SQL + ", " + PH_SQL + " " + SLICE_SQL)
def slice_by_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return M.slice_by_phase(metric_points(t), phases(t))


#: The stand-in's points are minutes apart; on a clock this much faster some lie within the fixed 30 s of a phase.
FAST_CLOCK = 600
FAST_SQL = f"""mp AS (SELECT * REPLACE (ts_ms // {FAST_CLOCK} AS ts_ms) FROM mp0),
ph AS (SELECT * REPLACE (start_ms // {FAST_CLOCK} AS start_ms, end_ms // {FAST_CLOCK} AS end_ms) FROM ph0)"""
FAST_SQL = MP_SQL.replace("mp AS", "mp0 AS", 1) + ", " + PH_SQL.replace("ph AS", "ph0 AS", 1) + ", " + FAST_SQL


def fast_points(t: Tables) -> DataFrame:
    return metric_points(t).withColumn("ts_ms", F.expr(f"ts_ms div {FAST_CLOCK}"))


def fast_phases(t: Tables) -> DataFrame:
    return phases(t).withColumn("start_ms", F.expr(f"start_ms div {FAST_CLOCK}")).withColumn("end_ms", F.expr(f"end_ms div {FAST_CLOCK}"))


@job("slice_nearest", sql="WITH " + FAST_SQL + ", " + NEAREST_SQL + " SELECT * FROM nearest")
def slice_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return M.slice_nearest(fast_points(t), fast_phases(t))


@job(
    "phase_resource_fill",
    sql="WITH " + FAST_SQL + ", " + NEAREST_SQL + """
SELECT s.*, 'slice' AS source FROM (""" + SLICE_SQL + """) s
UNION ALL SELECT run_id, phase_idx, key, step, ts_ms, value, seq, 'nearest' FROM nearest""",
)
def phase_resource_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return M.phase_resource_fill(fast_points(t), fast_phases(t))


@job(
    "memory_by_phase",
    sql="WITH " + FAST_SQL + ", " + NEAREST_SQL + f""",
fill AS (SELECT s.run_id, s.phase_idx, s.key, s.value FROM ({SLICE_SQL}) s
         UNION ALL SELECT run_id, phase_idx, key, value FROM nearest)
SELECT run_id, phase_idx,
  CAST(trunc(max(value)) AS BIGINT) AS peak_mb, CAST(trunc(avg(value)) AS BIGINT) AS avg_mb,
  CAST(trunc(list_sort(list(value))[CAST(least(floor(count(*) * 0.95), count(*) - 1) AS BIGINT) + 1]) AS BIGINT) AS p95_mb,
  CAST(trunc(list_sort(list(value))[CAST(least(floor(count(*) * 0.99), count(*) - 1) AS BIGINT) + 1]) AS BIGINT) AS p99_mb,
  CAST(count(*) AS BIGINT) AS data_points
FROM fill WHERE key = '{GPU_MEM_KEY}' GROUP BY run_id, phase_idx""",
)
def memory_by_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peak / average / p95 / p99 GPU memory (MB, truncated to int) per phase."""
    t = Tables(spark, sf_dir)
    fill = M.phase_resource_fill(fast_points(t), fast_phases(t)).where(F.col("key") == GPU_MEM_KEY)
    st = M.index_percentiles(fill, ["run_id", "phase_idx"])
    as_int = lambda c: F.col(c).cast("bigint")  # noqa: E731  (int() truncation)
    return st.select(
        "run_id",
        "phase_idx",
        as_int("max_val").alias("peak_mb"),
        as_int("avg").alias("avg_mb"),
        as_int("p95").alias("p95_mb"),
        as_int("p99").alias("p99_mb"),
        "data_points",
    )
