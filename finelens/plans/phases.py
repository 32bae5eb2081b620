"""Jobs on training phases.

Stand-ins (fixed rules):

* training events: driver ``events``; run = ``user_id``, ``seq = event_id``; source
  ``PhaseExecutor`` where ``k`` is even, else ``DataBuffer``; ``signup`` -> ``start``,
  ``purchase`` -> ``Complete``, others ``info``.  Attributes are a JSON text: ``phase_idx``
  = ``k % 5`` (broken where ``k % 17 = 0``, absent where ``k % 19 = 0``), a strategy name where
  ``k % 3 = 0`` (under the other key where ``k % 6 = 0``, empty where ``k % 7 = 0``), and the
  metrics of a phase, some of them no numbers.  Time texts are ISO, broken where ``k % 13 = 0``.
* root params: a run's strategy names, learning rate and batch size (absent for some runs).
* phase series: the run's metric points, dealt to its phases by ``step % 5``; ``view`` points
  are ``loss`` where the run is even, else ``train_loss``; ``click`` and ``error`` are CPU
  and GPU use, ``purchase`` memory.
* run tree: that of ``plans/runs.py`` with nations as roots; customers are containers or leaves,
  every second customer has params, orders with a key divisible by 7 neither metrics nor params.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finelens.operators import phases as P
from finelens.plans.registry import job
from finelens.plans.runs import TREE_SQL, run_tree
from finelens.sources.tables import Tables

def training_events(t: Tables) -> DataFrame:
    e = t.events.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), "ts", "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))
    k = F.col("k")
    kind = F.when(F.col("event_type") == "signup", "start").when(F.col("event_type") == "purchase", "Complete").otherwise("info")
    name = F.when(k % 7 == 0, "").when(k % 2 == 0, "sft").otherwise("dpo")
    fields = F.struct(
        F.when(k % 19 != 0, F.when(k % 17 == 0, F.lit("x")).otherwise((k % 5).cast("string"))).alias("phase_idx"),
        F.when((k % 3 == 0) & (k % 6 != 0), name).alias("strategy_type"),
        F.when(k % 6 == 0, name).alias("strategy"),
        F.when(k % 11 == 0, "n/a").otherwise((F.col("seq") % 100 / 50.0).cast("string")).alias("train_loss"),
        F.when(k % 10 == 0, (F.col("seq") % 10 / 4.0).cast("string")).alias("loss"),
        (k % 4).cast("string").alias("epoch"),
        F.col("seq").cast("string").alias("global_step"),
        F.when(k % 23 == 0, (F.col("seq") % 1000 / 8.0).cast("string")).alias("train_runtime"),
        (F.col("seq") % 3).cast("string").alias("train_samples_per_second"),
        F.when(k % 8 == 0, (k / 1024.0).cast("string")).alias("learning_rate"),
    )
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS")
    return e.select(
        "run_id", "seq", F.when(k % 2 == 0, P.EXECUTOR_SOURCE).otherwise("DataBuffer").alias("source"), kind.alias("event_type"),
        F.when(k % 13 == 0, "soon").otherwise(F.concat(stamp, F.lit("Z"))).alias("timestamp"),
        F.from_json(F.to_json(fields), "map<string,string>").alias("attributes"),
    )


def root_params(t: Tables) -> DataFrame:
    runs = t.events.select(F.col("user_id").alias("run_id")).distinct()
    r = F.col("run_id")
    pairs = F.create_map(
        F.lit("config.strategy.1.type"), F.lit("cpt"),
        F.lit("config.strategy.2.hyperparams.learning_rate"), F.lit("0.5"),
        F.lit("learning_rate"), F.when(r % 3 == 0, "").otherwise("0.25"),
        F.lit("training.hyperparams.per_device_train_batch_size"), F.when(r % 4 == 0, "many").otherwise(r.cast("string")),
    )
    return runs.where(r % 5 != 0).select("run_id", pairs.alias("params"))


EVENTS_SQL = """te0 AS (SELECT user_id AS run_id, event_id AS seq, ts, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
  FROM events),
te AS (SELECT run_id, seq, CASE event_type WHEN 'signup' THEN 'start' WHEN 'purchase' THEN 'complete' ELSE 'info' END AS kind,
  k % 2 = 0 AS executor, CASE WHEN k % 13 <> 0 THEN epoch_us(ts) // 1000 END AS ms, k % 5 AS phase_idx,
  CASE WHEN k % 3 = 0 AND k % 7 <> 0 THEN CASE WHEN k % 2 = 0 THEN 'sft' ELSE 'dpo' END END AS strategy,
  CASE WHEN k % 11 <> 0 THEN seq % 100 / 50.0 END AS train_loss, CASE WHEN k % 10 = 0 THEN seq % 10 / 4.0 END AS loss,
  CAST(k % 4 AS DOUBLE) AS epoch, CAST(seq AS DOUBLE) AS global_step, CASE WHEN k % 23 = 0 THEN seq % 1000 / 8.0 END AS train_runtime,
  CAST(seq % 3 AS DOUBLE) AS train_samples_per_second, CAST(NULL AS DOUBLE) AS train_steps_per_second,
  CASE WHEN k % 8 = 0 THEN k / 1024.0 END AS learning_rate
  FROM te0 WHERE k % 19 <> 0 AND k % 17 <> 0)"""
_DONE = ", ".join(
    f"arg_max({c}, seq) FILTER (WHERE executor AND kind = 'complete' AND {c} IS NOT NULL) AS {c if c != 'learning_rate' else 'rate'}"
    for c in P.SCALARS
)
PHASES_SQL = EVENTS_SQL + f""",
folded AS (SELECT run_id, phase_idx, arg_max(strategy, seq) FILTER (WHERE strategy IS NOT NULL) AS named,
  arg_max(ms, seq) FILTER (WHERE executor AND kind = 'start' AND ms IS NOT NULL) AS start_ms,
  arg_max(ms, seq) FILTER (WHERE executor AND kind = 'complete' AND ms IS NOT NULL) AS end_ms, {_DONE}
  FROM te GROUP BY run_id, phase_idx),
ep0 AS (SELECT *, coalesce(named, CASE WHEN run_id % 5 <> 0 AND phase_idx = 1 THEN 'cpt' END, 'unknown') AS s FROM folded),
ep AS (SELECT run_id, CAST(phase_idx AS BIGINT) AS phase_idx, 'phase_' || phase_idx || '_' || s AS name, upper(s) AS strategy,
  'FINISHED' AS status,
  coalesce(train_runtime, CASE WHEN start_ms IS NOT NULL AND end_ms IS NOT NULL THEN greatest(0.0, (end_ms - start_ms) / 1000.0) END, 0.0)
    AS duration_seconds, start_ms, end_ms,
  coalesce(CASE WHEN rate <> 0 THEN rate END, CASE WHEN run_id % 5 <> 0 AND phase_idx = 2 THEN 0.5
    WHEN run_id % 5 <> 0 AND run_id % 3 <> 0 THEN 0.25 END) AS learning_rate,
  CASE WHEN run_id % 5 <> 0 AND run_id % 4 <> 0 THEN run_id END AS batch_size, train_loss, loss, epoch, global_step, train_runtime,
  train_samples_per_second, train_steps_per_second FROM ep0)"""


def event_phases(t: Tables) -> DataFrame:
    return P.phases_from_events(training_events(t), root_params(t))


@job("phases_from_events", sql="WITH " + PHASES_SQL + " SELECT * FROM ep")
def phases_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phases of every run, rebuilt from its start and complete events."""
    return event_phases(Tables(spark, sf_dir))


FLAT_SQL = "WITH " + TREE_SQL + """,
r AS (SELECT run_id, parent_run_id, run_name, start_ms, depth,
  (train_loss IS NOT NULL AND CAST(substr(run_id, 2) AS BIGINT) % 7 <> 0) OR (depth = 2 AND CAST(substr(run_id, 2) AS BIGINT) % 2 = 0)
    AS used FROM runs),
child AS (SELECT p.run_id AS root_run_id, c.* FROM r p JOIN r c ON c.parent_run_id = p.run_id WHERE p.depth = 1),
kinds AS (SELECT parent_run_id AS run_id, bool_or(contains(run_name, 'phase_')) AS some_phase FROM r
          WHERE parent_run_id IS NOT NULL GROUP BY 1),
flat AS (
  SELECT root_run_id, coalesce(start_ms, 0) AS a0, run_id AS a1, 0 AS a2, '' AS a3, CAST(NULL AS VARCHAR) AS container_id, run_id, run_name, used
  FROM child ANTI JOIN kinds USING (run_id)
  UNION ALL
  SELECT c.root_run_id, coalesce(c.start_ms, 0), c.run_id, coalesce(g.start_ms, 0), g.run_id, c.run_id, g.run_id, g.run_name, g.used
  FROM child c JOIN kinds k USING (run_id) JOIN r g ON g.parent_run_id = c.run_id
  WHERE NOT k.some_phase OR contains(g.run_name, 'phase_'))
SELECT root_run_id, phase_idx, run_id, run_name, container_id FROM (
  SELECT *, row_number() OVER (PARTITION BY root_run_id ORDER BY a0, a1, a2, a3) - 1 AS phase_idx FROM flat) WHERE used"""


@job("flatten_phases", sql=FLAT_SQL)
def flatten_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phase runs of every nation: through its customers where they have orders, else the customers themselves."""
    tree = run_tree(Tables(spark, sf_dir))
    key = F.substring("run_id", 2, 20).cast("bigint")
    runs = tree.select(
        "run_id", "parent_run_id", "run_name", "start_ms",
        (F.col("train_loss").isNotNull() & (key % 7 != 0)).alias("has_metrics"),
        ((F.col("depth") == 2) & (key % 2 == 0)).alias("has_params"),
    )
    return P.flatten_phases(runs, tree.where(F.col("depth") == 1).select("run_id"))


def phase_series(t: Tables) -> DataFrame:
    et, run = F.col("event_type"), F.col("user_id")
    key = (
        F.when(et == "view", F.when(run % 2 == 0, "loss").otherwise("train_loss"))
        .when(et == "click", P.RESOURCES["cpu_utilization"])
        .when(et == "error", P.RESOURCES["gpu_utilization"])
        .when(et == "purchase", P.RESOURCES["gpu_memory_mb"])
    )
    return t.events.where(key.isNotNull()).select(
        run.alias("run_id"), (F.col("event_id") % 5).alias("phase_idx"), key.alias("key"), F.col("event_id").alias("seq"), "value"
    )


TABLE_SQL = PHASES_SQL + """,
ser AS (SELECT user_id AS run_id, event_id % 5 AS phase_idx, event_type, event_id AS seq, value FROM events),
lt0 AS (SELECT run_id, phase_idx, arg_min(value, seq) AS first, arg_max(value, seq) AS last FROM ser WHERE event_type = 'view' GROUP BY ALL),
lt AS (SELECT *, CASE WHEN first <> 0 THEN (last - first) / first * 100.0 ELSE 0.0 END AS pct FROM lt0),
res AS (SELECT run_id, phase_idx, avg(value) FILTER (WHERE event_type = 'error') AS gpu_utilization,
  avg(value) FILTER (WHERE event_type = 'purchase') AS gpu_memory_mb, avg(value) FILTER (WHERE event_type = 'click') AS cpu_utilization
  FROM ser GROUP BY ALL),
pt AS (SELECT ep.run_id, ep.phase_idx, name, strategy, status, duration_seconds,
  coalesce(CASE WHEN train_loss <> 0 THEN train_loss END, loss) AS final_loss,
  lt.first AS loss_first, lt.last AS loss_last, lt.pct AS loss_change_pct,
  CASE WHEN pct < -5.0 THEN 'decreased' WHEN pct > 5.0 THEN 'increased' ELSE 'stable' END AS loss_direction,
  epoch AS epochs, CAST(trunc(coalesce(global_step, 0)) AS BIGINT) AS steps, train_samples_per_second AS samples_per_second,
  gpu_utilization, gpu_memory_mb, CAST(NULL AS DOUBLE) AS gpu_memory_percent, cpu_utilization,
  CAST(NULL AS DOUBLE) AS system_memory_mb, CAST(NULL AS DOUBLE) AS system_memory_percent
  FROM ep LEFT JOIN lt USING (run_id, phase_idx) LEFT JOIN res USING (run_id, phase_idx))"""


def table_of(t: Tables) -> DataFrame:
    return P.phase_table(event_phases(t), phase_series(t))


@job("phase_table", sql="WITH " + TABLE_SQL + " SELECT * FROM pt")
def phase_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every phase of every run with its loss, trend, steps, throughput and mean resource use."""
    return table_of(Tables(spark, sf_dir))


SUMMARY_SQL = TABLE_SQL + """,
sm AS (SELECT run_id, count(*) AS phases, CAST(trunc(sum(coalesce(epochs, 0.0))) AS BIGINT) AS total_epochs,
  CAST(sum(steps) AS BIGINT) AS total_steps, avg(samples_per_second) FILTER (WHERE samples_per_second <> 0) AS samples_per_second,
  arg_max(final_loss, phase_idx) FILTER (WHERE true) AS loss0, sum(duration_seconds) AS duration_seconds,
  list(strategy ORDER BY phase_idx) AS strategy_chain, max(phase_idx) AS last_idx FROM pt GROUP BY run_id)"""


@job("summary", sql="WITH " + SUMMARY_SQL + """
SELECT sm.run_id, phases, total_epochs, total_steps, sm.samples_per_second, pt.final_loss, sm.duration_seconds, strategy_chain,
  CASE WHEN sm.duration_seconds < 60 THEN printf('%.1fs', sm.duration_seconds)
       ELSE printf('%dm %ds', CAST(floor(sm.duration_seconds / 60) AS BIGINT), CAST(floor(sm.duration_seconds % 60) AS BIGINT)) END
    AS duration_formatted
FROM sm JOIN pt ON pt.run_id = sm.run_id AND pt.phase_idx = last_idx""")
def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of each run over its phases, and its chain of strategies."""
    return P.run_summary(table_of(Tables(spark, sf_dir))).withColumn(
        "duration_formatted", P.duration_text(F.col("duration_seconds"))
    )


@job("summary_by_strategy", sql="WITH " + TABLE_SQL + """
SELECT run_id, phase_idx, strategy, coalesce(printf('%.4f', final_loss), '—') AS train_loss,
  coalesce(printf('%.4f → %.4f', loss_first, loss_last), '—') AS step_loss, coalesce(CAST(epochs AS VARCHAR), '—') AS epochs,
  CAST(steps AS VARCHAR) AS steps, CASE WHEN duration_seconds <> 0 THEN printf('%.1fs', duration_seconds) ELSE '—' END AS time
FROM pt""")
def summary_by_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of each phase's line in a report."""
    return P.phase_lines(table_of(Tables(spark, sf_dir)))
