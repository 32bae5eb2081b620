"""Run-catalog jobs.

Stand-ins (fixed rules):

* run tree: ``region`` (roots, depth 0) -> ``nation`` -> ``customer`` ->
  ``orders`` (depth 3).  Customer runs are named ``phase_<key>`` when
  ``c_custkey % 3 = 0``; order runs ``phase_<key>`` when finished (``F``).
  Order runs carry metrics: ``train_loss = o_totalprice / 100000``,
  ``global_step`` = its line count, ``train_runtime`` = its total quantity;
  status F/O/P -> FINISHED/RUNNING/FAILED; start = order date.
* attempts: one per order, ``run_id = o_custkey``, ``attempt_no =
  o_orderkey``, status F/O/P -> completed/running/failed.
* stage runs: one per line item, stage ``stage_<linenumber>``; status from
  (returnflag, linestatus); stages stage_1..stage_7 are enabled.
* lineage updates: line items, run = supplier, removal when returnflag = R.
* log lines: documents split on newlines, file = source; the first line of
  a document with ``doc_id % 41 = 0`` is an error line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from finelens.operators import runs as R
from finelens.plans.registry import job
from finelens.sources.tables import Tables, epoch_ms

ENABLED_STAGES = [f"stage_{i}" for i in range(1, 8)]


def run_tree(t: Tables) -> DataFrame:
    li = t.lineitem.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).cast("bigint").alias("global_step"), F.sum("l_quantity").alias("train_runtime")
    )
    null_d, null_l, null_s = F.lit(None).cast("double"), F.lit(None).cast("bigint"), F.lit(None).cast("string")
    regions = t.region.select(
        F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("run_id"), null_s.alias("parent_run_id"),
        F.col("r_name").alias("run_name"), F.lit(0).alias("depth"), null_l.alias("start_ms"), F.lit("FINISHED").alias("status"),
        null_d.alias("train_loss"), null_l.alias("global_step"), null_d.alias("train_runtime"),
    )
    nations = t.nation.select(
        F.concat(F.lit("n"), F.col("n_nationkey").cast("string")), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")),
        F.col("n_name"), F.lit(1), null_l, F.lit("FINISHED"), null_d, null_l, null_d,
    ).toDF(*regions.columns)
    customers = t.customer.select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")),
        F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("phase_"), F.col("c_custkey").cast("string")))
        .otherwise(F.concat(F.lit("cust_"), F.col("c_custkey").cast("string"))),
        F.lit(2), null_l, F.lit("FINISHED"), null_d, null_l, null_d,
    ).toDF(*regions.columns)
    o = t.orders.join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    orders = o.select(
        F.concat(F.lit("o"), F.col("o_orderkey").cast("string")), F.concat(F.lit("c"), F.col("o_custkey").cast("string")),
        F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("phase_"), F.col("o_orderkey").cast("string")))
        .otherwise(F.concat(F.lit("order_"), F.col("o_orderkey").cast("string"))),
        F.lit(3), epoch_ms("o_orderdate"),
        F.when(F.col("o_orderstatus") == "F", "FINISHED").when(F.col("o_orderstatus") == "O", "RUNNING").otherwise("FAILED"),
        F.col("o_totalprice") / F.lit(100000.0), F.coalesce("global_step", F.lit(0)).cast("bigint"),
        F.coalesce("train_runtime", F.lit(0.0)),
    ).toDF(*regions.columns)
    return regions.unionByName(nations).unionByName(customers).unionByName(orders)


TREE_SQL = """li AS (SELECT l_orderkey, count(*) AS global_step, sum(l_quantity) AS train_runtime FROM lineitem GROUP BY l_orderkey),
runs AS (
  SELECT 'r' || r_regionkey AS run_id, CAST(NULL AS VARCHAR) AS parent_run_id, r_name AS run_name, 0 AS depth,
         CAST(NULL AS BIGINT) AS start_ms, 'FINISHED' AS status, CAST(NULL AS DOUBLE) AS train_loss,
         CAST(NULL AS BIGINT) AS global_step, CAST(NULL AS DOUBLE) AS train_runtime FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name, 1, NULL, 'FINISHED', NULL, NULL, NULL FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey,
         CASE WHEN c_custkey % 3 = 0 THEN 'phase_' || c_custkey ELSE 'cust_' || c_custkey END, 2, NULL, 'FINISHED', NULL, NULL, NULL
         FROM customer
  UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey,
         CASE WHEN o_orderstatus = 'F' THEN 'phase_' || o_orderkey ELSE 'order_' || o_orderkey END, 3,
         epoch_us(o_orderdate) // 1000,
         CASE o_orderstatus WHEN 'F' THEN 'FINISHED' WHEN 'O' THEN 'RUNNING' ELSE 'FAILED' END,
         o_totalprice / 100000.0, CAST(coalesce(global_step, 0) AS BIGINT), coalesce(train_runtime, 0.0)
         FROM orders LEFT JOIN li ON o_orderkey = l_orderkey)"""

DESC_SQL = """d1 AS (SELECT p.run_id AS root_run_id, c.run_id, 1 AS depth FROM runs p JOIN runs c ON c.parent_run_id = p.run_id
                WHERE p.depth = 0),
d2 AS (SELECT d.root_run_id, c.run_id, 2 AS depth FROM d1 d JOIN runs c ON c.parent_run_id = d.run_id),
d3 AS (SELECT d.root_run_id, c.run_id, 3 AS depth FROM d2 d JOIN runs c ON c.parent_run_id = d.run_id),
desc_all AS (SELECT * FROM d1 UNION ALL SELECT * FROM d2 UNION ALL SELECT * FROM d3),
phase_runs AS (SELECT d.root_run_id, d.depth, r.* EXCLUDE (depth) FROM desc_all d JOIN runs r USING (run_id)
               WHERE starts_with(r.run_name, 'phase_') AND r.train_loss IS NOT NULL)"""


#: Levels below a root in the stand-in tree (region, nation, customer, order).
TREE_DEPTH = 3


def _roots(tree: DataFrame) -> DataFrame:
    return tree.where(F.col("depth") == 0).select("run_id")


@job("run_children", sql="WITH " + TREE_SQL + """
SELECT c.parent_run_id, c.run_id, c.run_name, c.start_ms, p.run_name AS parent_name
FROM runs c JOIN runs p ON c.parent_run_id = p.run_id""")
def run_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.children(run_tree(Tables(spark, sf_dir)))


@job("run_descendants", sql="WITH " + TREE_SQL + ", " + DESC_SQL + """
SELECT root_run_id, run_id, depth, run_name FROM phase_runs""")
def run_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phase runs (name phase_*, with metrics) up to three levels below each root."""
    tree = run_tree(Tables(spark, sf_dir))
    return R.phase_runs(tree, _roots(tree), TREE_DEPTH).select("root_run_id", "run_id", "depth", "run_name")


@job("training_rollup", sql="WITH " + TREE_SQL + ", " + DESC_SQL + """
SELECT root_run_id,
  arg_max(train_loss, (start_ms, run_id)) FILTER (WHERE train_loss IS NOT NULL AND train_loss <> 0) AS final_loss,
  CAST(sum(global_step) AS BIGINT) AS total_steps, sum(train_runtime) AS total_runtime, CAST(count(*) AS BIGINT) AS phases
FROM phase_runs GROUP BY root_run_id""")
def training_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = run_tree(Tables(spark, sf_dir))
    return R.training_rollup(R.phase_runs(tree, _roots(tree), TREE_DEPTH))


EXP_SQL = """exp AS (SELECT o.run_id, o.run_name, o.status, o.train_loss, o.global_step, o.train_runtime, o.start_ms,
  r.run_name AS experiment
  FROM runs o JOIN runs c ON o.parent_run_id = c.run_id JOIN runs n ON c.parent_run_id = n.run_id
  JOIN runs r ON n.parent_run_id = r.run_id WHERE o.depth = 3)"""


def experiment_runs(tree: DataFrame) -> DataFrame:
    """Order runs with the name of their root as the experiment."""
    up = tree.select(F.col("run_id").alias("_pid"), F.col("parent_run_id").alias("_pp"), F.col("run_name").alias("_pn"))
    o = tree.where(F.col("depth") == 3)
    c = o.join(up.withColumnRenamed("_pp", "_c_parent"), o["parent_run_id"] == F.col("_pid")).drop("_pid", "_pn")
    n = c.join(up.withColumnRenamed("_pp", "_n_parent"), F.col("_c_parent") == F.col("_pid")).drop("_pid", "_pn")
    r = n.join(up.select(F.col("_pid"), F.col("_pn").alias("experiment")), F.col("_n_parent") == F.col("_pid"))
    return r.select("run_id", "run_name", "status", "train_loss", "global_step", "train_runtime", "start_ms", "experiment")


@job("best_run", sql="WITH " + TREE_SQL + ", " + EXP_SQL + """
SELECT experiment, arg_min(run_id, (train_loss, run_id)) AS run_id, arg_min(run_name, (train_loss, run_id)) AS run_name,
  min(train_loss) AS train_loss
FROM exp WHERE train_loss IS NOT NULL GROUP BY experiment""")
def best_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run with the lowest loss per experiment (one aggregation, no sort of all runs)."""
    return R.best_run(experiment_runs(run_tree(Tables(spark, sf_dir))), "experiment", "train_loss")


@job("experiment_summary", sql="WITH " + TREE_SQL + ", " + EXP_SQL + """
SELECT experiment, metric, CAST(count(*) AS BIGINT) AS runs, min(v) AS min_val, max(v) AS max_val, avg(v) AS mean_val
FROM (SELECT experiment, 'train_loss' AS metric, train_loss AS v FROM exp
      UNION ALL SELECT experiment, 'train_runtime', train_runtime FROM exp
      UNION ALL SELECT experiment, 'global_step', CAST(global_step AS DOUBLE) FROM exp) WHERE v IS NOT NULL
GROUP BY experiment, metric""")
def experiment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per experiment and metric: run count, min, max, mean (nulls ignored)."""
    e = experiment_runs(run_tree(Tables(spark, sf_dir)))
    long = e.select(
        "experiment",
        F.explode(F.array(
            F.struct(F.lit("train_loss").alias("metric"), F.col("train_loss").alias("v")),
            F.struct(F.lit("train_runtime").alias("metric"), F.col("train_runtime").alias("v")),
            F.struct(F.lit("global_step").alias("metric"), F.col("global_step").cast("double").alias("v")),
        )).alias("m"),
    ).select("experiment", "m.metric", "m.v").where(F.col("v").isNotNull())
    return long.groupBy("experiment", "metric").agg(
        F.count(F.lit(1)).cast("bigint").alias("runs"), F.min("v").alias("min_val"), F.max("v").alias("max_val"),
        F.avg("v").alias("mean_val"),
    )


@job("search_runs", sql="WITH " + TREE_SQL + """
SELECT run_id, run_name, train_loss FROM runs WHERE status = 'FINISHED' AND train_loss < 2.0
ORDER BY train_loss, run_id LIMIT 100""")
def search_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filter + order + limit (the limit is the operator's max_results)."""
    tree = run_tree(Tables(spark, sf_dir))
    q = tree.where((F.col("status") == "FINISHED") & (F.col("train_loss") < 2.0))
    return q.orderBy("train_loss", "run_id").limit(100).select("run_id", "run_name", "train_loss")


@job("metric_history", sql="""SELECT user_id AS run_id, event_id AS seq, epoch_us(ts) // 1000 AS ts_ms, value
FROM events WHERE event_type = 'view'""")
def metric_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All points of one metric (train_loss) of every run; the filter reaches the scan."""
    from finelens.plans.metrics import metric_points

    mp = metric_points(Tables(spark, sf_dir))
    return mp.where(F.col("key") == "train_loss").select("run_id", "seq", "ts_ms", "value")


# ---------------------------------------------------------------------------
# attempts, stage runs, lineage
# ---------------------------------------------------------------------------
def attempts(t: Tables) -> DataFrame:
    st = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "running").otherwise("failed")
    per_run = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    last = (F.lit(3) + F.col("o_orderkey") % 5).cast("int")
    return t.orders.select(
        F.col("o_custkey").alias("run_id"), F.row_number().over(per_run).alias("attempt_no"), st.alias("status"),
        F.col("o_orderdate").alias("started_at"),
        F.when(F.col("o_orderstatus") != "O", F.expr("timestampadd(DAY, o_orderkey % 5, o_orderdate)")).alias("completed_at"),
        F.col("o_orderkey").alias("attempt_key"),
        F.transform(F.sequence(F.lit(1), last), lambda i: F.concat(F.lit("stage_"), i.cast("string"))).alias("enabled_stages"),
    )


def attempt_stages(t: Tables) -> DataFrame:
    """Stage runs under their run and per-run attempt number."""
    own = attempts(t).select("run_id", "attempt_no", "attempt_key")
    s = stage_runs(t).withColumnRenamed("attempt_no", "attempt_key")
    return s.join(own, "attempt_key").select("run_id", "attempt_no", "stage_name", "status")


def stage_runs(t: Tables, extra: list | None = None) -> DataFrame:
    rf, ls = F.col("l_returnflag"), F.col("l_linestatus")
    st = (
        F.when((rf == "R") & (ls == "F"), "failed").when(rf == "R", "interrupted")
        .when((rf == "N") & (ls == "O"), "running").when(rf == "N", "pending").otherwise("completed")
    )
    return t.lineitem.select(
        F.col("l_orderkey").alias("attempt_no"), F.concat(F.lit("stage_"), F.col("l_linenumber").cast("string")).alias("stage_name"),
        st.alias("status"), *(extra or []),
    )


ATT_SQL = """att AS (SELECT o_custkey AS run_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS attempt_no,
  o_orderkey AS attempt_key, 3 + o_orderkey % 5 AS last_stage,
  CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END AS status,
  o_orderdate AS started_at,
  CASE WHEN o_orderstatus <> 'O' THEN o_orderdate + INTERVAL 1 DAY * (o_orderkey % 5) END AS completed_at FROM orders),
sr AS (SELECT l_orderkey AS attempt_no, 'stage_' || l_linenumber AS stage_name,
  CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'failed' WHEN l_returnflag = 'R' THEN 'interrupted'
       WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 'running' WHEN l_returnflag = 'N' THEN 'pending'
       ELSE 'completed' END AS status FROM lineitem)"""


@job("attempt_state", sql="WITH " + ATT_SQL + """
SELECT run_id, max(attempt_no) + 1 AS next_attempt_no, max(attempt_no) FILTER (WHERE status = 'running') AS running_attempt_no,
  CAST(count(*) AS BIGINT) AS attempts, arg_max(status, attempt_no) AS status, min(started_at) AS first_started_at,
  max(completed_at) AS last_completed_at
FROM att GROUP BY run_id""")
def attempt_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per run: next attempt number, running attempt, attempts, latest status, first start, last end."""
    return R.attempt_state(attempts(Tables(spark, sf_dir)))


@job("resume_stage", sql="WITH " + ATT_SQL + """,
latest AS (SELECT * FROM att QUALIFY attempt_no = max(attempt_no) OVER (PARTITION BY run_id)),
st AS (SELECT l.run_id, l.attempt_no, l.attempt_key, s.pos, s.stage_name FROM latest l,
       (SELECT unnest(range(1, 8)) AS pos, 'stage_' || unnest(range(1, 8)) AS stage_name) s WHERE s.pos <= l.last_stage),
pend AS (SELECT st.run_id, arg_min(st.stage_name, st.pos) AS resume_stage FROM st LEFT JOIN sr
         ON sr.attempt_no = st.attempt_key AND sr.stage_name = st.stage_name
         WHERE sr.status IS NULL OR sr.status IN ('failed', 'interrupted', 'pending', 'running', 'stale') GROUP BY st.run_id)
SELECT latest.run_id, latest.attempt_no, pend.resume_stage FROM latest LEFT JOIN pend USING (run_id)""")
def resume_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return R.resume_stage(attempts(t), attempt_stages(t))


@job("lineage_latest", sql="""SELECT run_id, stage_name, l.output AS output, l.seq AS seq FROM (
  SELECT l_suppkey AS run_id, 'stage_' || l_linenumber AS stage_name,
    arg_max({'action': CASE WHEN l_returnflag = 'R' THEN 'remove' ELSE 'set' END, 'output': 'part_' || l_partkey,
             'seq': l_orderkey}, (l_orderkey, CASE WHEN l_returnflag = 'R' THEN 'remove' ELSE 'set' END, 'part_' || l_partkey)) AS l
  FROM lineitem GROUP BY 1, 2) WHERE l.action <> 'remove'""")
def lineage_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = Tables(spark, sf_dir).lineitem
    upd = li.select(
        F.col("l_suppkey").alias("run_id"), F.concat(F.lit("stage_"), F.col("l_linenumber").cast("string")).alias("stage_name"),
        F.col("l_orderkey").alias("seq"), F.when(F.col("l_returnflag") == "R", "remove").otherwise("set").alias("action"),
        F.concat(F.lit("part_"), F.col("l_partkey").cast("string")).alias("output"),
    )
    return R.latest_lineage(upd)


def log_lines(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    line = F.when((F.col("doc_id") % 41 == 0) & (F.col("pos") == 0), F.concat(F.lit("ERROR: pipeline failed: "), F.col("line")))
    return d.select(
        F.col("source").alias("file"), (F.col("doc_id") * 1_000_000 + F.col("pos")).alias("line_no"),
        F.coalesce(line, F.col("line")).alias("line"),
    )


LOG_SQL = """lines AS (SELECT source AS file, doc_id * 1000000 + pos - 1 AS line_no,
  CASE WHEN doc_id % 41 = 0 AND pos = 1 THEN 'ERROR: pipeline failed: ' || line ELSE line END AS line
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
               generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents))"""


@job("log_tail", sql="WITH " + LOG_SQL + """
SELECT file, line_no, line FROM lines QUALIFY row_number() OVER (PARTITION BY file ORDER BY line_no DESC) <= 30""")
def log_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last 30 lines of every log file (whole files are split; the limit is per file)."""
    return R.log_tail(log_lines(Tables(spark, sf_dir)))


def error_lines(t: Tables) -> DataFrame:
    """Log lines with failures of several forms: stamped, coded, with braces left open; ``src7`` has plain errors only."""
    d = t.documents.select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    k, line = F.col("doc_id"), F.col("line")
    hit = (k % 41 == 0) & (F.col("pos") == 0)
    shown = (
        F.when(hit & (F.col("source") == "src7"), F.concat(F.lit("INFO - some error: "), line))
        .when(hit & (k % 3 == 0), F.concat(F.lit("12:00  run  ERROR - Pipeline failed: Stage 'train' failed: [OOM_ERROR] {"), line))
        .when(hit & (k % 3 == 1), F.concat(F.lit("Configuration error: [BAD] "), line))
        .when(hit, F.concat(F.lit("ERROR: pipeline failed: "), line))
        .when((k + F.col("pos")) % 5 == 0, F.concat(line, F.lit(" }")))
        .otherwise(line)
    )
    return d.select(F.col("source").alias("file"), (k * 1_000_000 + F.col("pos")).alias("line_no"), shown.alias("line"))


STRIP = "regexp_replace({}, '^@WS@+|@WS@+$', '', 'g')"


@job("last_error", sql=rf"""WITH d AS (SELECT doc_id AS k, source AS file, unnest(string_split(text, chr(10))) AS line,
  generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
l AS (SELECT file, k * 1000000 + pos AS line_no, CASE WHEN k % 41 = 0 AND pos = 0 THEN CASE WHEN file = 'src7' THEN 'INFO - some error: ' || line
    WHEN k % 3 = 0 THEN '12:00  run  ERROR - Pipeline failed: Stage ''train'' failed: [OOM_ERROR] {{' || line
    WHEN k % 3 = 1 THEN 'Configuration error: [BAD] ' || line ELSE 'ERROR: pipeline failed: ' || line END
  WHEN (k + pos) % 5 = 0 THEN line || ' }}' ELSE line END AS line FROM d),
m AS (SELECT *, contains(lower(line), 'pipeline failed:') OR contains(lower(line), 'configuration error:') AS marked FROM l WHERE contains(lower(line), 'error:')
  OR contains(lower(line), 'pipeline failed:')),
h0 AS (SELECT file, bool_or(marked) AS failed, coalesce(max(line_no) FILTER (WHERE marked), max(line_no)) AS line_no FROM m GROUP BY file),
h AS (SELECT file, failed, line_no, {STRIP.format('line')} AS s FROM h0 JOIN l USING (file, line_no)),
g AS (SELECT file, failed, line_no, CASE WHEN starts_with(s, '12:00  run  ') THEN {STRIP.format('substr(s, 13)')} ELSE s END AS head FROM h),
o AS (SELECT *, CASE WHEN failed THEN length(replace(head, '}}', '')) - length(replace(head, '{{', '')) ELSE 0 END AS open FROM g),
a AS (SELECT l.file, l.line_no, {STRIP.format('l.line')} AS t, o.open FROM l JOIN o ON o.file = l.file AND l.line_no > o.line_no AND o.open > 0),
s AS (SELECT *, open + coalesce(sum(length(replace(t, '}}', '')) - length(replace(t, '{{', ''))) OVER (PARTITION BY file ORDER BY line_no
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS still FROM a),
e AS (SELECT file, min(line_no) FILTER (WHERE still <= 0) AS stop FROM s GROUP BY file),
c AS (SELECT s.file, string_agg(t, chr(10) ORDER BY line_no) AS more FROM s JOIN e USING (file) WHERE stop IS NULL OR line_no < stop GROUP BY s.file),
r AS (SELECT o.file, line_no, head || coalesce(chr(10) || more, '') AS raw FROM o LEFT JOIN c USING (file)),
q AS (SELECT file, line_no, regexp_replace(raw, '^(?:ERROR|WARNING|INFO)\s*-\s*', '') AS raw FROM r),
u AS (SELECT file, line_no, CASE WHEN starts_with(lower(raw), 'pipeline failed: ') THEN substr(raw, 18) ELSE raw END AS raw FROM q)
SELECT file, line_no, {STRIP.format(r"regexp_replace(regexp_replace(raw, 'Stage ''[^'']+'' failed:\s*', ''), '\[[A-Z_]+\]\s*', '', 'g')")} AS message FROM u""")
def last_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last failure of each log file, with the lines that belong to it, cleaned."""
    return R.last_error(error_lines(Tables(spark, sf_dir)))


@job("folder_rollup", sql="WITH " + TREE_SQL + ", " + EXP_SQL + """,
paths AS (SELECT 'runs/' || experiment || '/' || run_name AS path, start_ms FROM exp)
SELECT folder, CAST(count(*) AS BIGINT) AS runs, max(start_ms) AS newest_start_ms FROM (
  SELECT array_to_string(string_split(path, '/')[1:i], '/') AS folder, start_ms
  FROM paths, range(1, len(string_split(path, '/'))) r(i)) GROUP BY folder""")
def folder_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = experiment_runs(run_tree(Tables(spark, sf_dir)))
    paths = e.select(F.concat_ws("/", F.lit("runs"), "experiment", "run_name").alias("path"), "start_ms")
    return R.folder_rollup(paths)


@job("checkpoint_retention", sql="""SELECT phase, step, name FROM (
  SELECT l_orderkey AS phase, l_linenumber * 500 AS step, 'checkpoint-' || (l_linenumber * 500) AS name FROM lineitem)
QUALIFY row_number() OVER (PARTITION BY phase ORDER BY step DESC) > 2""")
def checkpoint_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checkpoints to clean per phase (listing only, nothing is deleted)."""
    li = Tables(spark, sf_dir).lineitem
    ck = li.select(
        F.col("l_orderkey").alias("phase"), (F.col("l_linenumber") * 500).alias("step"),
        F.concat(F.lit("checkpoint-"), (F.col("l_linenumber") * 500).cast("string")).alias("name"),
    )
    return R.checkpoint_retention(ck)


@job("latest_metric_values", sql="""SELECT user_id AS run_id,
  CASE event_type WHEN 'view' THEN 'train_loss' WHEN 'click' THEN 'eval_accuracy' WHEN 'signup' THEN 'grad_norm'
    WHEN 'purchase' THEN 'system/gpu_0_memory_usage_megabytes' WHEN 'error' THEN 'system/gpu_0_utilization_percentage'
    ELSE event_type END AS key,
  arg_max(value, event_id) AS value, max(event_id) AS step
FROM events WHERE value IS NOT NULL GROUP BY 1, 2""")
def latest_metric_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most recent non-null value of every metric of every run (max_by, no sort)."""
    from finelens.plans.metrics import metric_points

    mp = metric_points(Tables(spark, sf_dir)).where(F.col("value").isNotNull())
    return mp.groupBy("run_id", "key").agg(F.max_by("value", "step").alias("value"), F.max("step").alias("step"))


@job("run_progress", sql="WITH " + ATT_SQL + """,
d AS (SELECT *, CASE WHEN status = 'completed' THEN epoch(completed_at) - epoch(started_at) END AS s FROM att)
SELECT run_id, CAST(count(*) FILTER (WHERE status = 'completed') AS BIGINT) AS completed, CAST(count(*) AS BIGINT) AS total,
  100.0 * count(*) FILTER (WHERE status = 'completed') / count(*) AS percent, coalesce(sum(s), 0)::BIGINT AS completed_seconds,
  max(s)::BIGINT AS longest_seconds, avg(s) AS mean_seconds FROM d GROUP BY run_id""")
def run_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completed / total attempts, percent, and the time of the completed ones per run."""
    a = attempts(Tables(spark, sf_dir))
    done = F.col("status") == "completed"
    seconds = F.when(done, F.unix_timestamp(F.col("completed_at").cast("timestamp")) - F.unix_timestamp(F.col("started_at").cast("timestamp")))
    g = a.withColumn("_s", seconds).groupBy("run_id").agg(
        F.count_if(done).cast("bigint").alias("completed"), F.count(F.lit(1)).cast("bigint").alias("total"),
        F.coalesce(F.sum("_s"), F.lit(0)).cast("bigint").alias("completed_seconds"), F.max("_s").alias("longest_seconds"), F.avg("_s").alias("mean_seconds"),
    )
    return g.withColumn("percent", F.lit(100.0) * F.col("completed") / F.col("total"))


@job("resume_phase", sql="WITH " + ATT_SQL + """
SELECT run_id, min(attempt_no) FILTER (WHERE status IN ('running', 'interrupted', 'failed', 'pending')) AS resume_attempt_no
FROM att GROUP BY run_id""")
def resume_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First phase (attempt) of each run that is running, interrupted, failed or pending."""
    a = attempts(Tables(spark, sf_dir))
    bad = F.col("status").isin("running", "interrupted", "failed", "pending")
    return a.groupBy("run_id").agg(F.min(F.when(bad, F.col("attempt_no"))).alias("resume_attempt_no"))


@job("runs_grouped", sql="WITH " + TREE_SQL + ", " + EXP_SQL + """,
p AS (SELECT CASE WHEN CAST(substr(run_id, 2) AS BIGINT) % 9 = 0 THEN run_name ELSE experiment || '/' || run_name END AS path, run_id, status, start_ms FROM exp),
g AS (SELECT *, CASE WHEN contains(path, '/') THEN string_split(path, '/')[1] ELSE '(root)' END AS grp FROM p)
SELECT grp, row_number() OVER (PARTITION BY grp ORDER BY start_ms DESC, run_id) - 1 AS position, run_id, status, start_ms,
  count(*) OVER (PARTITION BY grp) AS runs, max(start_ms) OVER (PARTITION BY grp) AS newest_start_ms FROM g""")
def runs_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs by their top folder, newest first, with the group's size; runs in no folder are in (root)."""
    e = experiment_runs(run_tree(Tables(spark, sf_dir)))
    loose = F.substring("run_id", 2, 20).cast("bigint") % 9 == 0
    path = F.when(loose, F.col("run_name")).otherwise(F.concat_ws("/", "experiment", "run_name"))
    return R.grouped_by_folder(e.select(path.alias("path"), "run_id", "status", "start_ms"))


@job("stage_timeline", sql="""SELECT l_orderkey AS attempt_no, 'stage_' || l_linenumber AS stage_name,
  CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'failed' WHEN l_returnflag = 'R' THEN 'interrupted'
       WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 'running' WHEN l_returnflag = 'N' THEN 'pending' ELSE 'completed' END AS status,
  l_shipdate AS started_at,
  CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'ERROR' WHEN l_returnflag = 'R' THEN 'WARN' ELSE 'INFO' END AS severity,
  printf('Stage %s %s', 'stage_' || l_linenumber,
    CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'failed' WHEN l_returnflag = 'R' THEN 'interrupted'
         WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 'running' WHEN l_returnflag = 'N' THEN 'pending' ELSE 'completed' END)
    AS message
FROM lineitem""")
def stage_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stage rows with start time, message and severity (failed -> ERROR, interrupted -> WARN)."""
    t = Tables(spark, sf_dir)
    s = stage_runs(t, extra=[F.col("l_shipdate").alias("started_at")])
    sev = F.when(F.col("status") == "failed", "ERROR").when(F.col("status") == "interrupted", "WARN").otherwise("INFO")
    return s.select("attempt_no", "stage_name", "status", "started_at", sev.alias("severity"),
                    F.format_string("Stage %s %s", F.col("stage_name"), F.col("status")).alias("message"))


@job("epoch_durations", sql="""SELECT user_id AS run_id, CAST(floor((epoch_us(ts) // 1000) / 86400000) AS BIGINT) AS epoch,
  min(epoch_us(ts) // 1000) FILTER (WHERE event_type = 'signup') AS start_ms,
  max(epoch_us(ts) // 1000) FILTER (WHERE event_type = 'purchase') AS end_ms,
  CASE WHEN max(epoch_us(ts) // 1000) FILTER (WHERE event_type = 'purchase') IS NOT NULL
        AND min(epoch_us(ts) // 1000) FILTER (WHERE event_type = 'signup') IS NOT NULL
       THEN greatest(max(epoch_us(ts) // 1000) FILTER (WHERE event_type = 'purchase')
                     - min(epoch_us(ts) // 1000) FILTER (WHERE event_type = 'signup'), 0) / 1000.0 END AS duration_seconds
FROM events GROUP BY 1, 2""")
def epoch_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Epoch start / end pairs -> duration (floor 0); epoch = a run's day, start = first
    signup event, end = last purchase event (conditional aggregation, no self-join)."""
    e = Tables(spark, sf_dir).events.select(F.col("user_id").alias("run_id"), "event_type", epoch_ms("ts").alias("ts_ms"))
    g = e.groupBy("run_id", F.floor(F.col("ts_ms") / 86_400_000).alias("epoch")).agg(
        F.min(F.when(F.col("event_type") == "signup", F.col("ts_ms"))).alias("start_ms"),
        F.max(F.when(F.col("event_type") == "purchase", F.col("ts_ms"))).alias("end_ms"),
    )
    d = F.when(F.col("start_ms").isNotNull() & F.col("end_ms").isNotNull(),
               F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(0)) / F.lit(1000.0))
    return g.withColumn("duration_seconds", d)


def _json(name: str, value, quoted: bool) -> Column:
    """``"name": value`` as in default JSON separators; null stays a field."""
    shown = F.regexp_replace(F.to_json(F.array(value)), r"^\[|\]$", "") if quoted else value.cast("string")
    return F.concat(F.lit(f'"{name}": '), F.coalesce(shown, F.lit("null")))


@job("config_hashes", sql="""WITH s AS (SELECT p_partkey AS config_id,
  '"datasets": {"default": {"price": ' || coalesce(CAST(p_retailprice AS VARCHAR), 'null') || '}}, "model": {"name": '
    || coalesce(CAST(to_json(p_name) AS VARCHAR), 'null') || '}' AS model,
  '"provider": {"size": ' || coalesce(CAST(p_size AS VARCHAR), 'null') || '}, "provider_name": '
    || coalesce(CAST(to_json(p_brand) AS VARCHAR), 'null') AS provider,
  '"training": {"type": ' || coalesce(CAST(to_json(p_type) AS VARCHAR), 'null') || '}' AS training,
  '{"evaluation": {"size": ' || coalesce(CAST(p_size AS VARCHAR), 'null') || '}, "inference": {"type": '
    || coalesce(CAST(to_json(p_type) AS VARCHAR), 'null') || '}}' AS late
  FROM part)
SELECT config_id, sha256('{' || model || ', ' || provider || ', ' || training || '}') AS training_critical_hash,
  sha256(late) AS late_stage_hash, sha256('{' || model || ', ' || training || '}') AS model_dataset_hash FROM s""")
def config_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three sha-256 hashes per config over key-sorted JSON with default separators.

    Config = a part row: model name, dataset price, training type; the training
    hash covers the model-dataset payload and the provider (brand, size), the late
    hash evaluation (size) and inference (type).
    """
    name, price, kind = _json("name", F.col("p_name"), True), _json("price", F.col("p_retailprice"), False), _json("type", F.col("p_type"), True)
    size, brand = _json("size", F.col("p_size"), False), _json("provider_name", F.col("p_brand"), True)
    model = F.concat(F.lit('"datasets": {"default": {'), price, F.lit('}}, "model": {'), name, F.lit("}"))
    provider = F.concat(F.lit('"provider": {'), size, F.lit("}, "), brand)
    training = F.concat(F.lit('"training": {'), kind, F.lit("}"))
    late = F.concat(F.lit('{"evaluation": {'), size, F.lit('}, "inference": {'), kind, F.lit("}}"))
    h = lambda *parts: F.sha2(F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}")), 256)
    return Tables(spark, sf_dir).part.select(
        F.col("p_partkey").alias("config_id"),
        h(model, provider, training).alias("training_critical_hash"),
        F.sha2(late, 256).alias("late_stage_hash"),
        h(model, training).alias("model_dataset_hash"),
    )
