"""Jobs over run records: documents written from the driver tables and read back, comparisons, chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from finelens.operators import memory as MEM
from finelens.operators import records as R
from finelens.plans.registry import job
from finelens.plans.runs import TREE_SQL, EXP_SQL, experiment_runs, run_tree
from finelens.sources.tables import Tables
from finelens.streaming.jobs import scratch


def as_documents(rows: DataFrame, keys: list[str], body: str, broken, name: str) -> DataFrame:
    """Writes one JSON text per row, cut short where ``broken``, and reads the texts back with their keys."""
    text = F.to_json(F.col(body))
    line = F.concat_ws("\t", *[F.col(k).cast("string") for k in keys], F.when(broken, F.expr(f"left(to_json({body}), 9)")).otherwise(text))
    path = scratch(rows.sparkSession, name)
    rows.select(line.alias("value")).write.text(path)
    parts = F.split("value", "\t", len(keys) + 1)
    return rows.sparkSession.read.text(path).select(*[parts[i].alias(k) for i, k in enumerate(keys)], parts[len(keys)].alias("doc"))


@job("scan_events", sql="""SELECT user_id AS run_id, event_id AS seq, event_type, value FROM events
WHERE NOT (user_id % 7 = 0 AND CAST(ts AS DATE) = DATE '2024-01-03') AND (user_id + day(ts)) % 11 <> 0""")
def scan_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event documents (one a run and day) to rows; truncated documents (some run-days) have none."""
    e = Tables(spark, sf_dir).events
    docs = e.groupBy(F.col("user_id").alias("run_id"), F.to_date("ts").alias("day")).agg(
        F.collect_list(F.struct(F.col("event_id").alias("seq"), "event_type", "value")).alias("events")
    ).select("run_id", "day", F.struct("events").alias("body"))
    broken = ((F.col("run_id") % 7 == 0) & (F.col("day") == F.lit("2024-01-03").cast("date"))) | ((F.col("run_id") + F.day("day")) % 11 == 0)
    texts = as_documents(docs, ["run_id", "day"], "body", broken, "event_documents")
    return R.events_of(texts).select(F.col("run_id").cast("bigint").alias("run_id"), "seq", "event_type", "value")


@job("scan_run_states", sql="""WITH a AS (SELECT o_custkey AS run_id, CAST(count(*) AS INT) AS attempts,
  arg_max(CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END, o_orderkey) AS status
  FROM orders GROUP BY 1),
e AS (SELECT *, CASE WHEN run_id % 11 = 0 THEN 'state is not readable' WHEN run_id % 13 = 0 THEN 'unsupported state version'
  WHEN run_id % 17 = 0 THEN 'state has no run id' END AS error FROM a)
SELECT run_id, CASE WHEN error IS NULL THEN status ELSE 'unknown' END AS status,
  CASE WHEN error IS NULL THEN attempts ELSE 0 END AS attempts, error FROM e""")
def scan_run_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State documents of all runs; unreadable, outdated and nameless ones keep a row with status unknown."""
    st = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "running").otherwise("failed")
    a = Tables(spark, sf_dir).orders.groupBy(F.col("o_custkey").alias("run_id")).agg(
        F.count(F.lit(1)).cast("int").alias("attempts"), F.max_by(st, "o_orderkey").alias("pipeline_status")
    )
    body = F.struct(
        F.when(F.col("run_id") % 13 == 0, 99).otherwise(R.STATE_VERSION).alias("schema_version"),
        F.when(F.col("run_id") % 17 != 0, F.col("run_id").cast("string")).alias("logical_run_id"),
        "pipeline_status", "attempts",
    )
    texts = as_documents(a.select("run_id", body.alias("body")), ["run_id"], "body", F.col("run_id") % 11 == 0, "run_states")
    return R.run_states(texts).withColumn("run_id", F.col("run_id").cast("bigint"))


@job("scan_stage_envelopes", sql="""WITH s AS (SELECT l_orderkey AS run_id, 'stage_' || l_linenumber AS stage_name,
  CASE WHEN l_returnflag = 'R' THEN 'failed' ELSE 'completed' END AS status, l_quantity AS duration, l_partkey % 19 = 0 AS broken
  FROM lineitem)
SELECT run_id, CAST(count(*) FILTER (WHERE NOT broken) AS BIGINT) AS stages,
  CAST(count(*) FILTER (WHERE NOT broken AND status = 'failed') AS BIGINT) AS failed,
  coalesce(sum(duration) FILTER (WHERE NOT broken), 0.0) AS total_seconds,
  coalesce(array_to_string(list_sort(list_distinct(list(stage_name) FILTER (WHERE broken))), ','), '') AS missing_artifacts
FROM s GROUP BY run_id""")
def scan_stage_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result documents of every stage of a run; a broken one is a missing artifact, an absent one is not."""
    li = Tables(spark, sf_dir).lineitem
    name = F.concat(F.lit("stage_"), F.col("l_linenumber").cast("string"))
    body = F.struct(
        name.alias("stage"), F.when(F.col("l_returnflag") == "R", "failed").otherwise("completed").alias("status"),
        F.col("l_quantity").alias("duration_seconds"),
    )
    rows = li.select(F.col("l_orderkey").alias("run_id"), name.alias("stage_name"), body.alias("body"), (F.col("l_partkey") % 19 == 0).alias("broken"))
    texts = as_documents(rows, ["run_id", "stage_name"], "body", F.col("broken"), "stage_envelopes")
    return R.stage_envelopes(texts).withColumn("run_id", F.col("run_id").cast("bigint"))


ORDER_HASH_SQL = """oh AS (SELECT o_custkey AS run_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS attempt_no,
  sha256(o_orderpriority) AS critical_hash, sha256(o_orderstatus) AS late_hash FROM orders)"""


@job("attempt_diff", sql="WITH " + ORDER_HASH_SQL + """,
p AS (SELECT run_id, max(attempt_no) - 1 AS attempt_a, max(attempt_no) AS attempt_b FROM oh GROUP BY run_id)
SELECT p.*, a.run_id IS NOT NULL AS found_a, b.run_id IS NOT NULL AS found_b,
  CASE WHEN a.run_id IS NOT NULL THEN a.critical_hash ELSE '' END AS hash_a_critical,
  CASE WHEN a.run_id IS NOT NULL THEN a.late_hash ELSE '' END AS hash_a_late,
  CASE WHEN a.run_id IS NOT NULL THEN b.critical_hash ELSE '' END AS hash_b_critical,
  CASE WHEN a.run_id IS NOT NULL THEN b.late_hash ELSE '' END AS hash_b_late,
  a.run_id IS NOT NULL AND a.critical_hash <> b.critical_hash AS training_critical_changed,
  a.run_id IS NOT NULL AND a.late_hash <> b.late_hash AS late_stage_changed
FROM p LEFT JOIN oh a ON a.run_id = p.run_id AND a.attempt_no = p.attempt_a
       LEFT JOIN oh b ON b.run_id = p.run_id AND b.attempt_no = p.attempt_b""")
def attempt_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last two attempts of every run side by side; a run's only attempt has no partner."""
    per_run = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    a = Tables(spark, sf_dir).orders.select(
        F.col("o_custkey").alias("run_id"), F.row_number().over(per_run).alias("attempt_no"),
        F.sha2("o_orderpriority", 256).alias("critical_hash"), F.sha2("o_orderstatus", 256).alias("late_hash"),
    )
    last = a.groupBy("run_id").agg(F.max("attempt_no").alias("attempt_b"))
    return R.attempt_diff(a, last.select("run_id", (F.col("attempt_b") - 1).alias("attempt_a"), "attempt_b"))


@job("config_drift", sql="""WITH s AS (SELECT c_custkey AS run_id, c_mktsegment AS seg, c_nationkey AS nat FROM customer),
b AS (SELECT run_id, CASE WHEN run_id % 5 = 0 THEN 'training_critical' WHEN run_id % 7 = 0 THEN 'late_stage' END AS blocked_by FROM s)
SELECT run_id, blocked_by, blocked_by IS NULL AS can_resume FROM b""")
def config_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored against current hashes of every run (a customer; model hash unset for every third, changed for every fifth, late changed for every seventh)."""
    c = Tables(spark, sf_dir).customer
    h = lambda *x: F.sha2(F.concat_ws("|", *x), 256)
    key, seg, nat = F.col("c_custkey"), F.col("c_mktsegment"), F.col("c_nationkey").cast("string")
    now_seg, now_nat = F.when(key % 5 == 0, F.lit("?")).otherwise(seg), F.when(key % 7 == 0, F.lit("?")).otherwise(nat)
    stored = c.select(
        key.alias("run_id"), F.when(key % 3 != 0, h(seg)).alias("model_dataset"), h(seg, F.lit("p")).alias("training_critical"), h(nat).alias("late_stage")
    )
    current = c.select(key.alias("run_id"), h(now_seg).alias("model_dataset"), h(now_seg, F.lit("p")).alias("training_critical"), h(now_nat).alias("late_stage"))
    return R.config_drift(stored, current)


CHAIN_STRATEGIES = ("cpt", "sft", "cot", "dpo", "orpo", "grpo", "sapo")


@job("strategy_chain_check", sql="""WITH p AS (SELECT l_orderkey AS chain, row_number() OVER (PARTITION BY l_orderkey
    ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) AS pos,
  CASE WHEN l_partkey % 97 = 0 THEN NULL ELSE ['cpt', 'sft', 'cot', 'dpo', 'orpo', 'grpo', 'sapo'][l_partkey % 7 + 1] END AS strategy,
  CASE WHEN l_suppkey % 9 = 0 THEN NULL ELSE 'ds_' || l_suppkey END AS dataset, l_returnflag = 'R' AS cached FROM lineitem),
w AS (SELECT *, lag(strategy) OVER (PARTITION BY chain ORDER BY pos) AS before FROM p),
f AS (SELECT chain, count(*) AS phases, count(*) FILTER (WHERE strategy IS NULL) AS nulls,
  bool_or(pos = 1 AND coalesce(strategy, 'sft') = 'cot') AS start,
  count(*) FILTER (WHERE pos > 1 AND NOT coalesce(
    (before = 'cpt' AND strategy IN ('sft', 'cot')) OR (before = 'sft' AND strategy IN ('cot', 'dpo', 'orpo', 'grpo', 'sapo'))
    OR (before = 'cot' AND strategy IN ('dpo', 'orpo', 'grpo', 'sapo')), false)) AS steps FROM w GROUP BY chain),
t AS (SELECT chain, min(dataset) AS twice FROM (SELECT chain, coalesce(dataset, 'default') AS dataset FROM p WHERE NOT cached
  GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY chain)
SELECT f.chain, CAST(phases AS BIGINT) AS phases, nulls = 0 AND start AS invalid_start,
  CAST(CASE WHEN nulls > 0 THEN 0 ELSE steps END AS BIGINT) AS invalid_transitions,
  CASE WHEN nulls > 0 THEN 'STRATEGY_CHAIN_CONTAINS_NONE' WHEN twice IS NOT NULL THEN 'STRATEGY_CHAIN_DUPLICATE_DATASET' END AS error_code,
  CASE WHEN nulls = 0 THEN twice END AS duplicate_dataset
FROM f LEFT JOIN t USING (chain)""")
def strategy_chain_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phases of every chain (an order's lines) against the start, transition and dataset rules."""
    li = Tables(spark, sf_dir).lineitem
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    names = F.array(*map(F.lit, CHAIN_STRATEGIES))
    phases = li.select(
        F.col("l_orderkey").alias("chain"), F.row_number().over(order).alias("pos"),
        F.when(F.col("l_partkey") % 97 != 0, F.get(names, (F.col("l_partkey") % 7).cast("int"))).alias("strategy"),
        F.when(F.col("l_suppkey") % 9 != 0, F.concat(F.lit("ds_"), F.col("l_suppkey").cast("string"))).alias("dataset"),
        (F.col("l_returnflag") == "R").alias("cached"),
    )
    return R.strategy_chain_check(phases)


@job("compare_runs", sql="WITH " + TREE_SQL + ", " + EXP_SQL + """,
best AS (SELECT experiment, min((train_loss, run_id)) AS b FROM exp WHERE train_loss IS NOT NULL GROUP BY experiment)
SELECT experiment, run_id, train_loss AS value, b[2] AS best_run_id, b[1] AS best_value, train_loss - b[1] AS delta
FROM exp LEFT JOIN best USING (experiment)""")
def compare_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run of an experiment beside the experiment's best run."""
    return R.compare_with_best(experiment_runs(run_tree(Tables(spark, sf_dir))), "experiment", "train_loss")


#: Cards of the stand-in runs (by run % 10) and their memory.
CARDS = (
    ("NVIDIA A100-SXM4", 81920), ("NVIDIA RTX A5000", 24576), ("GeForce RTX 4090", 24576), ("GeForce RTX 4070 Ti", 12288),
    ("GeForce RTX 3060 Ti", 8192), ("GeForce RTX 3060", 12288), ("Unnamed", 49152), ("Unnamed", 16384), ("Unnamed", 8192), ("Unnamed", 6144),
)
CARD_SQL = "[" + ", ".join(f"{{'n': '{n}', 'mb': {mb}}}" for n, mb in CARDS) + "]"


@job("memory_level", sql=f"""WITH p AS (SELECT user_id AS run_id, event_id AS step, {CARD_SQL}[CAST(user_id % 10 AS INT) + 1] AS c, event_id % 101 AS pct FROM events),
q AS (SELECT run_id, step, c.n AS gpu_name, c.mb AS total_mb, c.mb * pct / 100.0::DOUBLE AS used_mb,
  CASE run_id % 10 WHEN 0 THEN 'datacenter' WHEN 1 THEN 'professional' WHEN 2 THEN 'consumer_high' WHEN 3 THEN 'consumer_mid'
    WHEN 4 THEN 'consumer_low' WHEN 5 THEN 'minimal' WHEN 6 THEN 'datacenter' WHEN 7 THEN 'consumer_mid' WHEN 8 THEN 'consumer_low'
    ELSE 'minimal' END AS tier FROM p),
u AS (SELECT *, used_mb / total_mb * 100 AS utilization_percent FROM q)
SELECT run_id, step, tier, round(utilization_percent, 6) AS utilization_percent, CASE
  WHEN utilization_percent > CASE tier WHEN 'datacenter' THEN 95.0 WHEN 'professional' THEN 92.0 WHEN 'minimal' THEN 92.0 ELSE 90.0 END THEN 'critical'
  WHEN utilization_percent > CASE tier WHEN 'datacenter' THEN 85.0 WHEN 'professional' THEN 82.0 WHEN 'minimal' THEN 85.0 ELSE 80.0 END THEN 'warning'
  ELSE 'ok' END AS level FROM u""")
def memory_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memory points of every run against the alarm levels of its card's tier."""
    e = Tables(spark, sf_dir).events
    cards = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(mb).alias("mb")) for n, mb in CARDS])
    card = F.get(cards, (F.col("user_id") % 10).cast("int"))
    points = e.select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("step"), card["n"].alias("gpu_name"), card["mb"].alias("total_mb"),
        (card["mb"] * (F.col("event_id") % 101) / F.lit(100.0)).alias("used_mb"),
    )
    out = MEM.memory_levels(points)
    return out.select("run_id", "step", "tier", F.round("utilization_percent", 6).alias("utilization_percent"), "level")
