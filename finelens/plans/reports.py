"""Jobs on evaluation runs, training runs, configurations and batches.

Stand-ins (fixed rules): an evaluation run is a ``user_id`` of ``events``, its samples are its
``view`` events (expected answers in some runs only), its plugins a fixed list of which
run and plugin number decide which are enabled, pass or crash; roll-ups and dataset lists
come from ``lineitem``, configurations from ``part``, their runs from ``orders``, training runs
from the run tree with nations as roots.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finelens.operators import reports as RP
from finelens.operators import phases as PH
from finelens.operators import records as RC
from finelens.plans.events import issues_of, issues_sql
from finelens.plans.phases import PHASES_SQL, TABLE_SQL, event_phases, table_of
from finelens.plans.registry import job
from finelens.plans.runs import LOG_SQL, TREE_SQL, log_lines, run_tree
from finelens.sources.report_store import ReportStore
from finelens.sources.tables import Tables
from finelens.streaming.jobs import scratch

#: plugin id, priority, needs expected answers
PLUGINS = [("syntax", 10, False), ("semantic", 30, True), ("judge", 40, False), ("compile", 20, True), ("length", 50, False)]


def _plugins(rows: DataFrame) -> DataFrame:
    listed = F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(n).alias("plugin_id"), F.lit(p).alias("priority"), F.lit(e).alias("requires_expected"))
        for i, (n, p, e) in enumerate(PLUGINS)
    ])
    return rows.select("run_id", F.explode(listed).alias("p")).select("run_id", "p.*")


def evaluation(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Runs, plugins with ``skipped``, results."""
    e = t.events.select(F.col("user_id").alias("run_id"), "event_type", F.get_json_object("props", "$.k").cast("int").alias("k"))
    runs = e.groupBy("run_id").agg(F.count_if(F.col("event_type") == "view").cast("bigint").alias("sample_count"))
    r = F.col("run_id")
    samples = e.where("event_type = 'view'").select("run_id", F.when((F.col("k") % 3 == 0) & (r % 4 != 0), F.col("k").cast("string")).alias("expected_answer"))
    enabled = _plugins(runs).where((r % 9 != 0) & ((r + F.col("i")) % 3 != 0))
    results = enabled.where((r + F.col("i")) % 11 != 0).select("run_id", "plugin_id", ((r * 7 + F.col("i") * 3) % 5 != 0).alias("passed"))
    return runs, RP.skipped_plugins(enabled.drop("i"), samples), results


PLUGIN_VALUES = ", ".join(f"({i}, '{n}', {p}, {str(e).lower()})" for i, (n, p, e) in enumerate(PLUGINS))


@job("eval_run_summary", sql=f"""WITH pl(i, plugin_id, priority, needs) AS (VALUES {PLUGIN_VALUES}),
r AS (SELECT user_id AS run_id, count(*) FILTER (WHERE event_type = 'view') AS sample_count,
  bool_or(event_type = 'view' AND CAST(json_extract_string(props, '$.k') AS INTEGER) % 3 = 0) AND user_id % 4 <> 0 AS expects
  FROM events GROUP BY 1),
o AS (SELECT run_id, plugin_id, priority, CASE WHEN needs AND NOT expects THEN 'skipped'
  WHEN (run_id + i) % 11 <> 0 AND (run_id * 7 + i * 3) % 5 <> 0 THEN 'passed' ELSE 'failed' END AS outcome
  FROM r, pl WHERE run_id % 9 <> 0 AND (run_id + i) % 3 <> 0),
l AS (SELECT run_id, coalesce(list(plugin_id ORDER BY priority) FILTER (WHERE outcome = 'passed'), []) AS p,
  coalesce(list(plugin_id ORDER BY priority) FILTER (WHERE outcome = 'failed'), []) AS f,
  coalesce(list(plugin_id ORDER BY priority) FILTER (WHERE outcome = 'skipped'), []) AS s FROM o GROUP BY run_id)
SELECT r.run_id, l.run_id IS NOT NULL AND len(f) = 0 AS overall_passed, sample_count, coalesce(p, []) AS passed_plugins,
  coalesce(f, []) AS failed_plugins, coalesce(s, []) AS skipped_plugins,
  CASE WHEN l.run_id IS NULL THEN ['{RP.NO_PLUGINS}'] ELSE [] END AS errors FROM r LEFT JOIN l USING (run_id)""")
def eval_run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overall verdict of every evaluation run with its plugins by outcome."""
    return RP.eval_run_summary(*evaluation(Tables(spark, sf_dir)))


@job("eval_rollup", sql="""WITH p AS (SELECT l_orderkey AS run_id, l_linenumber AS plugin, l_partkey AS k, l_discount AS d FROM lineitem)
SELECT run_id, plugin, k, CASE WHEN k % 4 = 0 THEN k % 6 WHEN k % 4 = 1 THEN k % 50 ELSE 0 END AS failed_samples,
  CASE WHEN k % 3 <> 0 THEN d END AS mean_score, 1 + (k % 3 <> 0)::BIGINT + (k % 5 = 0)::BIGINT AS numeric_metrics FROM p""")
def eval_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numeric metrics and failed-sample counts of every plugin result."""
    k = F.col("l_partkey")
    metrics = F.create_map(
        F.lit("mean_score"), F.when(k % 3 == 0, '"n/a"').otherwise(F.col("l_discount").cast("string")), F.lit("label"), F.lit('"x"'),
        F.lit("flag"), F.lit("true"), F.lit("n"), k.cast("string"), F.lit("p50"), F.when(k % 5 == 0, "-1.5e2").otherwise("null"),
    )
    failed = (
        F.when(k % 4 == 0, F.to_json(F.when(k % 6 == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), (k % 6).cast("int")))))
        .when(k % 4 == 1, (k % 50).cast("string"))
        .when(k % 4 == 2, '"many"')
    )
    rows = Tables(spark, sf_dir).lineitem.select(
        F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("plugin"), k.alias("k"), metrics.alias("metrics"), failed.alias("failed_samples")
    )
    out = RP.eval_rollup(rows)
    return out.select(
        "run_id", "plugin", "k", "failed_samples", F.col("metrics")["mean_score"].alias("mean_score"), F.size("metrics").cast("bigint").alias("numeric_metrics")
    )


PROFILE_VALUES = ", ".join(
    f"('{s.upper()}', {i}, '{m}')" for s, extra in {"": (), **RP.PROFILES}.items() for i, m in enumerate((*RP.DEFAULT_METRICS, *extra))
)


@job("metric_profile", sql="WITH " + PHASES_SQL + f""",
pr(strategy, pos, metric) AS (VALUES {PROFILE_VALUES})
SELECT run_id, phase_idx, ep.strategy, pos, metric FROM ep JOIN pr
  ON pr.strategy = CASE WHEN ep.strategy IN ({', '.join(f"'{s.upper()}'" for s in RP.PROFILES)}) THEN ep.strategy ELSE '' END""")
def metric_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics to look at in every phase, by its strategy."""
    phases = event_phases(Tables(spark, sf_dir)).select("run_id", "phase_idx", "strategy")
    return RP.metric_profile(phases)


@job("training_run", sql="WITH " + TREE_SQL + """,
c AS (SELECT parent_run_id AS root_run_id, run_id, CAST(substr(run_id, 2) AS BIGINT) AS k, CAST(substr(parent_run_id, 2) AS BIGINT) AS n
      FROM runs WHERE depth = 2),
r AS (SELECT c.*, CASE WHEN k % 5 = 0 AND n % 2 = 0 THEN 0 WHEN EXISTS (SELECT 1 FROM runs o WHERE o.parent_run_id = c.run_id) THEN 1 END AS rk FROM c)
SELECT root_run_id, arg_min(run_id, (rk, run_id)) AS run_id, CASE min(rk) WHEN 0 THEN 'params' ELSE 'container' END AS found_by
FROM r WHERE rk IS NOT NULL GROUP BY root_run_id""")
def training_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training run below every nation."""
    tree = run_tree(Tables(spark, sf_dir))
    key = lambda c: F.substring(c, 2, 20).cast("bigint")
    named = (F.col("depth") == 2) & (key("run_id") % 5 == 0) & (key("parent_run_id") % 2 == 0)
    params = F.when(named, F.create_map(F.lit("gpu_name"), F.lit("A4000"))).otherwise(F.create_map(F.lit("lr"), F.lit("1")))
    runs = tree.select("run_id", "parent_run_id", "start_ms", params.alias("params"))
    return RP.training_run(runs, tree.where(F.col("depth") == 1).select("run_id"))


CONFIG_SQL = """cf AS (SELECT p_partkey AS k, 'conf/p' || p_partkey || '.yaml' AS path, '/abs/conf/p' || p_partkey || '.yaml' AS resolved FROM part),
ru AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN '/abs/' ELSE '' END || 'conf/p' || (o_custkey * 2) || '.yaml' AS config_path,
  'run_' || o_orderkey AS run_dir, epoch_us(o_orderdate) // 1000 AS started_ms FROM orders),
nw AS (SELECT config_path, arg_max(run_dir, (started_ms, run_dir)) AS run_dir FROM ru GROUP BY 1)"""


@job("runs_by_config", sql="WITH " + CONFIG_SQL + """
SELECT path, coalesce(a.run_dir, b.run_dir) AS run_dir FROM cf LEFT JOIN nw a ON a.config_path = cf.resolved LEFT JOIN nw b ON b.config_path = cf.path""")
def runs_by_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest run of every configuration."""
    t = Tables(spark, sf_dir)
    path = F.concat(F.lit("conf/p"), F.col("p_partkey").cast("string"), F.lit(".yaml"))
    configs = t.part.select(path.alias("path"), F.concat(F.lit("/abs/"), path).alias("resolved"))
    given = F.concat(F.when(F.col("o_orderkey") % 3 == 0, "/abs/").otherwise(""), F.lit("conf/p"), (F.col("o_custkey") * 2).cast("string"), F.lit(".yaml"))
    runs = t.orders.select(given.alias("config_path"), F.concat(F.lit("run_"), F.col("o_orderkey").cast("string")).alias("run_dir"), F.col("o_orderdate").alias("started_ms"))
    return RP.runs_by_config(configs, runs).select("path", "run_dir")


@job("datasets_to_phases", sql="""WITH ph AS (SELECT l_orderkey AS config_id, l_linenumber AS phase_idx,
  CASE l_returnflag WHEN 'A' THEN 'sft' WHEN 'N' THEN 'dpo' ELSE 'cpt' END AS strategy,
  CASE WHEN l_partkey % 7 = 0 THEN '' ELSE 'd' || (l_partkey % 5) END AS dataset FROM lineitem),
u AS (SELECT config_id, dataset, list(strategy ORDER BY phase_idx, strategy) AS strategies FROM ph
  WHERE dataset IN ('d0', 'd1', 'd2') GROUP BY ALL)
SELECT * FROM u UNION ALL SELECT o_orderkey, 'primary', [] FROM orders WHERE o_orderkey NOT IN (SELECT config_id FROM u)""")
def datasets_to_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The datasets of every configuration with the strategies that use them."""
    t = Tables(spark, sf_dir)
    strategy = F.when(F.col("l_returnflag") == "A", "sft").when(F.col("l_returnflag") == "N", "dpo").otherwise("cpt")
    dataset = F.when(F.col("l_partkey") % 7 == 0, "").otherwise(F.concat(F.lit("d"), (F.col("l_partkey") % 5).cast("string")))
    phases = t.lineitem.select(F.col("l_orderkey").alias("config_id"), F.col("l_linenumber").alias("phase_idx"), strategy.alias("strategy"), dataset.alias("dataset"))
    known = t.orders.select(F.col("o_orderkey").alias("config_id"), F.explode(F.array(*[F.lit(f"d{i}") for i in range(3)])).alias("dataset"))
    return RP.datasets_to_phases(known, phases)


@job("smoke_report", sql="""WITH r AS (SELECT o_custkey % 20 AS batch, 'order_' || o_orderkey AS config, o_orderstatus = 'F' AS ok,
  o_orderkey % 17 = 0 AS timed_out, o_orderkey % 5000 AS s, CASE WHEN o_orderkey % 2 = 0 THEN 'stopped at ' || o_orderkey END AS error FROM orders)
SELECT batch, config, CASE WHEN timed_out THEN 'IDLE' WHEN ok THEN 'PASSED' ELSE 'FAILED' END AS status,
  printf('%dm %02ds', s // 60, s % 60) AS duration,
  CASE WHEN NOT ok THEN coalesce(error, '""" + RP.NO_DETAILS + """') END AS error,
  CAST(NULL AS BIGINT) AS configs, CAST(NULL AS BIGINT) AS passed, CAST(NULL AS BIGINT) AS failed FROM r
UNION ALL SELECT batch, NULL, NULL, printf('%dm %02ds', sum(s)::BIGINT // 60, sum(s)::BIGINT % 60), NULL, count(*),
  count(*) FILTER (WHERE ok), count(*) FILTER (WHERE NOT ok) FROM r GROUP BY batch""")
def smoke_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome of every configuration of a batch, and the batch's totals."""
    k = F.col("o_orderkey")
    rows = Tables(spark, sf_dir).orders.select(
        (F.col("o_custkey") % 20).alias("batch"), F.concat(F.lit("order_"), k.cast("string")).alias("config"),
        F.when(F.col("o_orderstatus") == "F", 0).otherwise(1).alias("exit_code"), (k % 17 == 0).alias("timed_out"),
        (k % 5000).alias("duration_s"), F.when(k % 2 == 0, F.concat(F.lit("stopped at "), k.cast("string"))).alias("error"),
    )
    return RP.smoke_report(rows)


@job("scan_logs", sql="WITH " + LOG_SQL + """
SELECT file, count(*) AS lines, sum(length(line) + CASE WHEN line_no % 1000000 = 0 AND line_no // 1000000 % 13 = 0 THEN 1 ELSE 0 END)::BIGINT AS chars,
  count(*) FILTER (WHERE line_no % 1000000 = 0 AND line_no // 1000000 % 13 = 0) AS replaced FROM lines GROUP BY file""")
def scan_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log files read back line by line; bytes that are no UTF-8 (in some first lines) become replacement characters."""
    path = scratch(spark, "bad_logs")
    no = F.col("line_no")
    broken = (no % 1_000_000 == 0) & (F.floor(no / 1_000_000) % 13 == 0)
    raw = F.when(broken, F.concat(F.col("line").cast("binary"), F.unhex(F.lit("FF")))).otherwise(F.col("line").cast("binary"))
    log_lines(Tables(spark, sf_dir)).select("file", raw.cast("string").alias("value")).write.partitionBy("file").option("lineSep", "\n").text(path)
    lines = spark.read.option("lineSep", "\n").text(path).select("file", F.make_valid_utf8("value").alias("line"))
    return lines.groupBy("file").agg(
        F.count(F.lit(1)).cast("bigint").alias("lines"), F.sum(F.length("line")).cast("bigint").alias("chars"),
        F.count_if(F.col("line").contains("�")).cast("bigint").alias("replaced"),
    )


@job("write_stage_envelope", sql="""WITH o AS (SELECT l_orderkey AS run_id, 'stage_' || l_linenumber AS stage, l_partkey * 1000 + l_suppkey % 1000 AS seq,
  CASE WHEN l_returnflag = 'R' THEN 'failed' WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 'interrupted'
       WHEN l_returnflag = 'N' THEN 'skipped' ELSE 'passed' END AS status,
  l_extendedprice / 7 AS d, 'part ' || l_partkey AS error, l_suppkey FROM lineitem),
f AS (SELECT run_id, stage, arg_min({'status': status, 'd': d, 'error': error, 's': l_suppkey}, (seq, status, d)) AS x FROM o GROUP BY ALL)
SELECT run_id, stage, x.status AS status, CASE WHEN x.status = 'skipped' THEN 0.0 ELSE round_even(x.d, 3) END AS duration_seconds,
  CASE WHEN x.status = 'failed' THEN x.error END AS error, CASE WHEN x.status <> 'skipped' THEN CAST(x.s AS VARCHAR) END AS supplier FROM f""")
def write_stage_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result documents of every stage, written as JSON texts and read back."""
    flag = F.col("l_returnflag")
    status = (
        F.when(flag == "R", "failed").when((flag == "N") & (F.col("l_linestatus") == "O"), "interrupted").when(flag == "N", "skipped").otherwise("passed")
    )
    outcomes = Tables(spark, sf_dir).lineitem.select(
        F.col("l_orderkey").alias("run_id"), (F.col("l_partkey") * 1000 + F.col("l_suppkey") % 1000).alias("part_seq"),
        F.concat(F.lit("stage_"), F.col("l_linenumber").cast("string")).alias("stage"), status.alias("status"),
        F.col("l_shipdate").cast("string").alias("started_at"), (F.col("l_extendedprice") / 7).alias("duration_seconds"),
        F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("error"),
        F.create_map(F.lit("supplier"), F.col("l_suppkey").cast("string")).alias("data"),
    )
    outcomes = outcomes.withColumn("seq", F.struct("part_seq", "status", "duration_seconds"))
    path = scratch(spark, "envelopes")
    RC.envelopes(outcomes).select("run_id", F.to_json("envelope").alias("doc")).write.json(path, compression="gzip")
    docs = spark.read.schema("run_id bigint, doc string").json(path)
    back = RC.stage_results(docs.withColumn("_doc", F.col("doc")))
    return back.select(
        "run_id", "stage", "status", "duration_seconds", "error", F.from_json("_doc", "data map<string,string>")["data"]["supplier"].alias("supplier")
    )


@job("write_report_tables", sql="WITH " + TABLE_SQL + """,
i AS (""" + issues_sql() + """ SELECT * FROM iss)
SELECT 'phases' AS section, 'ok' AS status, run_id, count(*) AS rows FROM pt GROUP BY run_id
UNION ALL SELECT 'summary', 'ok', run_id, 1 FROM pt GROUP BY run_id
UNION ALL SELECT 'issues', 'ok', run_id, count(*) FROM i GROUP BY run_id
UNION ALL SELECT 'broken', 'failed', NULL, 0""")
def write_report_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report's sections written and read back: rows of each section by run; one section fails."""
    t = Tables(spark, sf_dir)
    store = ReportStore(spark, scratch(spark, "reports"))
    sections = {
        "phases": lambda: table_of(t),
        "summary": lambda: PH.run_summary(table_of(t)),
        "broken": lambda: table_of(t).select("no_such_column"),
        "issues": lambda: issues_of(t),
    }
    store.write("all-runs", sections)
    listed = store.sections("all-runs")
    good = [store.read("all-runs", s).groupBy("run_id").agg(F.count(F.lit(1)).alias("rows")).select(F.lit(s).alias("section"), "run_id", "rows") for s in ("phases", "summary", "issues")]
    rows = good[0].unionByName(good[1]).unionByName(good[2])
    return listed.join(rows, "section", "left").select("section", "status", "run_id", F.coalesce("rows", F.lit(0)).alias("rows"))
