"""Jobs on machines and restarts: probe texts, GPU and model facts, restart points, fingerprints.

Stand-ins (fixed rules):

* probes: one per ``events`` row, run = ``user_id``.  The GPU line is broken where ``k % 10 = 0``
  and has no total where ``k % 10 = 1``; container memory is given in version 2 (``k % 4 = 0``),
  version 1 (1), without limit (2) or not at all (3); host memory lacks the available figure
  where ``k % 6 = 0`` and the total where ``k % 6 = 3``.
* facts: events with ``k % 5 = 0`` name a GPU, some with memory (two spellings, some 0) and tier;
  events with ``k % 9 = 0`` carry parameter counts, ``purchase`` events may name a model size.
* restarts: a run is a supplier; lineage rows are its line items by stage (line number), states
  and configurations differ by key.
* fingerprints: a dataset is a ``source`` of ``documents``; tags exist for the fingerprints of
  whole sources with an even number of rows, stale ones (without some rows) for the others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finelens.operators import fingerprints as FP
from finelens.operators import probes as PR
from finelens.operators import restarts as RS
from finelens.plans.registry import job
from finelens.sources.tables import Tables

K_SQL = "CAST(json_extract_string(props, '$.k') AS BIGINT)"


def _events(t: Tables) -> DataFrame:
    return t.events.select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), "event_type", "value",
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
    )


# ---------------------------------------------------------------- probes


def probes(t: Tables) -> DataFrame:
    e, k, s = _events(t), F.col("k"), F.col("seq")
    gpu = F.when(k % 10 == 0, "N/A, 5").otherwise(
        F.format_string(" %d, %d , %s, %s\n", k % 100, s, F.when(k % 10 == 1, "0").otherwise("16384"), F.when(k % 7 == 0, "x").otherwise("61.5"))
    )
    v2 = F.format_string("16777216\nmemory.max=%d\nmemory.current=%d\n", (k + 1) * 1048576, s * 65536)
    v1 = F.format_string("memory.max=max\nmemory.current= 5\nmemory.limit_in_bytes = %d\n  memory.usage_in_bytes=%d", (k + 1) * 1048576, s * 1024)
    none = F.lit("memory.max=max\nmemory.current=77\nmemory.limit_in_bytes=9223372036854771712\nmemory.usage_in_bytes=4096")
    cgroup = F.when(k % 4 == 0, v2).when(k % 4 == 1, v1).when(k % 4 == 2, none)
    meminfo = F.concat(
        F.when(k % 6 == 3, "").otherwise(F.format_string("MemTotal:       %d kB\n", s * 1024 + 4096)),
        F.lit("MemFree:         2048 kB\nMemTotalX: 9 kB\n"),
        F.when(k % 6 == 0, "").otherwise(F.format_string("MemAvailable:   %d kB\n", k)),
    )
    return e.select("run_id", "seq", gpu.alias("gpu_text"), cgroup.alias("cgroup_text"), meminfo.alias("meminfo_text"))


SAMPLES_SQL = f"""pr0 AS (SELECT user_id AS run_id, event_id AS seq, {K_SQL} AS k FROM events),
pr AS (SELECT run_id, seq, CASE WHEN k % 10 <> 0 THEN k % 100 ELSE 0 END::DOUBLE AS gpu_util,
  CASE WHEN k % 10 <> 0 THEN seq ELSE 0 END / 1024 AS vram_used_gb,
  CASE WHEN k % 10 > 1 THEN 16384 ELSE 0 END / 1024 AS vram_total_gb,
  CASE WHEN k % 10 > 1 THEN seq::DOUBLE / 16384.0 * 100.0 ELSE 0.0 END AS vram_pct,
  CASE WHEN k % 10 <> 0 AND k % 7 <> 0 THEN 61.5 ELSE 0.0 END::DOUBLE AS gpu_temp,
  CASE WHEN k % 4 = 0 THEN least(seq * 65536, (k + 1) * 1048576) / 1073741824
       WHEN k % 4 = 1 THEN least(seq * 1024, (k + 1) * 1048576) / 1073741824
       WHEN k % 6 = 3 THEN 0.0 ELSE (seq * 1024 + 4096 - CASE WHEN k % 6 = 0 THEN 2048 ELSE k END) / 1048576 END AS ram_used_gb,
  CASE WHEN k % 4 IN (0, 1) THEN (k + 1) * 1048576 / 1073741824
       WHEN k % 6 = 3 THEN 0.0 ELSE (seq * 1024 + 4096) / 1048576 END AS ram_total_gb FROM pr0)"""


@job("resource_samples", sql="WITH " + SAMPLES_SQL + " SELECT * FROM pr")
def resource_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resource figures of every probe, parsed from its raw texts."""
    return PR.resource_samples(probes(Tables(spark, sf_dir)))


@job("resource_totals", sql="WITH " + SAMPLES_SQL + """
SELECT run_id, count(*) AS samples, avg(gpu_util) AS avg_gpu_util, max(vram_pct) AS peak_vram_pct, max(gpu_temp) AS peak_gpu_temp,
  avg(ram_used_gb) AS avg_ram_used_gb, max(ram_total_gb) AS ram_total_gb FROM pr GROUP BY run_id""")
def resource_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and peak resource use of each run over its probes."""
    return PR.resource_totals(PR.resource_samples(probes(Tables(spark, sf_dir))))


# ---------------------------------------------------------------- GPU and model facts


def fact_events(t: Tables) -> DataFrame:
    e, k, s = _events(t), F.col("k"), F.col("seq")
    text = lambda c: c.cast("string")
    fields = F.struct(
        F.when(k % 5 == 0, F.format_string("GPU-%d", s % 4)).alias("gpu_name"),
        F.when(k % 4 == 0, text(F.when(k % 8 == 0, F.lit(0.0)).otherwise(s % 80 + 0.25))).alias("total_vram_gb"),
        F.when(k % 3 == 0, text(s % 40 + 0.5)).alias("vram_gb"),
        F.when((k % 20 == 0) & (s % 10 == 0), F.when(s % 3 == 0, "").otherwise("high")).alias("gpu_tier"),
        F.when(k % 50 == 10, "low").alias("tier"),
        F.when(k % 9 == 0, text(s * 1000)).alias("total_parameters"),
        F.when(k % 18 == 0, text(s)).alias("trainable_parameters"),
        F.when(k % 27 == 0, text(s / 4.0)).alias("trainable_percent"),
    )
    bought = F.col("event_type") == "purchase"
    size = F.when(k % 2 == 0, F.format_string("Model size: %d.5 MB", k)).otherwise(F.format_string("Model size: %d GB", k))
    return e.select(
        "run_id", "seq", F.from_json(F.to_json(fields), "map<string,string>").alias("attributes"),
        F.when(bought, PR.MODEL_SOURCE).otherwise("Trainer").alias("source"), F.when(bought, size).alias("message"),
    )


def fact_params(t: Tables) -> DataFrame:
    runs = t.events.select(F.col("user_id").alias("run_id")).distinct()
    return runs.select("run_id", F.create_map(F.lit(PR.GPU_NAME_PARAM), F.when(F.col("run_id") % 2 == 0, "param GPU")).alias("params"))


FACT_SQL = f"""fe0 AS (SELECT user_id AS run_id, event_id AS s, event_type, {K_SQL} AS k FROM events),
fe AS (SELECT run_id, s, k, event_type, CASE WHEN k % 5 = 0 THEN 'GPU-' || (s % 4) END AS name,
  CASE WHEN k % 4 = 0 AND k % 8 <> 0 THEN s % 80 + 0.25 WHEN k % 3 = 0 THEN s % 40 + 0.5 END::DOUBLE AS vram,
  CASE WHEN k % 20 = 0 AND s % 10 = 0 AND s % 3 <> 0 THEN 'high' WHEN k % 50 = 10 THEN 'low' END AS tier FROM fe0)"""


@job("gpu_info", sql="WITH " + FACT_SQL + """,
stop AS (SELECT run_id, min(s) AS stop FROM fe WHERE name IS NOT NULL AND vram IS NOT NULL AND tier IS NOT NULL GROUP BY run_id),
pre AS (SELECT fe.* FROM fe LEFT JOIN stop USING (run_id) WHERE name IS NOT NULL AND s <= coalesce(stop, s)),
f AS (SELECT run_id, arg_max(name, s) AS name, arg_max(vram, s) FILTER (WHERE vram IS NOT NULL) AS vram,
  arg_max(tier, s) FILTER (WHERE tier IS NOT NULL) AS tier FROM pre GROUP BY run_id),
r AS (SELECT DISTINCT run_id FROM fe)
SELECT run_id, coalesce(f.name, CASE WHEN run_id % 2 = 0 THEN 'param GPU' END) AS name, printf('%.1fGB', vram) AS total_vram,
  vram AS total_vram_gb, tier FROM r LEFT JOIN f USING (run_id) WHERE f.name IS NOT NULL OR run_id % 2 = 0""")
def gpu_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GPU name, memory and tier of each run."""
    t = Tables(spark, sf_dir)
    return PR.gpu_info(fact_events(t), fact_params(t))


@job("model_info", sql="WITH " + FACT_SQL + """,
p AS (SELECT run_id, arg_max({'a': s * 1000, 'b': CASE WHEN k % 18 = 0 THEN s END, 'c': CASE WHEN k % 27 = 0 THEN s / 4.0 END}, s) AS m
  FROM fe WHERE k % 9 = 0 GROUP BY run_id),
z AS (SELECT run_id, arg_max(k + 0.5, s)::DOUBLE AS model_size_mb FROM fe WHERE event_type = 'purchase' AND k % 2 = 0 GROUP BY run_id)
SELECT run_id, m.a AS total_parameters, m.b AS trainable_parameters, m.c::DOUBLE AS trainable_percent,
  CAST(NULL AS DOUBLE) AS model_loading_time_seconds, model_size_mb FROM p FULL JOIN z USING (run_id)""")
def model_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameter counts and model size of each run."""
    return PR.model_info(fact_events(Tables(spark, sf_dir)))


# ---------------------------------------------------------------- restarts


def stage_lineage(t: Tables) -> DataFrame:
    """Current outputs per (supplier, stage): the line item with the greatest (order, part) key."""
    order = F.array(*[F.lit(s) for s in RS.STAGES])
    li = t.lineitem.where(F.col("l_linenumber") <= len(RS.STAGES)).select(
        F.col("l_suppkey").alias("run_id"), F.get(order, F.col("l_linenumber").cast("int") - 1).alias("stage_name"),
        F.struct("l_orderkey", "l_partkey").alias("at"),
    )
    last = li.groupBy("run_id", "stage_name").agg(F.max("at").alias("at"))
    o, p = F.col("at.l_orderkey"), F.col("at.l_partkey")
    outputs = F.create_map(
        F.lit("ssh_host"), F.concat(F.lit("h"), o.cast("string")),
        F.lit("ssh_port"), F.when(o % 3 == 0, "").otherwise("22"),
        F.lit("workspace_path"), F.when(p % 5 != 0, "/w"),
        F.lit("hf_repo_id"), F.when(o % 2 == 0, "repo"),
        F.lit("local_model_path"), F.when(p % 2 == 0, "").otherwise("/m"),
    )
    return last.where((o + p) % 7 != 0).select("run_id", "stage_name", outputs.alias("outputs"))


def restart_states(t: Tables) -> tuple[DataFrame, DataFrame]:
    k = F.col("s_suppkey")
    name = lambda p, n: F.concat(F.lit(p), (k % n).cast("string"))
    states = t.supplier.select(
        k.alias("run_id"), F.when(k % 4 == 1, "").when(k % 4 != 2, name("m", 5)).alias("model_dataset_hash"),
        name("t", 6).alias("training_hash"), name("l", 7).alias("late_hash"),
    )
    now = t.supplier.select(
        k.alias("run_id"), F.when(k % 5 == 3, "new").otherwise(name("m", 5)).alias("model_dataset_hash"),
        F.when(k % 6 == 5, "new").otherwise(name("t", 6)).alias("training_hash"),
        F.when(k % 7 == 4, "new").otherwise(name("l", 7)).alias("late_hash"),
    )
    return states, now


STAGE_VALUES = ", ".join(f"({i}, '{s}')" for i, s in enumerate(RS.STAGES))
LINEAGE_SQL = f"""stages(pos, stage) AS (VALUES {STAGE_VALUES}),
lin0 AS (SELECT l_suppkey AS run_id, l_linenumber - 1 AS pos, max((l_orderkey, l_partkey)) AS best FROM lineitem
  WHERE l_linenumber <= 6 GROUP BY ALL),
lin AS (SELECT run_id, pos, stage AS stage_name, best[1] AS o, best[2] AS p FROM lin0 JOIN stages USING (pos)
  WHERE (best[1] + best[2]) % 7 <> 0)"""


@job("restart_points", sql="WITH " + LINEAGE_SQL + """,
c AS (SELECT s_suppkey AS run_id, s_suppkey % 7 = 4 AS late,
  CASE WHEN s_suppkey % 4 IN (0, 3) THEN s_suppkey % 5 = 3 ELSE s_suppkey % 6 = 5 END AS training FROM supplier),
g AS (SELECT c.*, s.pos, s.stage, gpu.o % 3 <> 0 AND gpu.p % 5 <> 0 AS reachable, gpu.run_id IS NOT NULL AS gpu,
  coalesce(m.o % 2 = 0 OR m.p % 2 <> 0, false) AS model, i.run_id IS NOT NULL AS inference
  FROM c, stages s LEFT JOIN lin gpu ON gpu.run_id = c.run_id AND gpu.pos = 1 LEFT JOIN lin m ON m.run_id = c.run_id AND m.pos = 3
  LEFT JOIN lin i ON i.run_id = c.run_id AND i.pos = 4),
r AS (SELECT run_id, pos, stage,
  CASE pos WHEN 2 THEN 'reconnect_only' WHEN 3 THEN 'fresh_or_resume' WHEN 4 THEN 'fresh_or_resume' WHEN 5 THEN 'live_runtime_only'
       ELSE 'fresh_only' END AS mode,
  CASE WHEN late AND pos < 4 THEN 'late_stage_config_changed' WHEN training THEN 'training_critical_config_changed'
       WHEN pos = 2 AND NOT coalesce(reachable, false) THEN 'missing_gpu_deployer_outputs' WHEN pos = 3 AND NOT gpu THEN 'missing_gpu_deployer_outputs'
       WHEN pos = 4 AND NOT model THEN 'missing_model_retriever_outputs' WHEN pos = 5 AND NOT inference THEN 'missing_inference_outputs'
       ELSE 'restart_allowed' END AS reason FROM g)
SELECT run_id, pos, stage, reason = 'restart_allowed' AS available, mode, reason FROM r""")
def restart_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether and how every run can start again at each stage."""
    t = Tables(spark, sf_dir)
    states, now = restart_states(t)
    return RS.restart_points(states, stage_lineage(t), now)


@job("lineage_invalidate", sql="WITH " + LINEAGE_SQL + """
SELECT run_id, stage_name, 'h' || o AS host FROM lin WHERE run_id % 8 = 6 OR run_id % 8 = 7 OR pos < run_id % 8""")
def lineage_invalidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs that stay valid: supplier n starts again at stage n % 8, where there is one."""
    t = Tables(spark, sf_dir)
    order, at = F.array(*[F.lit(s) for s in RS.STAGES]), (F.col("s_suppkey") % 8).cast("int")
    starts = t.supplier.where(at < len(RS.STAGES)).select(F.col("s_suppkey").alias("run_id"), F.get(order, at).alias("start_stage"))
    kept = RS.lineage_invalidate(stage_lineage(t), starts)
    return kept.select("run_id", "stage_name", F.col("outputs")["ssh_host"].alias("host"))


# ---------------------------------------------------------------- fingerprints

FP_COLUMNS = ["doc_id", "text", "lang"]
FP_SQL = """h AS (SELECT source AS dataset, doc_id,
    concat_ws(',', length(CAST(doc_id AS VARCHAR)) || ':' || doc_id, coalesce(length(text) || ':' || text, '-'),
              coalesce(length(lang) || ':' || lang, '-')) AS t FROM documents),
st AS (SELECT dataset, count(*) AS rows, sum(('0x' || substr(sha256(t), 1, 15))::BIGINT) AS sum1,
  sum(('0x' || substr(md5(t), 1, 15))::BIGINT) AS sum2 FROM h GROUP BY dataset),
old AS (SELECT dataset, count(*) AS rows, sum(('0x' || substr(sha256(t), 1, 15))::BIGINT) AS sum1,
  sum(('0x' || substr(md5(t), 1, 15))::BIGINT) AS sum2 FROM h WHERE doc_id % 97 <> 0 GROUP BY dataset),
fp AS (SELECT dataset, rows, substr(sha256(rows || ':' || sum1 || ':' || sum2), 1, 10) AS fingerprint FROM st),
fo AS (SELECT dataset, substr(sha256(rows || ':' || sum1 || ':' || sum2), 1, 10) AS fingerprint FROM old)"""


@job("dataset_fingerprint", sql="WITH " + FP_SQL + " SELECT dataset, rows, fingerprint FROM fp")
def dataset_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content fingerprint of every dataset, the same in any order and partitioning."""
    states = FP.fingerprint_state(Tables(spark, sf_dir).documents, "source", FP_COLUMNS)
    return states.select(F.col("source").alias("dataset"), "rows", FP.fingerprint().alias("fingerprint"))


STRATEGIES = ("cpt", "sft", "dpo")


@job("cache_hit", sql="WITH " + FP_SQL + """,
ph(phase_idx, strategy) AS (VALUES (0, 'cpt'), (1, 'sft'), (2, 'dpo')),
tags AS (SELECT dataset, 'phase-' || phase_idx || '-' || strategy || '-ds' || fingerprint AS tag FROM fp, ph
         WHERE rows % 2 = 0 AND phase_idx < 2
         UNION SELECT dataset, 'phase-' || phase_idx || '-' || strategy || '-ds' || fingerprint FROM fo, ph)
SELECT fp.dataset, phase_idx, strategy, 'repo-' || fp.dataset AS repo,
  'phase-' || phase_idx || '-' || strategy || '-ds' || fingerprint AS expected_tag,
  EXISTS (SELECT 1 FROM tags WHERE tags.dataset = fp.dataset AND tag = 'phase-' || phase_idx || '-' || strategy || '-ds' || fingerprint) AS hit
FROM fp, ph""")
def cache_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which phases find a cached result of just their dataset's content."""
    docs = Tables(spark, sf_dir).documents.withColumn("_old", F.col("doc_id") % 97 != 0)
    parts = FP.fingerprint_state(docs.withColumn("part", F.struct("source", "_old")), "part", FP_COLUMNS)
    parts = parts.select(F.col("part.source").alias("dataset"), F.col("part._old").alias("_old"), "rows", "sum1", "sum2")
    # the state without the newer rows, and with them added to it
    stale = parts.where("_old").select("dataset", FP.fingerprint().alias("fingerprint"))
    now = FP.merged_states(parts.drop("_old"), "dataset").select("dataset", "rows", FP.fingerprint().alias("fingerprint"))
    plan = F.explode(F.array(*[F.struct(F.lit(i).alias("phase_idx"), F.lit(s).alias("strategy")) for i, s in enumerate(STRATEGIES)]))
    repo = F.concat(F.lit("repo-"), F.col("dataset")).alias("repo")
    tag = F.format_string(FP.TAG, F.col("p.phase_idx").cast("string"), F.col("p.strategy"), F.col("fingerprint")).alias("tag")
    tags = now.where("rows % 2 = 0").select(repo, "fingerprint", plan.alias("p")).where("p.phase_idx < 2").select("repo", tag)
    tags = tags.unionByName(stale.select(repo, "fingerprint", plan.alias("p")).select("repo", tag))
    phases = now.select("dataset", plan.alias("p"), repo).select("dataset", "p.phase_idx", "p.strategy", "repo")
    return FP.cache_hits(phases, now, tags)
