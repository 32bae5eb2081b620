"""Source and sink jobs.  Files are first written from the driver tables into
the shared checkpoint folder (never a machine-local temp dir), then read
back with the library readers; sinks write there and return what was
written.  Plus small jobs over the generated tables that have SQL twins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finelens.functions.text import normalize_pair_text
from finelens.operators import evaluate as EVAL
from finelens.operators import runs as R
from finelens.operators.ordering import with_position
from finelens.plans.events import EV_SQL
from finelens.plans.registry import job
from finelens.sources import files as FS
from finelens.sources.tables import Tables
from finelens.streaming.jobs import scratch


#: Documents of one JSON array file.
ARRAY_DOCS = 4096
HEAD = 500


@job("scan_json", sql=f"""WITH d AS (SELECT source AS dataset, row_number() OVER (ORDER BY doc_id) - 1 AS row_idx FROM documents),
f(format) AS (VALUES ('jsonl'), ('array'))
SELECT format, dataset, count(*) AS rows, min(row_idx) AS first_row, max(row_idx) AS last_row,
  count(*) FILTER (WHERE row_idx < {HEAD}) AS rows_in_head FROM d, f GROUP BY ALL""")
def scan_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as JSONL and as JSON arrays, read back with an inferred schema, row numbers and a head of rows."""
    d = Tables(spark, sf_dir).documents
    base = scratch(spark, "json")
    d.repartitionByRange("doc_id").sortWithinPartitions("doc_id").write.json(base + "/lines")
    chunk = F.lpad(F.floor(F.col("doc_id") / ARRAY_DOCS).cast("string"), 12, "0")
    arrays = d.groupBy(chunk.alias("chunk")).agg(F.to_json(F.array_sort(F.collect_list(F.struct(*d.columns)))).alias("value"))
    arrays.repartition("chunk").write.partitionBy("chunk").text(base + "/arrays")
    parts = []
    for name, path in (("jsonl", "/lines"), ("array", "/arrays")):
        whole = FS.read_json_dataset(spark, base + path, row_idx="row_idx").groupBy(F.col("source").alias("dataset")).agg(
            F.count(F.lit(1)).cast("bigint").alias("rows"), F.min("row_idx").alias("first_row"), F.max("row_idx").alias("last_row")
        )
        head = FS.read_json_dataset(spark, base + path, head=HEAD).groupBy(F.col("source").alias("dataset")).agg(F.count(F.lit(1)).alias("rows_in_head"))
        parts.append(whole.join(head, "dataset", "left").select(F.lit(name).alias("format"), "*").fillna(0, ["rows_in_head"]))
    return parts[0].unionByName(parts[1])


@job("file_stats")
def file_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, MB, extension and line count of every written JSONL part file."""
    path = scratch(spark, "stats")
    Tables(spark, sf_dir).documents.select("doc_id", "source", "text").write.json(path)
    return FS.file_stats(spark, path)


@job("scan_any_file", sql="""SELECT format, count(*) AS rows, sum(length(source) + length(lang))::BIGINT AS chars
FROM documents, (VALUES ('csv'), ('jsonl'), ('json'), ('parquet')) f(format) GROUP BY format""")
def scan_any_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load by suffix: the documents table as CSV, JSONL, JSON array files and Parquet, rows per format."""
    base = scratch(spark, "any")
    d = Tables(spark, sf_dir).documents.select("doc_id", "source", "lang")
    d.write.option("header", True).csv(base + "/d.csv")
    d.write.json(base + "/d.jsonl")
    d.write.parquet(base + "/d.parquet")
    chunk = F.floor(F.col("doc_id") / ARRAY_DOCS).cast("string")
    arrays = d.groupBy(chunk.alias("chunk")).agg(F.to_json(F.collect_list(F.struct(*d.columns))).alias("value"))
    arrays.repartition("chunk").write.partitionBy("chunk").text(base + "/d.json")
    parts = [FS.read_any(spark, base + f"/d.{s}").select(F.lit(s).alias("format"), "source", "lang") for s in ("csv", "jsonl", "json", "parquet")]
    u = reduce(DataFrame.unionByName, parts)
    chars = F.length("source") + F.length("lang")
    return u.groupBy("format").agg(F.count(F.lit(1)).cast("bigint").alias("rows"), F.sum(chars).cast("bigint").alias("chars"))


#: Items of one evaluation file.
FILE_ITEMS = 1000


@job("scan_eval_jsonl", sql=f"""WITH l AS (SELECT p_partkey // {FILE_ITEMS} AS file, p_partkey AS i,
  row_number() OVER (PARTITION BY p_partkey // {FILE_ITEMS} ORDER BY p_partkey) AS line_no FROM part)
SELECT file, count(*) FILTER (WHERE i % 13 <> 0 AND i % 17 <> 0 AND i % 19 <> 0) AS good_rows,
  count(*) FILTER (WHERE i % 13 = 0 OR (i % 17 <> 0 AND i % 19 = 0)) AS bad_lines,
  min(line_no) FILTER (WHERE i % 13 = 0 OR (i % 17 <> 0 AND i % 19 = 0)) AS first_bad_line,
  sum(line_no) FILTER (WHERE i % 13 <> 0 AND i % 17 <> 0 AND i % 19 <> 0)::BIGINT AS good_line_sum FROM l GROUP BY file""")
def scan_eval_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation JSONL with blank, broken and non-object lines: good rows and bad lines of each file with their line numbers."""
    from finelens.plans.evaluation import eval_items

    path = scratch(spark, "eval_jsonl")
    i = F.col("sample_idx")
    good = F.to_json(F.struct("sample_idx", "question", "expected_answer"))
    line = (
        F.when(i % 13 == 0, F.concat(F.lit('{"question": "broken'), i.cast("string")))
        .when(i % 17 == 0, F.lit(" "))
        .when(i % 19 == 0, F.lit("[1, 2]"))
        .otherwise(good)
    )
    items = eval_items(Tables(spark, sf_dir)).select("sample_idx", line.alias("value"), F.floor(i / FILE_ITEMS).alias("file"))
    # all lines of a file in one partition, in order: FILE_ITEMS at most
    items.repartition("file").sortWithinPartitions("file", "sample_idx").select("value", "file").write.partitionBy("file").text(path)
    ok, bad = FS.read_eval_jsonl(spark, path, "sample_idx BIGINT, question STRING, expected_answer STRING")
    file = F.regexp_extract("path", r"/file=(\d+)/", 1).cast("bigint").alias("file")
    a = ok.groupBy(file).agg(F.count(F.lit(1)).cast("bigint").alias("good_rows"), F.sum("line_no").alias("good_line_sum"))
    b = bad.groupBy(file).agg(F.count(F.lit(1)).cast("bigint").alias("bad_lines"), F.min("line_no").alias("first_bad_line"))
    return a.join(b, "file", "full").select("file", "good_rows", "bad_lines", "first_bad_line", "good_line_sum").fillna(0, ["good_rows", "bad_lines"])


@job("scan_required_columns", sql="""SELECT CAST(count(*) AS BIGINT) AS rows, '' AS missing_fields, true AS passed FROM documents""")
def scan_required_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load a table and check required columns (a metadata check; no job for the schema)."""
    df = Tables(spark, sf_dir).documents
    missing = sorted({"text", "source", "doc_id"} - set(df.columns))
    return df.agg(F.count(F.lit(1)).cast("bigint").alias("rows")).select(
        "rows", F.lit(",".join(missing)).alias("missing_fields"), F.lit(not missing).alias("passed")
    )


@job("normalize_pair_text", sql="""SELECT doc_id AS row_idx,
  lower(regexp_replace(coalesce(text, 'None'), '^@WS@+|@WS@+$', '', 'g')) AS normalized FROM documents""")
def normalize_pair_text_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Tables(spark, sf_dir).documents
    return d.select(F.col("doc_id").alias("row_idx"), normalize_pair_text("text").alias("normalized"))


@job("aggregate_scores", sql="""WITH s AS (
  SELECT p_partkey % 7 AS variant,
    CASE WHEN len(list_distinct(list_concat(ta, tb))) = 0 THEN 0.0
         ELSE CAST(len(list_intersect(ta, tb)) AS DOUBLE) / len(list_distinct(list_concat(ta, tb))) END AS score
  FROM (SELECT p_partkey, list_distinct(regexp_extract_all(lower(p_name), '[A-Za-z_][A-Za-z0-9_]*')) AS ta,
               list_distinct(regexp_extract_all(lower(p_type), '[A-Za-z_][A-Za-z0-9_]*')) AS tb FROM part)),
r AS (SELECT variant, score, CAST(greatest(1, least(5, round_even(score * 5, 0))) AS INTEGER) AS raw_score FROM s)
SELECT variant, CAST(count(*) AS BIGINT) AS sample_count, CAST(0 AS BIGINT) AS failed_count, avg(score) AS mean_score,
  quantile_cont(score, 0.5) AS p50_score,
  CAST(count(*) FILTER (WHERE raw_score = 1) AS BIGINT) AS score_1, CAST(count(*) FILTER (WHERE raw_score = 2) AS BIGINT) AS score_2,
  CAST(count(*) FILTER (WHERE raw_score = 3) AS BIGINT) AS score_3, CAST(count(*) FILTER (WHERE raw_score = 4) AS BIGINT) AS score_4,
  CAST(count(*) FILTER (WHERE raw_score = 5) AS BIGINT) AS score_5, avg(score) >= 0.6 AS passed
FROM r GROUP BY variant""")
def aggregate_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mean, interpolated p50, 1..5 distribution, verdict per group of unit scores
    (scores: token Jaccard of part name vs type, grouped by key % 7)."""
    from finelens.functions.query_text import token_jaccard

    p = Tables(spark, sf_dir).part
    s = p.select((F.col("p_partkey") % 7).alias("variant"), token_jaccard(F.lower("p_name"), F.lower("p_type")).alias("score"))
    s = s.withColumn("raw_score", EVAL.raw_score_from_unit(F.col("score")))
    return EVAL.aggregate_scores(s, ["variant"])


@job("runs_list", sql="""WITH r AS (SELECT o_custkey AS run_id,
  arg_max(CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END, o_orderkey) AS status,
  CAST(count(*) AS BIGINT) AS attempts, min(o_orderdate) AS first_started_at,
  max(CASE WHEN o_orderstatus <> 'O' THEN o_orderdate + INTERVAL 1 DAY * (o_orderkey % 5) END) AS last_completed_at
  FROM orders GROUP BY o_custkey),
d AS (SELECT *, epoch(last_completed_at)::BIGINT - epoch(first_started_at)::BIGINT AS s FROM r)
SELECT row_number() OVER (ORDER BY first_started_at DESC, run_id) - 1 AS position, run_id, 'conf_' || (run_id % 10) AS config, status, attempts,
  first_started_at, last_completed_at, CASE WHEN s IS NULL OR s < 0 THEN '' WHEN s >= 3600 THEN printf('%dh %dm %ds', s // 3600, s // 60 % 60, s % 60)
    WHEN s >= 60 THEN printf('%dm %ds', s // 60, s % 60) ELSE printf('%ds', s) END AS duration FROM d""")
def runs_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run catalog, newest first: configuration, latest status, attempts, first start, last end, duration."""
    from finelens.plans.runs import attempts

    a = R.attempt_state(attempts(Tables(spark, sf_dir)))
    rows = a.select(
        "run_id", F.concat(F.lit("conf_"), (F.col("run_id") % 10).cast("string")).alias("config"), "status", "attempts", "first_started_at",
        "last_completed_at", R.duration_hms(F.col("first_started_at"), F.col("last_completed_at")).alias("duration"),
    )
    return with_position(rows, [], [F.col("first_started_at").desc(), F.col("run_id")], "position")


@job("aggregate_phases", sql="""WITH li AS (SELECT l_orderkey, count(*) AS steps, sum(l_quantity) AS runtime FROM lineitem GROUP BY 1)
SELECT o_custkey AS run_id, CAST(count(*) AS BIGINT) AS phases, CAST(sum(coalesce(steps, 0)) AS BIGINT) AS total_steps,
  sum(coalesce(runtime, 0.0)) AS total_runtime, arg_max(o_totalprice / 100000.0, o_orderkey) AS final_loss
FROM orders LEFT JOIN li ON l_orderkey = o_orderkey GROUP BY o_custkey""")
def aggregate_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per run: phases, steps, runtime and the last phase's loss (may be null)."""
    t = Tables(spark, sf_dir)
    li = t.lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("steps"), F.sum("l_quantity").alias("runtime"))
    o = t.orders.join(li, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return o.groupBy(F.col("o_custkey").alias("run_id")).agg(
        F.count(F.lit(1)).cast("bigint").alias("phases"),
        F.sum(F.coalesce("steps", F.lit(0))).cast("bigint").alias("total_steps"),
        F.sum(F.coalesce("runtime", F.lit(0.0))).alias("total_runtime"),
        F.max_by(F.col("o_totalprice") / F.lit(100000.0), "o_orderkey").alias("final_loss"),
    )


@job("group_sample_errors", sql="""WITH lines AS (
  SELECT printf('Sample %d: %s', doc_id, CASE WHEN length(regexp_replace(coalesce(text, 'None'), '^@WS@+|@WS@+$', '', 'g')) < 10
    THEN 'text too short' ELSE 'language ' || lang END) AS line FROM documents),
p AS (SELECT CAST(regexp_extract(line, '^Sample (\\d+): (.*)$', 1) AS BIGINT) AS idx, regexp_extract(line, '^Sample (\\d+): (.*)$', 2) AS msg
      FROM lines)
SELECT msg, CAST(count(*) AS BIGINT) AS total, array_to_string(list_sort(list(idx))[1:20], ',') AS shown,
  CAST(greatest(count(*) - 20, 0) AS BIGINT) AS hidden FROM p GROUP BY msg""")
def group_sample_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """'Sample i: msg' lines grouped by message: first 20 sorted ids shown, the rest counted."""
    from finelens.functions.text import py_strip_length

    d = Tables(spark, sf_dir).documents
    msg = F.when(py_strip_length(F.coalesce("text", F.lit("None"))) < 10, F.lit("text too short")).otherwise(
        F.concat(F.lit("language "), F.col("lang"))
    )
    lines = d.select(F.format_string("Sample %d: %s", F.col("doc_id"), msg).alias("line"))
    pat = r"^Sample (\d+): (.*)$"
    p = lines.select(F.regexp_extract("line", pat, 1).cast("bigint").alias("row_idx"), F.regexp_extract("line", pat, 2).alias("error_type"))
    from finelens.operators.checks import error_groups

    g = error_groups(p.withColumn("_g", F.lit(1)), ["_g"], max_examples=20)
    return g.select(
        F.col("error_type").alias("msg"), F.col("total_count").alias("total"),
        F.array_join("sample_indices", ",").alias("shown"), F.greatest(F.col("total_count") - 20, F.lit(0)).alias("hidden"),
    )


@job("write_eval_rows")
def write_eval_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per evaluated sample with score, raw score and label, written partitioned by evaluator."""
    from finelens.plans.evaluation import eval_items

    sm = EVAL.semantic_match(eval_items(Tables(spark, sf_dir)))
    score = F.round("score", 4)
    raw = EVAL.raw_score_from_unit(score)
    label = EVAL.score_label(score, raw)
    rows = sm.select(
        F.lit("semantic_match").alias("evaluator"), "sample_idx", "question", "model_answer", "expected_answer",
        score.alias("score"), raw.alias("raw_score"), F.array_join("hard_eval_errors", ",").alias("note"), label.alias("label"),
    )
    path = scratch(spark, "eval_rows")
    rows.write.partitionBy("evaluator").parquet(path)
    return spark.read.parquet(path)


@job("write_validation_artifact")
def write_validation_artifact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per dataset document with its check entries and status, written as JSON."""
    from finelens.operators import checks as C

    prof = C.text_profile(Tables(spark, sf_dir).text_samples, ["dataset"])
    rows = C.default_check_results(prof, ["dataset"])
    doc = rows.groupBy("dataset").agg(
        F.array_sort(
            F.collect_list(F.struct("priority", "check", "passed", "metrics", "errors", "warnings")),
            lambda a, b: (a["priority"] - b["priority"]).cast("int"),
        ).alias("checks"),
        F.bool_and("passed").alias("passed"),
    ).withColumn("status", F.when(F.col("passed"), "passed").otherwise("failed"))
    path = scratch(spark, "validation_artifact")
    doc.write.json(path)
    return spark.read.json(path).select("dataset", "status", F.size("checks").alias("checks"))


@job("write_events", sql="WITH " + EV_SQL + " SELECT category, CAST(count(*) AS BIGINT) AS total FROM ev GROUP BY category")
def write_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event log exported as parquet partitioned by category; returns totals per category."""
    from finelens.plans.events import event_log

    path = scratch(spark, "events")
    event_log(Tables(spark, sf_dir)).write.partitionBy("category").parquet(path)
    return spark.read.parquet(path).groupBy("category").agg(F.count(F.lit(1)).cast("bigint").alias("total"))
