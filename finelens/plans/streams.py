"""Streaming jobs (rows-only checks; each has a batch twin in the tests).

Sources are the driver tables read as file streams; log files and JSON
event files are first written from the driver tables into the shared
checkpoint folder, then followed as streams.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finelens.operators.checks import TextThresholds
from finelens.plans.events import TYPE_OF_EVENT
from finelens.plans.registry import job
from finelens.sources.tables import Tables, epoch_ms
from finelens.streaming import jobs as S
from finelens.streaming import outcomes as O

BY = ["dataset"]
TH = TextThresholds.defaults()


def _doc_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = S.read_table_stream(spark, sf_dir, "documents")
    return d.select(F.col("source").alias("dataset"), F.col("doc_id").alias("row_idx"), "text")


@job("stream_validate", sql=r"""WITH t AS (SELECT source AS dataset, coalesce(text, 'None') AS t FROM documents),
m AS (SELECT dataset, CAST(count(*) AS BIGINT) AS sample_count, CAST(sum(length(t)) AS BIGINT) AS total_length,
  CAST(count(*) FILTER (WHERE length(regexp_replace(t, '^@WS@+|@WS@+$', '', 'g')) < 10) AS BIGINT) AS empty_count,
  CAST(sum(len([x for x in regexp_split_to_array(lower(t), '@WS@+') if x <> ''])) AS BIGINT) AS total_tokens FROM t GROUP BY 1)
SELECT *, sample_count >= @MIN@ AS min_samples_passed, total_length / sample_count AS avg_length,
  total_length / sample_count BETWEEN @AVG_MIN@ AND @AVG_MAX@ AS avg_length_passed,
  empty_count / sample_count AS empty_ratio, empty_count / sample_count <= @EMPTY@ AS empty_ratio_passed FROM m"""
     .replace("@MIN@", str(TH.min_samples)).replace("@AVG_MIN@", str(TH.avg_min)).replace("@AVG_MAX@", str(TH.avg_max))
     .replace("@EMPTY@", str(TH.empty_max_ratio)))
def stream_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mergeable text checks (count, mean length, short ratio, tokens) over a stream."""
    m = S.run_complete(S.stream_text_metrics(_doc_stream(spark, sf_dir), BY), "stream_validate")
    return S.verdict_of_stream_metrics(m)


@job("stream_min_samples", sql="""SELECT source AS dataset, CAST(count(*) AS BIGINT) AS sample_count, count(*) >= 100 AS passed
FROM documents GROUP BY 1""")
def stream_min_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running sample count per dataset of an unbounded input, verdict >= 100."""
    agg = _doc_stream(spark, sf_dir).groupBy(*BY).agg(F.count(F.lit(1)).cast("bigint").alias("sample_count"))
    return S.run_complete(agg, "stream_min_samples").withColumn("passed", F.col("sample_count") >= 100)


@job("stream_dedup", sql="""SELECT source AS dataset, CAST(count(DISTINCT md5(coalesce(text, 'None'))) AS BIGINT) AS unique_count
FROM documents GROUP BY 1""")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicates among arriving texts: first occurrences kept in state, counted per dataset."""
    firsts = S.run_append(S.stream_dedup(_doc_stream(spark, sf_dir), BY), "stream_dedup")
    return firsts.groupBy(*BY).agg(F.count(F.lit(1)).cast("bigint").alias("unique_count"))


@job("metric_sampling", sql="""SELECT user_id AS run_id, event_id AS step, value FROM events WHERE event_id % 10 = 0""")
def metric_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keep every 10th step of the metric series (the operator is the sampling rule)."""
    from finelens.plans.metrics import metric_points

    return metric_points(Tables(spark, sf_dir)).where(F.col("step") % 10 == 0).select("run_id", "step", "value")


def _write_logs(spark: SparkSession, sf_dir: str) -> str:
    from finelens.plans.runs import log_lines

    path = S.scratch(spark, "logs")
    log_lines(Tables(spark, sf_dir)).select("file", "line").write.partitionBy("file").text(path)
    return path


@job("log_follow", sql="""SELECT source AS file, CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS lines
FROM documents GROUP BY 1""")
def log_follow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Follow log files as a file stream: only new lines are delivered, offsets live in the checkpoint."""
    path = _write_logs(spark, sf_dir)
    lines = spark.readStream.text(path)
    got = S.run_append(lines.select("file", "value"), "log_follow")
    return got.groupBy("file").agg(F.count(F.lit(1)).cast("bigint").alias("lines"))


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = S.read_table_stream(spark, sf_dir, "events")
    return S.with_event_time(e.select(F.col("user_id").alias("run_id"), "ts", "event_type", "value"))


@job("resource_status", sql="""SELECT user_id AS run_id, time_bucket(INTERVAL 15 SECOND, ts) AS window_start,
  time_bucket(INTERVAL 15 SECOND, ts) + INTERVAL 15 SECOND AS window_end, arg_max(value, (ts, value)) AS last_value,
  CAST(count(*) AS BIGINT) AS samples FROM events GROUP BY 1, 2, 3""")
def resource_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last value per run in every 15-second window."""
    return S.run_update(S.resource_status(_event_stream(spark, sf_dir)), ["run_id", "window_start", "window_end"], "resource_status")


@job("liveness", sql="""WITH l AS (SELECT user_id AS run_id, max(ts) AS last_event_time FROM events GROUP BY 1),
i AS (SELECT *, epoch(date_trunc('second', (SELECT max(ts) FROM events))) - epoch(date_trunc('second', last_event_time)) AS idle FROM l)
SELECT run_id, last_event_time, CAST(idle AS BIGINT) AS idle_seconds, idle > 1200 AS dead FROM i""")
def liveness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Idle seconds of each run at the time of the newest event; > 1200 s = dead."""
    last = S.run_complete(S.last_seen(_event_stream(spark, sf_dir)), "liveness")
    as_of = S.with_event_time(Tables(spark, sf_dir).events).agg(F.max("event_time").alias("as_of")).withColumn("_k", F.lit(1))
    j = last.withColumn("_k", F.lit(1)).join(as_of, "_k").drop("_k")
    return S.liveness(j, F.col("as_of")).drop("as_of")


@job("event_ingest", sql="""WITH e AS (SELECT user_id AS run_id, event_id AS seq, CAST(ts AS VARCHAR) AS timestamp,
  CASE event_type @TYPES@ ELSE event_type END AS event_type, 'event ' || event_id AS message FROM events)
SELECT *, CASE event_type WHEN 'warning' THEN 'WARN' WHEN 'error' THEN 'ERROR' ELSE 'INFO' END AS severity,
  CASE event_type WHEN 'warning' THEN 13 WHEN 'error' THEN 17 ELSE 9 END AS severity_number, event_type = 'error' AS is_error FROM e"""
     .replace("@TYPES@", " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in TYPE_OF_EVENT.items())))
def event_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed append of JSON event files with severity and error flag."""
    src = S.scratch(spark, "event_json")
    e = Tables(spark, sf_dir).events
    et = F.coalesce(*[F.when(F.col("event_type") == a, F.lit(b)) for a, b in TYPE_OF_EVENT.items()], F.col("event_type"))
    e.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), F.col("ts").cast("string").alias("timestamp"),
             et.alias("event_type"), F.format_string("event %d", F.col("event_id")).alias("message")).write.json(src)
    schema = "run_id BIGINT, seq BIGINT, timestamp STRING, event_type STRING, message STRING"
    return S.run_append(S.typed_events(spark.readStream.schema(schema).json(src)), "event_ingest")


#: A run's events are hours apart; on a clock this much faster exits and markers meet within the grace period.
OUTCOME_CLOCK = 3600
OUTCOME_DELAY_MS = 10_000


@job("training_outcome", sql="""WITH e AS (SELECT user_id AS run_id, epoch_us(ts) // 1000 // @CLOCK@ AS ms, event_type,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_id FROM events),
w AS (SELECT max(ms) - @DELAY@ AS watermark FROM e),
r AS (SELECT run_id, min(ms) FILTER (WHERE event_type = 'purchase' AND k % 40 = 0) AS c,
  min(ms) FILTER (WHERE event_type = 'error' AND k % 30 = 0) AS f,
  arg_min('stopped with ' || event_id, (ms, 'stopped with ' || event_id)) FILTER (WHERE event_type = 'error' AND k % 30 = 0) AS text,
  min(ms) FILTER (WHERE event_type = 'signup' AND k % 25 = 0) + @GRACE@ AS x, max(ms) AS last_ms FROM e GROUP BY run_id),
d AS (SELECT *, CASE WHEN least(c, f) <= coalesce(x, least(c, f)) THEN least(c, f) ELSE x END AS decided_ms FROM r),
s AS (SELECT d.*, coalesce(decided_ms < watermark, false) AS final, CASE WHEN decided_ms IS NULL THEN 'alive' WHEN decided_ms = c THEN 'completed'
  WHEN decided_ms = f THEN 'failed' ELSE 'died' END AS st FROM d, w)
SELECT run_id, CASE WHEN st = 'died' AND NOT final THEN 'ending' ELSE st END AS status,
  CASE WHEN st = 'failed' THEN 'Training failed: ' || text WHEN st = 'died' AND final THEN 'Training process died without completion marker' END AS message,
  decided_ms, last_ms, final FROM s"""
     .replace("@CLOCK@", str(OUTCOME_CLOCK)).replace("@DELAY@", str(OUTCOME_DELAY_MS)).replace("@GRACE@", str(O.GRACE_MS)))
def training_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome of each run: some purchases are completion markers, some errors failure markers, some signups exits."""
    e = S.read_table_stream(spark, sf_dir, "events")
    k, et = F.get_json_object("props", "$.k").cast("bigint"), F.col("event_type")
    kind = (
        F.when((et == "purchase") & (k % 40 == 0), O.COMPLETE_MARKER)
        .when((et == "error") & (k % 30 == 0), O.FAILED_MARKER)
        .when((et == "signup") & (k % 25 == 0), "exit")
        .otherwise("alive")
    )
    rows = e.select(
        F.col("user_id").alias("run_id"), F.floor(epoch_ms("ts") / OUTCOME_CLOCK).alias("ms"), kind.alias("kind"),
        F.format_string("stopped with %d", F.col("event_id")).alias("text"),
    )
    return O.run_outcomes(O.training_outcomes(rows, f"{OUTCOME_DELAY_MS} milliseconds"))
