"""Structured Streaming forms of the mergeable checks and the log / liveness
monitors.

Every stream is started with ``trigger(availableNow=True)``, keeps its
offsets and state in a checkpoint and writes to a file sink beside it; the
caller gets the sink back as a batch DataFrame.  The folder is an argument, so
a restarted query resumes where it stopped; without one, a fresh folder under
``spark.checkpoint.dir`` serves a single run.  Aggregations that are emitted whole use
``foreachBatch`` with one committed version a batch.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from finelens.functions.text import py_split, py_str, py_strip_length
from finelens.operators import checks as C
from finelens.operators import events as EV
from finelens.session import ensure_checkpoint_dir, table_path
from finelens.sources.commits import CommitLog

IDLE_TIMEOUT_SECONDS = 1200  # fixed value of the reference
STATUS_INTERVAL = "15 seconds"  # fixed value of the reference
STATUS_DELAY = "10 minutes"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/finelens/{name}-{uuid.uuid4().hex}"


def read_table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Stream the files of one driver table, a single file or a folder of part files."""
    path = table_path(sf_dir, name)
    schema = spark.read.parquet(path).schema
    # as a glob the path may be a file; it matches this one name
    return spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")


def run_complete(agg: DataFrame, name: str, out: str | None = None) -> DataFrame:
    """Run a streaming aggregation over all input present; return its whole result.

    ``out`` holds the checkpoint and the result: a later run with the same
    folder reads only what has arrived since.  Without it a fresh folder is used.
    Every batch is a version of its own, committed when it is whole: a reader sees the
    result before or after a batch, and a batch that breaks off leaves nothing.
    """
    spark = agg.sparkSession
    out = out or scratch(spark, name)
    log = CommitLog(spark, out + "/result")

    def sink(batch: DataFrame, epoch: int) -> None:
        done = log.numbers()
        if epoch in done:  # a batch that is run again after its commit
            return
        batch.write.mode("overwrite").parquet(log.version(epoch))
        log.commit(epoch)
        for old in done[:-1]:  # the version before this one stays for those who read it
            log.clear(log.version(old))

    q = (
        agg.writeStream.outputMode("complete").foreachBatch(sink)
        .option("checkpointLocation", out + "/_checkpoint").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    latest = log.latest()
    return spark.read.parquet(log.version(latest)) if latest is not None else spark.createDataFrame([], agg.schema)


def run_update(stream: DataFrame, keys: list[str], name: str, out: str | None = None) -> DataFrame:
    """Run an update-mode stream; return the latest row of each key.

    ``out`` as in ``run_complete``.  Batches leave the rows that they changed, each in a folder of
    its own, which a batch that is run again replaces.
    """
    spark = stream.sparkSession
    out = out or scratch(spark, name)

    def sink(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/changes/epoch={epoch}")

    q = (
        stream.writeStream.outputMode("update").foreachBatch(sink)
        .option("checkpointLocation", out + "/_checkpoint").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    got = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("epoch", T.LongType())])).parquet(out + "/changes")
    rest = [c for c in stream.columns if c not in keys]
    return got.groupBy(*keys).agg(F.max_by(F.struct(*rest), "epoch").alias("_r")).select(*keys, *[f"_r.{c}" for c in rest])


def run_append(stream: DataFrame, name: str, out: str | None = None) -> DataFrame:
    """Run an append-mode stream into a parquet sink; return the sink contents.

    ``out`` holds the checkpoint and the data, as in ``run_complete``.
    """
    spark = stream.sparkSession
    out = out or scratch(spark, name)
    q = (
        stream.writeStream.outputMode("append").format("parquet").option("path", out + "/data")
        .option("checkpointLocation", out + "/_checkpoint").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return spark.read.parquet(out + "/data")


# ---------------------------------------------------------------------------
# dataset checks on streams (mergeable metrics only)
# ---------------------------------------------------------------------------
def stream_text_metrics(samples: DataFrame, by: list[str], text: Column | None = None) -> DataFrame:
    """Running count, total length, short rows and tokens per dataset."""
    txt = text if text is not None else py_str("text")
    rows = samples.select(*by, txt.alias("_t")).select(
        *by,
        F.length("_t").alias("_len"),
        (py_strip_length("_t") < C.EMPTY_MIN_CHARS).cast("int").alias("_short"),
        F.size(py_split(F.lower("_t"))).alias("_tok"),
    )
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).cast("bigint").alias("sample_count"),
        F.sum("_len").cast("bigint").alias("total_length"),
        F.sum("_short").cast("bigint").alias("empty_count"),
        F.sum("_tok").cast("bigint").alias("total_tokens"),
    )


def verdict_of_stream_metrics(m: DataFrame, th: C.TextThresholds | None = None) -> DataFrame:
    th = th or C.TextThresholds.defaults()
    n = F.col("sample_count")
    avg = F.when(n > 0, F.col("total_length") / n).otherwise(F.lit(0.0))
    er = C.safe_ratio(F.col("empty_count"), n)
    return m.select(
        "*",
        (n >= th.min_samples).alias("min_samples_passed"),
        avg.alias("avg_length"),
        avg.between(th.avg_min, th.avg_max).alias("avg_length_passed"),
        er.alias("empty_ratio"),
        (er <= th.empty_max_ratio).alias("empty_ratio_passed"),
    )


def stream_dedup(samples: DataFrame, by: list[str]) -> DataFrame:
    """One row of each text per dataset: the first to arrive, which is any of those that arrive in one batch.

    The state keeps every hash (exact, like the batch check).
    """
    h = samples.select(*by, "row_idx", F.md5(py_str("text")).alias("text_md5"))
    return h.dropDuplicates([*by, "text_md5"])


# ---------------------------------------------------------------------------
# events / logs
# ---------------------------------------------------------------------------
def with_event_time(events: DataFrame, col: str = "ts") -> DataFrame:
    """``withWatermark`` needs TIMESTAMP; the driver tables hold TIMESTAMP_NTZ."""
    return events.withColumn("event_time", F.col(col).cast("timestamp"))


def resource_status(events: DataFrame, run: str = "run_id", value: str = "value", delay: str = STATUS_DELAY) -> DataFrame:
    """Last value of each run in every 15-second window (one status line per interval).

    Of values at one instant the largest counts.  Windows are reported as they change, the newest
    too; an event that comes more than ``delay`` behind the newest one seen in an
    earlier batch no longer reaches its window, and a window's state is dropped by then.
    """
    g = events.withWatermark("event_time", delay).groupBy(run, F.window("event_time", STATUS_INTERVAL).alias("w")).agg(
        F.max(F.struct("event_time", value))[value].alias("last_value"), F.count(F.lit(1)).cast("bigint").alias("samples")
    )
    return g.select(run, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "last_value", "samples")


def last_seen(events: DataFrame, run: str = "run_id") -> DataFrame:
    return events.groupBy(run).agg(F.max("event_time").alias("last_event_time"))


def liveness(last: DataFrame, as_of: Column, idle_timeout: int = IDLE_TIMEOUT_SECONDS) -> DataFrame:
    idle = F.unix_timestamp(as_of) - F.unix_timestamp("last_event_time")
    return last.select("*", idle.cast("bigint").alias("idle_seconds"), (idle > idle_timeout).alias("dead"))


def typed_events(raw: DataFrame) -> DataFrame:
    """Append severity text / number and the error flag to ingested events."""
    return raw.select("*", *EV.severity_cols(F.col("event_type")), (F.col("event_type") == "error").alias("is_error"))
