"""Streaming jobs against their batch twins on sf0.001."""

from __future__ import annotations

from pyspark.sql import functions as F

from finelens.operators import checks as C
from finelens.plans import streams as P
from finelens.sources.tables import Tables
from finelens.streaming import jobs as S

from .conftest import SF001


def test_stream_validate_equals_batch_profile(spark):
    got = {r["dataset"]: r for r in P.stream_validate(spark, SF001).collect()}
    prof = {r["dataset"]: r for r in C.text_profile(Tables(spark, SF001).text_samples, ["dataset"]).collect()}
    assert set(got) == set(prof)
    for k, p in prof.items():
        g = got[k]
        assert (g["sample_count"], g["total_length"], g["empty_count"], g["total_tokens"]) == (
            p["sample_count"], p["total_length"], p["empty_count"], p["total_tokens"])


def test_stream_dedup_equals_batch(spark):
    got = {r["dataset"]: r["unique_count"] for r in P.stream_dedup(spark, SF001).collect()}
    batch = {r["dataset"]: r["unique_count"] for r in C.dedup_stats(Tables(spark, SF001).text_samples, ["dataset"]).collect()}
    assert got == batch


def test_log_follow_delivers_every_line(spark):
    from finelens.plans.runs import log_lines

    got = {r["file"]: r["lines"] for r in P.log_follow(spark, SF001).collect()}
    batch = {r["file"]: r["count"] for r in log_lines(Tables(spark, SF001)).groupBy("file").count().collect()}
    assert got == batch


def test_resource_status_matches_batch_in_every_window(spark):
    got = P.resource_status(spark, SF001)
    ev = S.with_event_time(Tables(spark, SF001).events.select(F.col("user_id").alias("run_id"), "ts", "value"))
    batch = (
        ev.groupBy("run_id", F.window("event_time", "15 seconds").alias("w"))
        .agg(F.max_by("value", "event_time").alias("last_value"))
        .select("run_id", F.col("w.start").alias("window_start"), "last_value")
    )
    g = {(r["run_id"], r["window_start"]): r["last_value"] for r in got.collect()}
    b = {(r["run_id"], r["window_start"]): r["last_value"] for r in batch.collect()}
    assert g == b


def test_streams_read_a_folder_of_part_files(spark, tmp_path):
    Tables(spark, SF001).documents.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    Tables(spark, SF001).events.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    for job in (P.stream_min_samples, P.stream_dedup, P.resource_status, P.liveness):
        parts, one = job(spark, str(tmp_path)), job(spark, SF001)
        assert parts.count() > 0 and parts.exceptAll(one).isEmpty() and one.exceptAll(parts).isEmpty()


def test_restarted_stream_reads_only_what_is_new(spark, tmp_path):
    src, out = str(tmp_path / "logs"), str(tmp_path / "out")
    lines = lambda *x: spark.createDataFrame([(v,) for v in x], "value string")
    lines("a", "b").coalesce(1).write.text(src)
    follow = lambda: S.run_append(spark.readStream.text(src), "follow", out)
    assert sorted(r[0] for r in follow().collect()) == ["a", "b"]
    lines("c").coalesce(1).write.mode("append").text(src)
    lines("d", "e").coalesce(1).write.mode("append").text(src)  # a rotated file
    assert sorted(r[0] for r in follow().collect()) == ["a", "b", "c", "d", "e"]
    assert follow().count() == 5
    counted = str(tmp_path / "counted")
    n = lambda: S.run_complete(spark.readStream.text(src).groupBy("value").count(), "n", counted).collect()
    assert {r["count"] for r in n()} == {1}
    lines("a").coalesce(1).write.mode("append").text(src)
    assert {r["value"]: r["count"] for r in n()}["a"] == 2


def test_liveness_idle_seconds(spark):
    rows = P.liveness(spark, SF001).collect()
    assert min(r["idle_seconds"] for r in rows) == 0
    assert all(r["dead"] == (r["idle_seconds"] > 1200) for r in rows)
