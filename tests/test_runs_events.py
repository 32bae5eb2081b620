"""Run catalogs, phase slices and memory health on cases the driver tables do not hold."""

from __future__ import annotations

from pyspark.sql import functions as F

from finelens.operators import checks as C
from finelens.operators import evaluate as EV
from finelens.operators import events as E
from finelens.operators import metrics as M
from finelens.operators import records
from finelens.operators import runs as R


def test_resume_stage_keeps_runs_with_equal_attempt_numbers_apart(spark):
    att = spark.createDataFrame(
        [("A", 1, ["s1", "s2"]), ("B", 1, ["s1", "s2"]), ("C", 1, ["s1"]), ("C", 2, ["s1", "s3"])],
        "run_id string, attempt_no int, enabled_stages array<string>",
    )
    runs = spark.createDataFrame(
        [("A", 1, "s1", "completed"), ("A", 1, "s2", "completed"), ("B", 1, "s1", "failed"), ("C", 1, "s1", "failed"), ("C", 2, "s1", "completed")],
        "run_id string, attempt_no int, stage_name string, status string",
    )
    got = {r["run_id"]: r["resume_stage"] for r in R.resume_stage(att, runs).collect()}
    assert got == {"A": None, "B": "s1", "C": "s3"}


def test_lineage_ties_have_one_answer(spark):
    upd = [("r", "s", "set", "x", 5), ("r", "s", "set", "y", 5), ("r", "t", "remove", "x", 2), ("r", "t", "set", "z", 1)]
    df = spark.createDataFrame(upd, "run_id string, stage_name string, action string, output string, seq long")
    for parts in (1, 2, 4):
        got = [(r["stage_name"], r["output"]) for r in R.latest_lineage(df.repartition(parts)).collect()]
        assert got == [("s", "y")]


def test_descendants_follow_the_asked_depth_and_stop_on_cycles(spark):
    runs = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "c"), ("e", "d"), ("x", "y"), ("y", "x"), ("a", None)], "run_id string, parent_run_id string")
    root = spark.createDataFrame([("a",), ("x",)], "run_id string")
    got = sorted((r["root_run_id"], r["run_id"], r["depth"]) for r in R.descendants(runs, root, 9).collect())
    assert got == [("a", "b", 1), ("a", "c", 2), ("a", "d", 3), ("a", "e", 4), ("x", "y", 1)]
    assert R.descendants(runs, root, 2).where("root_run_id = 'a'").count() == 2


def test_open_phase_keeps_its_points(spark):
    pts = spark.createDataFrame([("r", "k", i, 1000 * i, float(i), i) for i in range(5)], "run_id string, key string, step long, ts_ms long, value double, seq long")
    ph = spark.createDataFrame([("r", 0, 1000, None), ("r", 1, None, 9000)], "run_id string, phase_idx long, start_ms long, end_ms long")
    at = lambda **k: sorted(r["ts_ms"] for r in M.slice_by_phase(pts, ph, **k).collect())
    assert at(as_of_ms=3000) == [1000, 2000, 3000]
    assert at() == [1000, 2000, 3000, 4000]  # until now
    assert M.phase_resource_fill(pts, ph, as_of_ms=2500).count() == 2


def test_a_run_with_oom_loses_the_configuration_penalty(spark):
    ev = [("r", "oom", "OOM at step 1"), ("s", "cache_clear", "x")]
    df = spark.createDataFrame(ev, "run_id string, memory_event_type string, message string")
    health = E.memory_health(df, ["run_id"])
    got = {r["run_id"]: (r["efficiency_score"], r["status"], r["verdict"]) for r in health.collect()}
    assert got == {"r": (65, "WARNING", "OOM (recovered)"), "s": (100, "GOOD", "Healthy")}
    lines = [r["message"] for r in E.memory_insights(health, ["run_id"]).orderBy("pos").collect()]
    assert len(lines) == 2 and lines[-1] == "Configuration led to OOM events."


def test_score_labels(spark):
    df = spark.createDataFrame([(None, 3), (0.5, 3), (1.0, None), (0.99, None)], "score double, raw int")
    got = [r[0] for r in df.select(EV.score_label(F.col("score"), F.col("raw"))).collect()]
    assert got == ["FAILED", "raw: 3/5", "OK", "FAILED"]


def test_error_groups_without_bound_is_the_long_table(spark):
    df = spark.createDataFrame([("d", "e", i) for i in range(12)] + [("d", "f", 1)], "dataset string, error_type string, row_idx long")
    got = C.error_groups(df, ["dataset"], max_examples=-1)
    assert got.count() == 13 and got.where("error_type = 'e'").select("total_count").distinct().collect()[0][0] == 12


def test_gpu_tier_by_name_then_by_memory(spark):
    from finelens.operators import memory as MEM

    cards = [("NVIDIA H100", 1), ("GeForce RTX 3060 Ti", 99999), ("RTX 3060", 99999), ("GeForce RTX 4070 Ti", 1), ("?", 40960), ("?", 24576), ("?", 12288), ("?", 8192), ("?", 8191)]
    df = spark.createDataFrame([(*c, 0.9 * c[1]) for c in cards], "gpu_name string, total_mb int, used_mb double")
    got = {(r["gpu_name"], r["total_mb"]): (r["tier"], r["level"]) for r in MEM.memory_levels(df).collect()}
    tiers = [got[c][0] for c in cards]
    assert tiers == ["datacenter", "consumer_low", "minimal", "consumer_mid", "datacenter", "consumer_high", "consumer_mid", "consumer_low", "minimal"]
    assert got["RTX 3060", 99999][1] == "warning"


def test_broken_documents_keep_their_place(spark):
    from finelens.operators import records as REC

    state = '{"schema_version": 1, "logical_run_id": "a", "pipeline_status": "completed", "attempts": 2}'
    docs = [("a", state), ("b", state[:20]), ("c", state.replace("1,", "7,", 1)), ("d", '{"schema_version": 1}'), ("e", None), ("f", "[1]")]
    df = spark.createDataFrame(docs, "run_id string, doc string")
    got = {r["run_id"]: (r["status"], r["attempts"], r["error"] is None) for r in REC.run_states(df).collect()}
    assert got["a"] == ("completed", 2, True)
    assert all(got[k] == ("unknown", 0, False) for k in "bcdef")
    events = spark.createDataFrame([("x", '{"events": [{"seq": 1, "event_type": "info", "value": 2.5}]}'), ("y", '{"events": [{"se'), ("z", "{}")], "run_id string, doc string")
    assert [(r["run_id"], r["seq"], r["value"]) for r in REC.events_of(events).collect()] == [("x", 1, 2.5)]
    env = spark.createDataFrame([("r", "s1", '{"stage": "s1", "status": "failed", "duration_seconds": 3}'), ("r", "s2", "{"), ("r", "s3", "{")], "run_id string, stage_name string, doc string")
    row = REC.stage_envelopes(env).collect()[0]
    assert (row["stages"], row["failed"], row["total_seconds"], row["missing_artifacts"]) == (1, 1, 3.0, "s2,s3")


def test_strategy_chains(spark):
    from finelens.operators import records as REC

    chains = {
        1: [("sft", "a", False), ("dpo", "b", False)], 2: [("cot", "a", False), ("cpt", "b", False)], 3: [("cpt", None, False), ("sft", "default", False)],
        4: [("sft", "a", False), ("dpo", "a", True)], 5: [("sft", "a", False), (None, "a", False)],
    }
    rows = [(c, i, *p) for c, ps in chains.items() for i, p in enumerate(ps)]
    df = spark.createDataFrame(rows, "chain int, pos int, strategy string, dataset string, cached boolean")
    got = {r["chain"]: tuple(r)[1:] for r in REC.strategy_chain_check(df).collect()}
    assert got[1] == (2, False, 0, None, None)
    assert got[2] == (2, True, 1, None, None)
    assert got[3] == (2, False, 0, REC.CHAIN_DUPLICATE, "default")
    assert got[4] == (2, False, 0, None, None)
    assert got[5] == (2, False, 0, REC.CHAIN_NONE, None)


def test_envelopes_carry_one_text(spark):
    kinds = "run_id long, seq int, stage string, status string, started_at string, duration_seconds double, error string, data map<string,string>"
    rows = [
        (1, 2, "a", "passed", "t2", 1.0, "x", {"k": "late"}),
        (1, 1, "a", "failed", 't"1\n', 1.0005, "é\\ \x01", {"k": None, 'q"': "v"}),
        (1, 1, "a", "failed", 't"1\n', 1.0005, "é\\ \x01", {"k": None, 'q"': "w"}),
        (1, 1, "b", "skipped", None, 5.0, "x", {"k": "v"}),
        (2, 1, "a", "passed", None, float("nan"), "x", None),
        (None, None, None, None, None, None, None, None),
    ]
    out = records.envelopes(spark.createDataFrame(rows, kinds))
    # the envelope and its text were both dealt out
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "min_by" not in plan
    got = {(r["run_id"], r["stage"]): r["envelope"].asDict() for r in out.collect()}
    assert got[1, "a"] == {"stage": "a", "status": "failed", "started_at": 't"1\n', "duration_seconds": 1.0, "error": "é\\ \x01", "data": {"k": None, 'q"': "v"}}
    assert got[1, "b"] == {"stage": "b", "status": "skipped", "started_at": None, "duration_seconds": 0.0, "error": None, "data": {}}
    assert got[2, "a"]["data"] == {} and got[2, "a"]["duration_seconds"] != got[2, "a"]["duration_seconds"]
    assert got[None, None] == {"stage": None, "status": None, "started_at": None, "duration_seconds": None, "error": None, "data": {}} and len(got) == 4
