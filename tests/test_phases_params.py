"""Phases, parameters, restarts, fingerprints, probes and outcomes on small cases."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from finelens.operators import events as EV
from finelens.operators import fingerprints as FP
from finelens.operators import params as P
from finelens.operators import phases as PH
from finelens.operators import probes as PR
from finelens.operators import reports as RP
from finelens.operators import restarts as RS
from finelens.operators.ordering import with_position
from finelens.sources.report_store import ReportStore

EVENT = "run_id long, seq long, source string, event_type string, timestamp string, attributes map<string,string>"


def test_positions_inside_groups_of_any_size(spark):
    rows = [(i % 3 if i % 2 else None, i * 7 % 101) for i in range(101)]
    got = with_position(spark.createDataFrame(rows, "g long, v long").repartition(5), ["g"], [F.col("v")], "pos").collect()
    for g in (None, 0, 1, 2):
        own = sorted((r["v"], r["pos"]) for r in got if r["g"] == g)
        assert [p for _, p in own] == list(range(len(own)))


def test_phases_from_events_in_any_order(spark):
    rows = [
        (1, 1, "PhaseExecutor", "start", "2024-01-01T00:00:00Z", {"phase_idx": "0", "strategy_type": "sft"}),
        (1, 2, "PhaseExecutor", "Complete", "2024-01-01T00:00:30Z", {"phase_idx": " 0 ", "train_loss": "0.5", "epoch": "x"}),
        (1, 3, "DataBuffer", "complete", "2024-01-01T09:00:00Z", {"phase_idx": "0", "train_loss": "9"}),  # not the executor's
        (1, 4, "PhaseExecutor:x", "complete", "bad", {"phase_idx": "0", "train_loss": "nope", "epoch": "2"}),  # keeps what is known
        (1, 5, "PhaseExecutor", "complete", "2024-01-01T00:10:00Z", {"phase_idx": "1", "train_runtime": "0", "strategy": "dpo"}),  # no start
        (1, 6, "PhaseExecutor", "start", "2024-01-01T00:20:00+01:00", {"phase_idx": "2"}),
        (1, 7, "PhaseExecutor", "complete", "2024-01-01T00:10:00+02:00", {"phase_idx": "2"}),  # ends before it starts
        (1, 8, "PhaseExecutor", "start", None, {"phase_idx": "1.5"}),
        (1, 9, "PhaseExecutor", "start", None, {}),
        (2, 1, "PhaseExecutor", "start", "2024-01-01", {"phase_idx": "-1", "strategy_type": ""}),
    ]
    params = spark.createDataFrame(
        [(1, {"config.strategy.2.type": "cpt", "learning_rate": "0.1", "batch_size": "", "training.hyperparams.per_device_train_batch_size": "8"})],
        "run_id long, params map<string,string>",
    )
    random.Random(1).shuffle(rows)
    got = {(r["run_id"], r["phase_idx"]): r for r in PH.phases_from_events(spark.createDataFrame(rows, EVENT).repartition(4), params).collect()}
    assert set(got) == {(1, 0), (1, 1), (1, 2), (2, -1)}
    a, b, c, d = (got[k] for k in sorted(got))
    assert (a["name"], a["strategy"], a["duration_seconds"], a["train_loss"], a["epoch"], a["batch_size"]) == ("phase_0_sft", "SFT", 30.0, 0.5, 2.0, 8)
    assert (b["strategy"], b["duration_seconds"], b["start_ms"], b["learning_rate"]) == ("DPO", 0.0, None, 0.1)
    assert (c["name"], c["duration_seconds"]) == ("phase_2_cpt", 0.0) and c["end_ms"] < c["start_ms"]
    assert (d["strategy"], d["start_ms"], d["learning_rate"], d["batch_size"]) == ("UNKNOWN", 1704067200000, None, None)


def test_flatten_phases_rules(spark):
    rows = [  # id, parent, name, start, metrics, params
        ("r", None, "root", 0, False, False),
        ("b", "r", "box", 5, False, False), ("b1", "b", "phase_a", 7, True, False), ("b2", "b", "other", 6, True, True),
        ("b3", "b", "phase_b", 6, False, False),  # counts, but has nothing
        ("c", "r", "box", 1, True, True), ("c2", "c", "y", 3, False, True), ("c1", "c", "x", 2, True, False),  # no phase: all
        ("l", "r", "leaf", 9, False, True), ("m", "r", "leaf", 8, False, False),
    ]
    runs = spark.createDataFrame(rows, "run_id string, parent_run_id string, run_name string, start_ms long, has_metrics boolean, has_params boolean")
    got = PH.flatten_phases(runs, runs.where("run_id = 'r'").select("run_id")).orderBy("phase_idx").collect()
    assert [(r["phase_idx"], r["run_id"], r["container_id"]) for r in got] == [(0, "c1", "c"), (1, "c2", "c"), (3, "b1", "b"), (5, "l", None)]


def test_phase_table_and_summary(spark):
    rows = [
        (1, 1, "PhaseExecutor", "complete", None, {"phase_idx": "0", "strategy_type": "cpt", "train_loss": "0", "loss": "2", "epoch": "1.6", "global_step": "10", "train_samples_per_second": "0"}),
        (1, 2, "PhaseExecutor", "complete", None, {"phase_idx": "2", "strategy_type": "sft", "train_loss": "0.25", "epoch": "1.6", "train_runtime": "59.96", "train_samples_per_second": "4"}),
    ]
    series = [(1, 0, "train_loss", 1, 4.0), (1, 0, "train_loss", 2, 2.0), (1, 2, "loss", 1, 1.0), (1, 2, "train_loss", 1, 9.0),
              (1, 2, "system/cpu_utilization_percentage", 1, 10.0), (1, 2, "system/cpu_utilization_percentage", 2, 30.0)]
    table = PH.phase_table(PH.phases_from_events(spark.createDataFrame(rows, EVENT)), spark.createDataFrame(series, "run_id long, phase_idx long, key string, seq long, value double"))
    a, b = table.orderBy("phase_idx").collect()
    assert (a["final_loss"], a["loss_direction"], a["loss_change_pct"], a["steps"], a["cpu_utilization"]) == (2.0, "decreased", -50.0, 10, None)
    assert (b["final_loss"], b["loss_first"], b["loss_direction"], b["steps"], b["cpu_utilization"]) == (0.25, 1.0, "stable", 0, 20.0)
    s = PH.run_summary(table).first()
    assert (s["total_epochs"], s["total_steps"], s["samples_per_second"], s["final_loss"], s["strategy_chain"]) == (3, 10, 4.0, 0.25, ["CPT", "SFT"])
    lines = {r["phase_idx"]: r for r in PH.phase_lines(table).collect()}
    assert (lines[0]["step_loss"], lines[0]["time"], lines[2]["time"]) == ("4.0000 → 2.0000", "—", "60.0s")


def parsed(x):
    """What the reference's rule makes of a text, by Python itself."""
    if x.lower() in ("true", "false"):
        return "bool", x.lower() == "true"
    for kind, make in (("int", int), ("float", float)):
        try:
            return kind, make(x)
        except ValueError:
            pass
    return "string", x


TEXTS = ["true", "FALSE", " true", "1", "+1_000", "-7", "1__0", "_1", "1_", " 12\n", "1.5", ".5", "5.", ".", "1e3", "1E-0_1", "1e", "nan", "-inf",
         "Infinity", "infinit", "0x10", "1d", "1.0f", "", " ", "none", "a,b", "1,2", "٣", "1 2", "--1"]


def test_parse_value_follows_python(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string").select("t", P.parse_value(F.col("t")).alias("v"))
    for r in df.collect():
        kind, value = parsed(r["t"])
        if r["t"] == "٣":  # digits of other scripts are texts here
            kind, value = "string", r["t"]
        v = r["v"]
        got = {"bool": v["bool_value"], "int": v["int_value"], "float": v["float_value"], "string": v["text_value"]}[kind]
        assert v["kind"] == kind and (got == value or got != got and value != value), r["t"]


def test_convert_param(spark):
    cases = ["None", " 3 ", "1e5", "1.e1", "sft, 2.5,NONE , true", "a", "1.5,x.y"]
    got = {r["t"]: r["c"] for r in spark.createDataFrame([(t,) for t in cases], "t string").select("t", P.convert_param(F.col("t")).alias("c")).collect()}
    assert [got[t]["value"]["kind"] for t in cases] == ["null", "int", "string", "float", "list", "string", "list"]
    assert [i["kind"] for i in got["sft, 2.5,NONE , true"]["items"]] == ["string", "float", "null", "bool"]
    assert [i["text_value"] for i in got["1.5,x.y"]["items"]] == [None, "x.y"] and got["a"]["items"] is None


def test_normalize_params_precedence(spark):
    maps = [{"lr": "1", "learning_rate": "2", "training.hyperparams.learning_rate": "3", "grad_accum": "9", "x": "y", "z": None}, {"grad_accum": "9", "gradient_accumulation_steps": "2"}, {}]
    got = P.normalize_params(spark.createDataFrame(list(enumerate(maps)), "run_id long, params map<string,string>")).collect()
    rows = {(r["run_id"], r["name"], r["source_key"], r["value"]["int_value"]) for r in got}
    # canonical names take the first alternate; originals stay, but for those under a canonical name
    assert rows == {
        (0, "learning_rate", "training.hyperparams.learning_rate", 3), (0, "lr", "lr", 1), (0, "training.hyperparams.learning_rate", "training.hyperparams.learning_rate", 3),
        (0, "grad_accum", "grad_accum", 9), (0, "x", "x", None), (1, "grad_accum", "gradient_accumulation_steps", 2), (1, "gradient_accumulation_steps", "gradient_accumulation_steps", 2),
    }


def test_merge_params_skips_what_is_not_given(spark):
    rows = [(1, 0, "phase", True, {"batch_size": "0", "optim": "", "epochs": "3"}), (1, 1, "root", False, {"batch_size": "0", "optimizer": "adam"}), (1, 2, "source", True, {"num_epochs": "5", "fp16": "false"})]
    got = P.merge_params(spark.createDataFrame(rows, "run_id long, precedence int, source string, typed boolean, params map<string,string>")).collect()
    # a root text "0" is a text, a typed 0 is not given; num_epochs of any source comes before epochs
    assert {(r["field"], r["key"], r["source"], r["raw"]) for r in got} == {("batch_size", "batch_size", "root", "0"), ("optimizer", "optimizer", "root", "adam"), ("num_epochs", "num_epochs", "source", "5")}


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_param_texts_are_matched_once_a_row(spark):
    # patterns were repeated for every output of the value, and tried on keys that no field takes
    runs = spark.createDataFrame([(1, {"lr": "1"})], "run_id long, params map<string,string>").select("run_id", F.map_concat("params").alias("params"))
    plan = plan_of(P.normalize_params(runs).select("run_id", "value.*"))
    assert plan.count("RLIKE") <= 3 * 6 and "size(map_concat" not in plan  # three branches: chosen, others, canonical names without alternates
    sources = runs.selectExpr("run_id", "0 AS precedence", "'phase' AS source", "true AS typed", "params")
    plan = plan_of(P.merge_params(sources))
    assert plan.count("RLIKE") <= 2 and plan.count("INSET") + plan.count(" IN (") >= 1 and "size(map_concat" not in plan


def test_normalize_params_repeated_and_null_runs(spark):
    maps = [(1, {"scheduler": "a"}), (1, {"scheduler": "a"}), (1, {"x": "1"}), (2, {"scheduler": "b"}), (2, {"lr_scheduler_type": "c"}), (None, {"scheduler": "d", "batch_size": "4"}), (None, {"lr_scheduler_type": "e"}), (3, None)]
    got = P.normalize_params(spark.createDataFrame(maps, "run_id long, params map<string,string>")).collect()
    assert sorted(((r["run_id"] or 0, r["name"], r["source_key"], r["raw"]) for r in got)) == [
        (0, "batch_size", "batch_size", "4"), (0, "batch_size", "batch_size", "4"), (0, "lr_scheduler_type", "lr_scheduler_type", "e"), (0, "scheduler", "lr_scheduler_type", "e"), (0, "scheduler", "scheduler", "d"),
        (1, "scheduler", "scheduler", "a"), (1, "scheduler", "scheduler", "a"), (1, "x", "x", "1"), (2, "lr_scheduler_type", "lr_scheduler_type", "c"), (2, "scheduler", "lr_scheduler_type", "c"),
    ]


@pytest.mark.parametrize("text,given", [("0", False), ("-0_0", False), (" 0.0 ", False), ("0e5", False), ("1e-400", False), ("false", False), ("", False), (None, False), (" ", True), ("false ", True), ("0x", True), ("nan", True), ("-inf", True), ("99999999999999999999", True), ("0.1", True), ("1__0", True)])
def test_truthy_text(spark, text, given):
    assert spark.createDataFrame([(text,)], "t string").select(P.truthy(F.col("t"))).first()[0] is given


FULL = {"ssh_host": "h", "ssh_port": "22", "workspace_path": "/w"}


@pytest.mark.parametrize(
    "lineage,state,now,want",
    [
        ({}, ("m", "t", "l"), ("m", "t", "l"), {"Dataset Validator": "restart_allowed", "Training Monitor": "missing_gpu_deployer_outputs", "Model Retriever": "missing_gpu_deployer_outputs", "Inference Deployer": "missing_model_retriever_outputs", "Model Evaluator": "missing_inference_outputs"}),
        ({"GPU Deployer": FULL, "Model Retriever": {"local_model_path": "/m"}, "Inference Deployer": {}}, ("m", "t", "l"), ("m", "other", "l"), dict.fromkeys(RS.STAGES, "restart_allowed")),
        ({"GPU Deployer": {**FULL, "ssh_port": ""}}, ("m", "t", "l"), ("m", "t", "l"), {"Training Monitor": "missing_gpu_deployer_outputs", "Model Retriever": "restart_allowed"}),
        ({"GPU Deployer": FULL}, ("m", "t", "l"), ("x", "t", "y"), {"GPU Deployer": "late_stage_config_changed", "Model Evaluator": "training_critical_config_changed"}),
        ({}, (None, "t", "l"), ("m", "x", "l"), dict.fromkeys(RS.STAGES, "training_critical_config_changed")),
    ],
)
def test_restart_rules(spark, lineage, state, now, want):
    hashes = "run_id long, model_dataset_hash string, training_hash string, late_hash string"
    lin = spark.createDataFrame([(1, s, o) for s, o in lineage.items()], "run_id long, stage_name string, outputs map<string,string>")
    rows = RS.restart_points(spark.createDataFrame([(1, *state)], hashes), lin, spark.createDataFrame([(1, *now)], hashes)).collect()
    got = {r["stage"]: r["reason"] for r in rows}
    assert len(got) == 6 and {s: got[s] for s in want} == want
    assert all(r["available"] == (r["reason"] == "restart_allowed") for r in rows)


def test_fingerprints_follow_the_content_only(spark):
    rows = [("a", i % 50, None if i % 7 == 0 else f"t{i}") for i in range(300)]
    state = lambda r, parts: FP.fingerprint_state(spark.createDataFrame(r, "ds string, k long, t string").repartition(parts), "ds", ["k", "t"])
    print_ = lambda s: s.select(FP.fingerprint().alias("f")).first()["f"]
    base = print_(state(rows, 1))
    assert len(base) == 10 and print_(state(rows[::-1], 7)) == base
    parts = state(rows[:120], 2).unionByName(state(rows[120:], 3))
    assert print_(FP.merged_states(parts, "ds")) == base
    changed = [rows[:-1], [*rows, rows[0]], [*rows, rows[0], rows[0]], [("a", 1, "x"), *rows[1:]], [("a", 0, ""), *rows[1:]]]
    assert len({base, *[print_(state(r, 3)) for r in changed]}) == 6
    # values that would run together as one text
    assert print_(state([("a", 1, "2,3")], 1)) != print_(state([("a", 12, "3")], 1))


def test_probe_texts(spark):
    gpu = {"45, 8192, 16384, 61\n": (45.0, 50.0), "1, 2, 0, 3": (1.0, 0.0), "": (0.0, 0.0), "1,2,3": (0.0, 0.0), "[N/A], 1024, 2048, x": (0.0, 50.0)}
    df = spark.createDataFrame([(t,) for t in gpu], "t string").select("t", PR.parse_gpu_csv(F.col("t")).alias("g"))
    assert {r["t"]: (r["g"]["gpu_util"], r["g"]["vram_pct"]) for r in df.collect()} == gpu
    g = 1 << 30
    cgroup = {
        f"memory.max={4 * g}\nmemory.current={g}": (4.0, 1.0),
        f"{4 * g}\n memory.max = {4 * g} \nmemory.current={9 * g}": (4.0, 4.0),
        f"memory.max=max\nmemory.current=5\nmemory.limit_in_bytes={2 * g}\nmemory.usage_in_bytes={g}": (2.0, 1.0),
        f"memory.max={1 << 60}\nmemory.current=5": None,
        "memory.limit_in_bytes=9223372036854771712\nmemory.usage_in_bytes=5": None,
        f"memory.max={4 * g}": None, "memory.max=0\nmemory.current=0": None, "": None,
        f"memory.max={g}\nmemory.current={g}\nmemory.max={2 * g}": (2.0, 1.0),
    }
    df = spark.createDataFrame([(t,) for t in cgroup], "t string").select("t", PR.parse_cgroup(F.col("t")).alias("m"))
    assert {r["t"]: r["m"] and tuple(r["m"]) for r in df.collect()} == cgroup
    m = 1 << 20
    meminfo = {
        f"MemTotal:  {8 * m} kB\nMemFree: {m} kB\nMemAvailable: {2 * m} kB": (8.0, 6.0), f"MemTotal: {8 * m} kB\nMemFree: {m} kB": (8.0, 7.0),
        f"MemTotal: {8 * m}": (8.0, 8.0), "MemFree: 1 kB": None, "MemTotal: 12x kB": None, "": None,
    }
    df = spark.createDataFrame([(t,) for t in meminfo], "t string").select("t", PR.parse_meminfo(F.col("t")).alias("m"))
    assert {r["t"]: r["m"] and tuple(r["m"]) for r in df.collect()} == meminfo


def test_gpu_facts_stop_at_the_first_complete_event(spark):
    rows = [
        (1, 1, {"gpu_name": "A", "vram_gb": "8"}), (1, 2, {"gpu_name": "B", "total_vram_gb": "0", "vram_gb": "16", "tier": "mid"}), (1, 3, {"gpu_name": "C", "vram_gb": "80", "gpu_tier": "top"}),
        (2, 1, {"gpu_name": "A", "vram_gb": "8.25"}), (2, 2, {"gpu_name": "B", "tier": "low"}), (2, 3, {"vram_gb": "99"}), (3, 1, {}),
    ]
    params = spark.createDataFrame([(3, {"mm.gpu_name": "P"}), (1, {"mm.gpu_name": "Q"})], "run_id long, params map<string,string>")
    got = PR.gpu_info(spark.createDataFrame(rows, "run_id long, seq long, attributes map<string,string>"), params).orderBy("run_id").collect()
    assert [tuple(r) for r in got] == [(1, "B", "16.0GB", 16.0, "mid"), (2, "B", "8.2GB", 8.25, "low"), (3, "P", None, None, None)]


def test_only_a_failed_stage_makes_a_run_red(spark):
    status = spark.createDataFrame([(1, "FINISHED"), (2, "FINISHED"), (3, "FINISHED")], "run_id long, status string")
    env = spark.createDataFrame([(1, "s", "failed", None), (2, "s", "interrupted", None), (2, "t", "passed", "x"), (3, "s", "skipped", None)], "run_id long, stage string, status string, error string")
    issues = EV.stage_issues(env)
    got = {r["run_id"]: (r["health"], r["explanation"]) for r in EV.run_health(status, issues, ["run_id"]).collect()}
    assert got == {1: ("RED", "1 ERROR issue(s)"), 2: ("GREEN", "No critical issues detected"), 3: ("GREEN", "No critical issues detected")}
    assert {r["message"] for r in issues.collect()} == {"Stage 's' failed", "Stage 's' was interrupted"}
    parts = EV.artifact_issues(spark.createDataFrame([(2, "a.json"), (2, EV.EVENTS_ARTIFACT)], "run_id long, artifact string"))
    checks = spark.createDataFrame([(2, "d", "b", 2, False, 3), (2, "d", "a", 1, False, 3), (2, "d", "c", 3, True, 3), (2, "e", "a", 1, False, 1)], "run_id long, dataset string, check_id string, priority int, passed boolean, critical int")
    data = EV.dataset_issues(EV.dataset_validation(checks))
    assert {r["message"] for r in data.collect()} == {
        "Dataset 'd': partial failure (2/3 plugins failed: a, b, below critical threshold of 3)", "Dataset 'e': 1 validation plugin(s) failed (a)"
    }
    ev = EV.evaluation_issues(spark.createDataFrame([(2, "j", False, []), (2, "k", None, ["x", "y"]), (2, "l", True, ["z"])], "run_id long, evaluator string, passed boolean, errors array<string>"))
    assert {r["message"] for r in ev.collect()} == {"Evaluation plugin 'j' failed: see metrics", "Evaluation plugin 'k' failed: x, y"}
    every = issues.unionByName(parts).unionByName(data).unionByName(ev)
    assert {r["run_id"]: r["health"] for r in EV.run_health(status, every, ["run_id"]).collect()} == {1: "RED", 2: "RED", 3: "GREEN"}


def test_datasets_and_plugins(spark):
    known = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "config_id long, dataset string")
    phases = spark.createDataFrame([(1, 1, "dpo", "a"), (1, 0, "sft", "a"), (1, 2, "cpt", "x"), (2, 0, "sft", None), (2, 1, "sft", "")], "config_id long, phase_idx long, strategy string, dataset string")
    got = {(r["config_id"], r["dataset"]): r["strategies"] for r in RP.datasets_to_phases(known, phases).collect()}
    assert got == {(1, "a"): ["sft", "dpo"], (2, "primary"): []}


def test_a_report_is_seen_whole(spark, tmp_path):
    store = ReportStore(spark, str(tmp_path / "reports"))
    table = lambda n: spark.range(n)
    with pytest.raises(FileNotFoundError):
        store.sections("r")
    bad = lambda: table(3).select(F.raise_error(F.lit("broken row")).alias("x"))
    assert store.write("r", {"a": lambda: table(3), "bad": bad, "b": lambda: table(5)}) == 0
    assert [(r["section"], r["status"]) for r in store.sections("r").orderBy("pos").collect()] == [("a", "ok"), ("bad", "failed"), ("b", "ok")]
    assert "broken row" in store.sections("r").where("section = 'bad'").first()["error"]
    held = store.read("r", "a")

    def lost():
        raise KeyboardInterrupt  # the writer goes away in the middle

    with pytest.raises(KeyboardInterrupt):
        store.write("r", {"a": lambda: table(9), "b": lost})
    assert store.read("r", "a").count() == 3 and store.read("r", "b").count() == 5
    assert store.write("r", {"a": lambda: table(7), "b": lambda: table(1)}) == 1
    assert store.read("r", "a").count() == 7 and held.count() == 3  # a reader that has begun goes on
    assert store.write("other", {"a": lambda: table(2)}) == 0 and store.read("r", "a").count() == 7
