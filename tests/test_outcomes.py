"""Outcomes of training runs from streams that arrive in pieces and out of order."""

from __future__ import annotations

import pytest

from finelens.streaming import outcomes as O

GRACE = O.GRACE_MS


@pytest.mark.parametrize(
    "complete,failed,text,gone,want",
    [
        (None, None, None, None, ("alive", None, None)),
        (5, None, None, None, ("completed", None, 5)),
        (None, 5, "oom", None, ("failed", "Training failed: oom", 5)),
        (5, 5, "oom", None, ("completed", None, 5)),  # both at once: complete is looked at first
        (9, 5, None, None, ("failed", "Training failed: ", 5)),
        (None, None, None, 100, ("died", O.DIED_TEXT, 100 + GRACE)),
        (100 + GRACE, None, None, 100, ("completed", None, 100 + GRACE)),  # just within grace
        (101 + GRACE, None, None, 100, ("died", O.DIED_TEXT, 100 + GRACE)),
        (50, None, None, 100, ("completed", None, 50)),
    ],
)
def test_decision(complete, failed, text, gone, want):
    assert O.decision(complete, failed, text, gone, GRACE) == want


def put(spark, folder, n, rows):
    df = spark.createDataFrame(rows, "run_id long, ms long, kind string, text string").coalesce(1)
    df.write.mode("append").json(f"{folder}/part={n}")


def run(spark, folder, out, **options):
    stream = spark.readStream.schema("run_id long, ms long, kind string, text string").json(f"{folder}/*")
    rows = O.run_outcomes(O.training_outcomes(stream, "10 seconds", **options), out).collect()
    return {r["run_id"]: (r["status"], r["final"]) for r in rows}


S = 1000


def test_outcomes_over_several_runs_of_the_stream(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    put(spark, folder, 0, [
        (1, 10 * S, "beat", None), (1, 50 * S, "exit", None),  # gone, its marker comes later
        (2, 20 * S, "exit", None),  # gone for good
        (3, 30 * S, O.FAILED_MARKER, "b"), (3, 30 * S, O.FAILED_MARKER, "a"), (3, 31 * S, O.COMPLETE_MARKER, None),
        (4, 60 * S, "beat", None), (None, 1, "beat", None), (5, None, "exit", None),
    ])
    got = run(spark, folder, out)
    # the watermark is at 50 s: 2 is decided at 37 s and 3 at 30 s, 1 has grace until 67 s
    assert got == {1: ("ending", False), 2: ("died", True), 3: ("failed", True), 4: ("alive", False)}
    # out of order: a marker from within the grace period, and one after it for a run that is decided
    put(spark, folder, 1, [(4, 65 * S, "beat", None), (1, 55 * S, O.COMPLETE_MARKER, None), (2, 64 * S, O.COMPLETE_MARKER, None)])
    got = run(spark, folder, out)
    assert got == {1: ("completed", False), 2: ("died", True), 3: ("failed", True), 4: ("alive", False)}
    put(spark, folder, 2, [(4, 90 * S, "beat", None)])
    assert run(spark, folder, out)[1] == ("completed", True)  # only the watermark has moved: the timer


def test_texts_ties_and_hot_runs(spark, tmp_path):
    folder = str(tmp_path / "in")
    rows = [(7, i, "beat", None) for i in range(5000)] + [(7, 4000, O.FAILED_MARKER, t) for t in ("z", "m", None)]
    put(spark, folder, 0, rows + [(8, 4000, O.FAILED_MARKER, "q")])
    stream = spark.readStream.schema("run_id long, ms long, kind string, text string").json(f"{folder}/*")
    got = {r["run_id"]: r for r in O.run_outcomes(O.training_outcomes(stream), str(tmp_path / "out")).collect()}
    assert got[7]["last_ms"] == 4999 and got[7]["status"] == "failed" and got[8]["message"] == "Training failed: q"


def test_decided_runs_are_forgotten(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    put(spark, folder, 0, [(1, 10 * S, O.COMPLETE_MARKER, None), (2, 60 * S, "beat", None)])
    assert run(spark, folder, out, forget_ms=20 * S)[1] == ("completed", True)
    put(spark, folder, 1, [(2, 200 * S, "beat", None)])
    run(spark, folder, out, forget_ms=20 * S)
    put(spark, folder, 2, [(1, 195 * S, "beat", None)])  # its state is gone: the run is seen anew
    assert run(spark, folder, out, forget_ms=20 * S)[1] == ("alive", False)


def test_combining_keeps_what_decides(spark):
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({
        "run_id": pa.array([1, 1, 1, 2], pa.int64()), "ms": pa.array([5, 3, 9, 4], pa.int64()),
        "kind": ["exit", O.COMPLETE_MARKER, "exit", None], "text": pa.array([None, "x", "y", None], pa.string()),
    })
    (out,) = O.combined(iter([batch]))
    rows = {r["run_id"]: r for r in out.to_pylist()}
    assert (rows[1]["complete_ms"], rows[1]["exit_ms"], rows[1]["failed_ms"], rows[1]["event_time"].timestamp()) == (3, 5, None, 0.009)
    assert rows[2]["complete_ms"] is None and rows[2]["failed_text"] is None
