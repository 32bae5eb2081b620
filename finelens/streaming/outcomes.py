"""Outcome of every training run from its stream of markers, exits and signs of life.

Keyed state with event-time timers (``applyInPandasWithState``).  A run's state
is four instants and a text, and what decides it is the earliest of

* a completion marker, or at the same instant rather than it a failure marker;
* the end of the grace period after its process was seen to be gone.

A decision is final once the watermark has passed that instant, for no event
before it can come any more, whatever the order in which events arrive; the
timer is set to it.  Until then the state is reported as it stands.  A decided
run is remembered for ``forget_ms`` so that later events do not revive it, and
then dropped: state is bounded by the runs of that time.

Before the state, each Arrow batch is combined to one row a run, so a run with
a third of all events sends a few rows to its task, not its events.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from finelens.streaming.jobs import run_update

# ---------------------------------------------------------------------------
# fixed values that must equal the reference
# ---------------------------------------------------------------------------
COMPLETE_MARKER, FAILED_MARKER = "TRAINING_COMPLETE", "TRAINING_FAILED"
GRACE_MS = 2_000 + 5 * 3_000  # a pause for the file system, then five looks at the markers
DIED_TEXT = "Training process died without completion marker"
FAILED_TEXT = "Training failed: "

#: How long a decided run is remembered.
FORGET_MS = 7 * 24 * 3600 * 1000

PART_SCHEMA = "run_id long, event_time timestamp, complete_ms long, failed_ms long, failed_text string, exit_ms long"
STATE_SCHEMA = "complete_ms long, failed_ms long, failed_text string, exit_ms long, last_ms long, done boolean"
OUT_SCHEMA = "run_id long, status string, message string, decided_ms long, last_ms long, final boolean"


def combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per Arrow batch one row a run: the first marker of each kind, the first exit, the latest event."""
    for batch in batches:
        t = pa.table({
            "run_id": batch["run_id"],
            "ms": batch["ms"],
            "complete_ms": pc.if_else(pc.fill_null(pc.equal(batch["kind"], COMPLETE_MARKER), False), batch["ms"], None),
            "failed_ms": pc.if_else(pc.fill_null(pc.equal(batch["kind"], FAILED_MARKER), False), batch["ms"], None),
            "exit_ms": pc.if_else(pc.fill_null(pc.equal(batch["kind"], "exit"), False), batch["ms"], None),
            "text": batch["text"],
        })
        g = t.group_by("run_id").aggregate([("ms", "max"), ("complete_ms", "min"), ("failed_ms", "min"), ("exit_ms", "min")])
        # the text of the earliest failure, the smallest of equals
        failed = t.filter(pc.is_valid(t["failed_ms"])).sort_by([("run_id", "ascending"), ("failed_ms", "ascending"), ("text", "ascending")])
        texts = dict(zip(reversed(failed["run_id"].to_pylist()), reversed(failed["text"].to_pylist())))
        runs = g["run_id"].to_pylist()
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(runs, pa.int64()),
                pc.cast(g["ms_max"].combine_chunks(), pa.timestamp("ms", "UTC")).cast(pa.timestamp("us", "UTC")),
                g["complete_ms_min"].combine_chunks(),
                g["failed_ms_min"].combine_chunks(),
                pa.array([texts.get(r) for r in runs], pa.string()),
                g["exit_ms_min"].combine_chunks(),
            ],
            names=["run_id", "event_time", "complete_ms", "failed_ms", "failed_text", "exit_ms"],
        )


def decision(complete: int | None, failed: int | None, text: str | None, gone: int | None, grace_ms: int) -> tuple:
    """(status, message, deciding instant); the instant is null while nothing decides."""
    end = None if gone is None else gone + grace_ms
    marks = [t for t in (complete, failed) if t is not None]
    first = min(marks, default=None)
    if first is not None and (end is None or first <= end):
        if first == complete:
            return "completed", None, first
        return "failed", FAILED_TEXT + (text or ""), first
    if end is not None:
        return "died", DIED_TEXT, end
    return "alive", None, None


def _none(x):
    return None if x is None or x != x else int(x)


def _least(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else min(a, b)


def follow(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState, grace_ms: int, forget_ms: int) -> Iterator[pd.DataFrame]:
    complete = failed = text = gone = last = None
    done = False
    if state.exists:
        complete, failed, text, gone, last, done = state.get
        complete, failed, gone, last = map(_none, (complete, failed, gone, last))
    if state.hasTimedOut and done:
        state.remove()
        return
    for frame in frames:
        for row in frame.itertuples(index=False):
            complete = _least(complete, _none(row.complete_ms))
            gone = _least(gone, _none(row.exit_ms))
            last = max(last or 0, int(row.event_time.timestamp() * 1000))
            when = _none(row.failed_ms)
            if when is not None and (failed is None or (when, row.failed_text or "") < (failed, text or "")):
                failed, text = when, row.failed_text
    if done:  # later events change nothing
        return
    status, message, decided = decision(complete, failed, text, gone, grace_ms)
    final = decided is not None and decided < state.getCurrentWatermarkMs()
    state.update((complete, failed, text, gone, last, final))
    if final:
        state.setTimeoutTimestamp(max(decided + forget_ms, state.getCurrentWatermarkMs() + 1))
    elif decided is not None:
        state.setTimeoutTimestamp(max(decided, state.getCurrentWatermarkMs() + 1))
    shown = status if final or status in ("alive", "completed", "failed") else "ending"
    yield pd.DataFrame([(key[0], shown, message if shown != "ending" else None, decided, last, final)], columns=[c.split()[0] for c in OUT_SCHEMA.split(", ")])


def training_outcomes(
    events: DataFrame, delay: str = "10 minutes", grace_ms: int = GRACE_MS, forget_ms: int = FORGET_MS
) -> DataFrame:
    """Streaming frame of changes: run_id, status, message, decided_ms, last_ms, final.

    ``events``: run_id, ms (epoch), kind (a marker name, ``exit``, anything else is a sign of
    life), text.  Statuses: alive, ending (gone, within grace), completed, failed, died.
    """
    parts = events.select(F.col("run_id").cast("long").alias("run_id"), F.col("ms").cast("long").alias("ms"), "kind", "text")
    parts = parts.where("run_id IS NOT NULL AND ms IS NOT NULL").mapInArrow(combined, PART_SCHEMA)
    return (
        parts.withWatermark("event_time", delay)
        .groupBy("run_id")
        .applyInPandasWithState(
            partial(follow, grace_ms=grace_ms, forget_ms=forget_ms), OUT_SCHEMA, STATE_SCHEMA, "update", GroupStateTimeout.EventTimeTimeout
        )
    )


def run_outcomes(changes: DataFrame, out: str | None = None) -> DataFrame:
    """Run the stream over all input present; the latest row of each run.

    ``out`` holds checkpoint and changes: a later run with the same folder goes on from there.  A
    batch that is repeated after a failure replaces its own folder.
    """
    return run_update(changes, ["run_id"], "training_outcome", out)
