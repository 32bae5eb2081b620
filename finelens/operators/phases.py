"""Training phases: rebuilt from events, taken from the run tree, tabled and summed up.

Scale notes
-----------
* ``phases_from_events`` folds partial records: every field of a phase is the
  last value that was given for it, one mergeable ``max_by`` a field in a
  single aggregation, so a run with a third of all events is combined in the
  map tasks and events may come in any order.
* ``flatten_phases`` decides container or leaf by an aggregate over each
  child's own children; the row numbers come from ``with_position``, which
  never holds the runs of one root in a task.
* ``phase_table`` joins aggregates of one row a phase; the resource series are
  averaged and pivoted in one pass over the points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finelens.functions.text import fixed
from finelens.operators import metrics as M
from finelens.operators.ordering import with_position

# ---------------------------------------------------------------------------
# fixed values that must equal the reference
# ---------------------------------------------------------------------------
EXECUTOR_SOURCE = "PhaseExecutor"
SCALARS = (
    "train_loss",
    "loss",
    "epoch",
    "global_step",
    "train_runtime",
    "train_samples_per_second",
    "train_steps_per_second",
    "learning_rate",
)
RATE_PARAM, PHASE_RATE_PARAM = "learning_rate", "config.strategy.%s.hyperparams.learning_rate"
PHASE_TYPE_PARAM = "config.strategy.%s.type"
BATCH_PARAMS = ("batch_size", "training.hyperparams.per_device_train_batch_size")
UNKNOWN_STRATEGY = "unknown"
PHASE_MARK = "phase_"
RESOURCES = {
    "gpu_utilization": "system/gpu_0_utilization_percentage",
    "gpu_memory_mb": "system/gpu_0_memory_usage_megabytes",
    "gpu_memory_percent": "system/gpu_0_memory_usage_percentage",
    "cpu_utilization": "system/cpu_utilization_percentage",
    "system_memory_mb": "system/system_memory_usage_megabytes",
    "system_memory_percent": "system/system_memory_usage_percentage",
}
NO_VALUE = "\u2014"
LOSS_KEYS = ("loss", "train_loss")  # the first that has points gives the trend


def given(text: Column) -> Column:
    """The text, null where it is empty."""
    return F.when(text != "", text)


def whole_number(text: Column) -> Column:
    """The integer that the text is, else null; blanks around it and a sign are allowed."""
    return F.when(text.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(text).try_cast("bigint"))


def instant(text: Column) -> Column:
    """Epoch milliseconds of an ISO time text; null where it is none. Without a zone it is UTC."""
    iso = r"^\d{4}-\d\d-\d\d([T ]\d\d:\d\d(:\d\d(\.\d+)?)?(Z|[+-]\d\d:?\d\d)?)?$"
    zoned = F.when(text.rlike(r"(Z|[+-]\d\d:?\d\d)$") & text.contains(":"), text).otherwise(F.concat(text, F.lit("Z")))
    zoned = F.when(F.length(text) == 10, F.concat(text, F.lit("T00:00:00Z"))).otherwise(zoned)
    return F.when(text.rlike(iso), F.unix_millis(zoned.try_cast("timestamp")))


def phases_from_events(events: DataFrame, params: DataFrame | None = None, run: str = "run_id") -> DataFrame:
    """One row per (run, phase index) that any event names.

    ``events``: run, seq, source, event_type, timestamp (text), attributes (map of texts).
    ``params``: run, params (map of texts): what the events leave open.

    The index must be a whole number.  A phase's strategy is the last one named; its start,
    end and metrics come from the executor's start and complete events, later values over
    earlier ones, unreadable ones ignored.  The duration is the run time that was measured,
    else end - start, not below 0, else 0.
    """
    attr = lambda k: F.col("attributes")[k]
    kind, seq = F.lower("event_type"), F.col("seq")
    executor = F.coalesce(F.col("source"), F.lit("")).startswith(EXECUTOR_SOURCE)
    ms = instant(F.col("timestamp"))

    def last(value: Column, when: Column | None = None) -> Column:
        value = value if when is None else F.when(when, value)
        return F.max_by(value, F.when(value.isNotNull(), seq))

    named = events.withColumn("phase_idx", whole_number(attr("phase_idx"))).where(F.col("phase_idx").isNotNull())
    done = executor & (kind == "complete")
    folded = named.groupBy(run, "phase_idx").agg(
        last(F.coalesce(given(attr("strategy_type")), given(attr("strategy")))).alias("_strategy"),
        last(ms, executor & (kind == "start")).alias("start_ms"),
        last(ms, done).alias("end_ms"),
        *[last(attr(k).try_cast("double"), done).alias(k if k != RATE_PARAM else "_rate") for k in SCALARS],
    )
    if params is None:
        params = folded.select(run).distinct().select(run, F.create_map().cast("map<string,string>").alias("params"))
    j = folded.join(params.select(run, "params"), run, "left")
    idx = F.col("phase_idx").cast("string")
    param = lambda k: given(F.element_at("params", k if isinstance(k, Column) else F.lit(k)))
    own = lambda pattern: F.concat(F.lit(pattern.split("%s")[0]), idx, F.lit(pattern.split("%s")[1]))
    strategy = F.coalesce(F.col("_strategy"), param(own(PHASE_TYPE_PARAM)), F.lit(UNKNOWN_STRATEGY))
    rate = F.coalesce(
        F.when(F.col("_rate") != 0, F.col("_rate")),
        F.coalesce(param(own(PHASE_RATE_PARAM)), param(RATE_PARAM)).try_cast("double"),
    )
    span = F.greatest(F.lit(0.0), (F.col("end_ms") - F.col("start_ms")) / F.lit(1000.0))
    span = F.when(F.col("start_ms").isNotNull() & F.col("end_ms").isNotNull(), span)
    return j.select(
        run,
        "phase_idx",
        F.concat(F.lit(PHASE_MARK), idx, F.lit("_"), strategy).alias("name"),
        F.upper(strategy).alias("strategy"),
        F.lit("FINISHED").alias("status"),
        F.coalesce(F.col("train_runtime"), span, F.lit(0.0)).alias("duration_seconds"),
        "start_ms",
        "end_ms",
        rate.alias("learning_rate"),
        whole_number(F.coalesce(*[param(k) for k in BATCH_PARAMS])).alias("batch_size"),
        *[k for k in SCALARS if k != RATE_PARAM],
    )


def flatten_phases(runs: DataFrame, roots: DataFrame) -> DataFrame:
    """The phase runs below each root, numbered in the order of their parents, then their own.

    ``runs``: run_id, parent_run_id, run_name, start_ms, has_metrics, has_params; ``roots``: run_id.
    A child of a root that has children is a container: its children named ``*phase_*`` count, or
    all of them if none is.  A child without children counts itself.  Numbers are given before
    runs without metrics and params are dropped, so they may have gaps.
    """
    own = runs.select("run_id", "parent_run_id", "run_name", "start_ms", (F.col("has_metrics") | F.col("has_params")).alias("_used"))
    child = roots.select(F.col("run_id").alias("root_run_id")).join(
        own.withColumnRenamed("parent_run_id", "root_run_id"), "root_run_id"
    )
    below = own.select(
        F.col("parent_run_id").alias("container_id"), F.col("run_id").alias("_id"), F.col("run_name").alias("_name"),
        F.col("start_ms").alias("_start"), F.col("_used").alias("_below_used"), F.col("run_name").contains(PHASE_MARK).alias("_phase"),
    )
    kinds = below.where(F.col("container_id").isNotNull()).groupBy("container_id").agg(F.max("_phase").alias("_some_phase"))
    at = [F.coalesce("start_ms", F.lit(0)).alias("_at0"), F.col("run_id").alias("_at1")]
    judged = child.join(kinds, F.col("run_id") == F.col("container_id"), "left")
    leaves = judged.where(F.col("container_id").isNull()).select(
        "root_run_id", *at, F.lit(0).cast("bigint").alias("_at2"), F.lit("").alias("_at3"),
        F.lit(None).cast("string").alias("container_id"), "run_id", "run_name", "_used",
    )
    boxes = judged.where(F.col("container_id").isNotNull()).select("root_run_id", *at, "container_id", "_some_phase")
    inner = boxes.join(below, "container_id").where(F.col("_phase") | ~F.col("_some_phase")).select(
        "root_run_id", "_at0", "_at1", F.coalesce("_start", F.lit(0)).alias("_at2"), F.col("_id").alias("_at3"),
        "container_id", F.col("_id").alias("run_id"), F.col("_name").alias("run_name"), F.col("_below_used").alias("_used"),
    )
    order = [F.col(f"_at{i}") for i in range(4)]
    placed = with_position(leaves.unionByName(inner), ["root_run_id"], order, "phase_idx")
    return placed.where("_used").select("root_run_id", "phase_idx", "run_id", "run_name", "container_id")


def scalar_or_last(values: Column) -> Column:
    """A metric that was logged as a list counts by its last element; an empty list is 0."""
    return F.coalesce(F.when(F.size(values) > 0, F.element_at(values, -1)), F.lit(0.0))


def loss_trend(series: DataFrame, by: list[str]) -> DataFrame:
    """Trend of the first of LOSS_KEYS that has points, by group: loss_first, loss_last, loss_change_pct, loss_direction."""
    t = M.trend(series.where(F.col("key").isin(*LOSS_KEYS)), [*by, "key"])
    rank = F.array_position(F.array(*[F.lit(k) for k in LOSS_KEYS]), F.col("key"))
    best = t.groupBy(*by).agg(F.min_by(F.struct("first", "last", "change_pct", "direction"), rank).alias("t"))
    return best.select(*by, *[F.col(f"t.{c}").alias(f"loss_{c}") for c in ("first", "last", "change_pct", "direction")])


def phase_table(phases: DataFrame, series: DataFrame, run: str = "run_id") -> DataFrame:
    """One row per phase: duration, loss and its trend, epochs, steps, throughput, mean resources.

    ``phases``: rows of ``phases_from_events``; ``series``: run, phase_idx, key, seq, value: the
    points of each phase.
    """
    by = [run, "phase_idx"]
    means = (
        series.where(F.col("key").isin(*RESOURCES.values()))
        .groupBy(*by)
        .agg(*[F.avg(F.when(F.col("key") == key, F.col("value"))).alias(name) for name, key in RESOURCES.items()])
    )
    j = phases.join(loss_trend(series, by), by, "left").join(means, by, "left")
    return j.select(
        *by,
        "name",
        "strategy",
        "status",
        "duration_seconds",
        F.coalesce(F.when(F.col("train_loss") != 0, F.col("train_loss")), F.col("loss")).alias("final_loss"),
        "loss_first",
        "loss_last",
        "loss_change_pct",
        F.coalesce("loss_direction", F.lit("stable")).alias("loss_direction"),
        F.col("epoch").alias("epochs"),
        F.coalesce("global_step", F.lit(0.0)).cast("bigint").alias("steps"),
        F.col("train_samples_per_second").alias("samples_per_second"),
        *RESOURCES,
    )


def run_summary(table: DataFrame, run: str = "run_id") -> DataFrame:
    """Totals of each run's phases: epochs, steps, mean throughput, loss of the last phase, strategies in order.

    ``strategy_chain`` keeps one entry a phase; a run has as many phases as its plan has stages.
    """
    rate = F.col("samples_per_second")
    return table.groupBy(run).agg(
        F.count(F.lit(1)).cast("bigint").alias("phases"),
        F.sum(F.coalesce("epochs", F.lit(0.0))).cast("bigint").alias("total_epochs"),
        F.sum("steps").cast("bigint").alias("total_steps"),
        F.avg(F.when(rate != 0, rate)).alias("samples_per_second"),
        F.max_by("final_loss", "phase_idx").alias("final_loss"),
        F.sum("duration_seconds").alias("duration_seconds"),
        F.transform(F.array_sort(F.collect_list(F.struct("phase_idx", "strategy"))), lambda p: p["strategy"]).alias("strategy_chain"),
    )


def phase_lines(table: DataFrame, run: str = "run_id") -> DataFrame:
    """The report's cells of each phase: mean loss, loss from first to last point, epochs, steps, time."""
    none = F.lit(NO_VALUE)
    shown = lambda c, text: F.coalesce(F.when(c.isNotNull(), text), none)
    time = F.col("duration_seconds")
    return table.select(
        run,
        "phase_idx",
        "strategy",
        shown(F.col("final_loss"), fixed(F.col("final_loss"), 4)).alias("train_loss"),
        shown(F.col("loss_first"), F.concat(fixed(F.col("loss_first"), 4), F.lit(" \u2192 "), fixed(F.col("loss_last"), 4))).alias("step_loss"),
        shown(F.col("epochs"), F.col("epochs").cast("string")).alias("epochs"),
        F.col("steps").cast("string").alias("steps"),
        F.when(time != 0, F.concat(fixed(time, 1), F.lit("s"))).otherwise(none).alias("time"),
    )


def duration_text(seconds: Column) -> Column:
    """Seconds with one digit below a minute, else minutes and whole seconds."""
    short = F.concat(fixed(seconds, 1), F.lit("s"))
    return F.when(seconds < 60, short).otherwise(
        F.format_string("%dm %ds", F.floor(seconds / 60), F.floor(F.pmod(seconds, F.lit(60.0))))
    )
