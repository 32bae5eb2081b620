"""Run records: documents read back from text, attempt and configuration comparisons, strategy chains.

A document is one JSON text.  A broken document never fails the job: it
yields no event rows, a run of status ``unknown`` with an error text, or a
missing artifact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# fixed values that must equal the reference
# ---------------------------------------------------------------------------
START_STRATEGIES = ("cpt", "sft", "orpo", "grpo", "sapo", "dpo")
TRANSITIONS = {
    "cpt": ("sft", "cot"),
    "sft": ("cot", "dpo", "orpo", "grpo", "sapo"),
    "cot": ("dpo", "orpo", "grpo", "sapo"),
    "dpo": (),
    "orpo": (),
    "grpo": (),
    "sapo": (),
}
CHAIN_NONE, CHAIN_DUPLICATE = "STRATEGY_CHAIN_CONTAINS_NONE", "STRATEGY_CHAIN_DUPLICATE_DATASET"
STATE_VERSION = 1

EVENTS_DOC = "events array<struct<seq:bigint,event_type:string,value:double>>"
STATE_DOC = "schema_version int, logical_run_id string, pipeline_status string, attempts int"
ENVELOPE_DOC = "stage string, status string, duration_seconds double, error string"
ENVELOPE_FIELDS = "stage string, status string, started_at string, duration_seconds double, error string, data map<string,string>"


def document(text: Column, schema: str) -> Column:
    """The parsed document, null where the text is no JSON object."""
    return F.when(F.try_parse_json(text).isNotNull(), F.from_json(text, schema))


def events_of(docs: DataFrame, text: str = "doc") -> DataFrame:
    """Event rows of ``{"events": [...]}`` documents; a broken document has none."""
    others = [c for c in docs.columns if c != text]
    return docs.select(*others, F.explode(document(F.col(text), EVENTS_DOC)["events"]).alias("e")).select(*others, "e.*")


def run_states(docs: DataFrame, run: str = "run_id", text: str = "doc") -> DataFrame:
    """One row per state document; what cannot be used has status ``unknown`` and an error text."""
    s = document(F.col(text), STATE_DOC)
    rows = docs.select(run, s.alias("s"))
    error = (
        F.when(F.col("s").isNull(), "state is not readable")
        .when(~F.col("s.schema_version").eqNullSafe(F.lit(STATE_VERSION)), "unsupported state version")
        .when(F.col("s.logical_run_id").isNull(), "state has no run id")
    )
    return rows.select(
        run,
        F.when(error.isNull(), F.coalesce("s.pipeline_status", F.lit("unknown"))).otherwise("unknown").alias("status"),
        F.when(error.isNull(), F.coalesce("s.attempts", F.lit(0))).otherwise(0).alias("attempts"),
        error.alias("error"),
    )


def stage_results(docs: DataFrame, text: str = "doc") -> DataFrame:
    """``docs`` with stage, status, duration and error of each document; all null where it cannot be read."""
    others = [c for c in docs.columns if c != text]
    return docs.select(*others, document(F.col(text), ENVELOPE_DOC).alias("_e")).select(*others, "_e.*")


def envelopes(outcomes: DataFrame, run: str = "run_id") -> DataFrame:
    """The result of each stage as (run, stage, envelope): the first outcome that a stage reports counts.

    ``outcomes``: run, seq, stage, status, started_at (text), duration_seconds, error, data (map of texts).
    Only a failed stage has an error, a skipped one neither duration nor data; durations have three digits.
    """
    skipped = F.col("status") == "skipped"
    none = F.create_map().cast("map<string,string>")
    envelope = F.struct(
        "stage",
        "status",
        "started_at",
        F.when(skipped, 0.0).otherwise(F.bround("duration_seconds", 3)).alias("duration_seconds"),
        F.when(F.col("status") == "failed", F.col("error")).alias("error"),
        F.when(skipped, none).otherwise(F.coalesce("data", none)).alias("data"),
    )
    # a map has no order, its text has: the text decides between equal seq, and it alone is dealt out and read back
    rows = outcomes.select(run, "seq", "stage", F.to_json(envelope).alias("text"))
    first = rows.groupBy(run, "stage").agg(F.min(F.struct("seq", "text")).alias("_e"))
    return first.select(run, "stage", F.from_json("_e.text", ENVELOPE_FIELDS).alias("envelope"))


def stage_envelopes(docs: DataFrame, run: str = "run_id", text: str = "doc") -> DataFrame:
    """Per run: readable stage results, their failures and time, and the stages whose result is unreadable.

    ``docs``: run, stage_name, text; an absent document is neither present nor missing.
    """
    e = document(F.col(text), ENVELOPE_DOC)
    rows = docs.select(run, "stage_name", e.alias("e"))
    broken = F.col("e").isNull()
    return rows.groupBy(run).agg(
        F.count_if(~broken).cast("bigint").alias("stages"),
        F.count_if(F.col("e.status") == "failed").cast("bigint").alias("failed"),
        F.coalesce(F.sum("e.duration_seconds"), F.lit(0.0)).alias("total_seconds"),
        # at most one name a stage: the stages are a fixed handful
        F.array_join(F.array_sort(F.collect_set(F.when(broken, F.col("stage_name")))), ",").alias("missing_artifacts"),
    )


def attempt_diff(attempts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Two attempts of a run side by side.

    ``attempts``: run_id, attempt_no, critical_hash, late_hash; ``pairs``: run_id, attempt_a, attempt_b.
    """
    out = pairs
    for x in "ab":
        own = attempts.select(
            "run_id", F.col("attempt_no").alias(f"attempt_{x}"), F.lit(True).alias(f"found_{x}"),
            F.col("critical_hash").alias(f"hash_{x}_critical"), F.col("late_hash").alias(f"hash_{x}_late"),
        )
        out = out.join(own, ["run_id", f"attempt_{x}"], "left").fillna(False, [f"found_{x}"])
    both = F.col("found_a") & F.col("found_b")
    shown = [F.when(both, F.col(f"hash_{x}_{k}")).otherwise("").alias(f"hash_{x}_{k}") for x in "ab" for k in ("critical", "late")]
    changed = lambda k: (both & ~F.col(f"hash_a_{k}").eqNullSafe(F.col(f"hash_b_{k}")))
    return out.select(
        "run_id", "attempt_a", "attempt_b", "found_a", "found_b", *shown,
        changed("critical").alias("training_critical_changed"), changed("late").alias("late_stage_changed"),
    )


def config_drift(stored: DataFrame, current: DataFrame) -> DataFrame:
    """What blocks a resume of each run: stored hashes against those of the current configuration.

    The model-dataset hash decides where it was stored, else the training hash; the late hash comes after.
    """
    c = current.select("run_id", *[F.col(h).alias(f"now_{h}") for h in ("model_dataset", "training_critical", "late_stage")])
    j = stored.join(c, "run_id")
    has_model = F.coalesce(F.col("model_dataset"), F.lit("")) != ""
    differs = lambda h: ~F.col(h).eqNullSafe(F.col(f"now_{h}"))
    training = F.when(has_model, differs("model_dataset")).otherwise(differs("training_critical"))
    blocked = F.when(training, "training_critical").when(differs("late_stage"), "late_stage")
    return j.select("run_id", blocked.alias("blocked_by"), blocked.isNull().alias("can_resume"))


def strategy_chain_check(phases: DataFrame) -> DataFrame:
    """Per chain: start and transition warnings, and the error that rejects it.

    ``phases``: chain, pos, strategy, dataset, cached.  A null strategy rejects the
    chain before anything else is looked at; so does a dataset that two phases
    without cache share (the smallest repeated name is reported).
    """
    order = Window.partitionBy("chain").orderBy("pos")
    allowed = F.create_map(*[x for k, v in TRANSITIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))])
    rows = phases.withColumn("before", F.lag("strategy").over(order)).withColumn("nth", F.row_number().over(order))
    bad_start = (F.col("nth") == 1) & ~F.col("strategy").isin(*START_STRATEGIES)
    bad_step = (F.col("nth") > 1) & ~F.coalesce(F.array_contains(F.try_element_at(allowed, F.col("before")), F.col("strategy")), F.lit(False))
    facts = rows.groupBy("chain").agg(
        F.count(F.lit(1)).cast("bigint").alias("phases"),
        F.count_if(F.col("strategy").isNull()).alias("nulls"),
        F.max(F.coalesce(bad_start, F.lit(False))).alias("start"),
        F.count_if(bad_step).alias("steps"),
    )
    own = phases.where(~F.col("cached")).groupBy("chain", F.coalesce("dataset", F.lit("default")).alias("dataset")).count()
    twice = own.where("count > 1").groupBy("chain").agg(F.min("dataset").alias("twice"))
    none = F.col("nulls") > 0
    code = F.when(none, CHAIN_NONE).when(F.col("twice").isNotNull(), CHAIN_DUPLICATE)
    return facts.join(twice, "chain", "left").select(
        "chain",
        "phases",
        (~none & F.col("start")).alias("invalid_start"),
        F.when(none, 0).otherwise(F.col("steps")).cast("bigint").alias("invalid_transitions"),
        code.alias("error_code"),
        F.when(~none, F.col("twice")).alias("duplicate_dataset"),
    )


def compare_with_best(runs: DataFrame, by: str, metric: str) -> DataFrame:
    """Every run of a group beside the group's best (smallest ``metric``, ties by run_id)."""
    best = (
        runs.where(F.col(metric).isNotNull())
        .groupBy(by)
        .agg(F.min(F.struct(metric, "run_id")).alias("b"))
        .select(by, F.col("b.run_id").alias("best_run_id"), F.col(f"b.{metric}").alias("best_value"))
    )
    out = runs.join(best, by, "left")
    return out.select(by, "run_id", F.col(metric).alias("value"), "best_run_id", "best_value", (F.col(metric) - F.col("best_value")).alias("delta"))
