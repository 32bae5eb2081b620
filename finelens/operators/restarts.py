"""Restart points of runs and the outputs that a restart invalidates.

For every run and stage: is a restart there possible, how, and if not, why.
Rules are an ordered cascade in one row per (run, stage): what a stage needs of
earlier outputs first, then the configuration hashes, a later rule overriding an
earlier one.  A stage needs the outputs of at most one other stage, so the state
is reached by one equi-join on (run, needed stage), the runs times the six fixed
stages being the only expansion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# fixed values that must equal the reference
# ---------------------------------------------------------------------------
STAGES = (
    "Dataset Validator",
    "GPU Deployer",
    "Training Monitor",
    "Model Retriever",
    "Inference Deployer",
    "Model Evaluator",
)
# stage -> (mode, stage whose outputs it needs, reason where they are missing)
NEEDS = {
    "Training Monitor": ("reconnect_only", "GPU Deployer", "missing_gpu_deployer_outputs"),
    "Model Retriever": ("fresh_or_resume", "GPU Deployer", "missing_gpu_deployer_outputs"),
    "Inference Deployer": ("fresh_or_resume", "Model Retriever", "missing_model_retriever_outputs"),
    "Model Evaluator": ("live_runtime_only", "Inference Deployer", "missing_inference_outputs"),
}
FRESH_ONLY, ALLOWED = "fresh_only", "restart_allowed"
RECONNECT_OUTPUTS = ("ssh_host", "ssh_port", "workspace_path")  # all of them
MODEL_OUTPUTS = ("hf_repo_id", "local_model_path")  # any of them
TRAINING_CHANGED, LATE_CHANGED = "training_critical_config_changed", "late_stage_config_changed"
LATE_STAGES = ("Inference Deployer", "Model Evaluator")


def _given(outputs: Column, key: str) -> Column:
    value = outputs[key]
    return F.coalesce(value != "", F.lit(False))


def _usable(stage: Column, outputs: Column) -> Column:
    """Whether the outputs that a stage needs are there; ``outputs`` is null where the needed stage has none."""
    reconnect = _given(outputs, RECONNECT_OUTPUTS[0])
    for k in RECONNECT_OUTPUTS[1:]:
        reconnect &= _given(outputs, k)
    model = _given(outputs, MODEL_OUTPUTS[0]) | _given(outputs, MODEL_OUTPUTS[1])
    return (
        F.when(stage == "Training Monitor", reconnect)
        .when(stage == "Inference Deployer", model)
        .when(stage.isin(*NEEDS), outputs.isNotNull())
        .otherwise(True)
    )


def stage_plan() -> Column:
    """Array of the stages in their order: pos, stage, mode, needed stage, reason."""
    rows = []
    for pos, stage in enumerate(STAGES):
        mode, needs, reason = NEEDS.get(stage, (FRESH_ONLY, None, None))
        values = [("pos", pos), ("stage", stage), ("mode", mode), ("needs", needs), ("missing", reason)]
        rows.append(F.struct(*[(F.lit(v) if v is not None else F.lit(None).cast("string")).alias(n) for n, v in values]))
    return F.array(*rows)


def restart_points(states: DataFrame, lineage: DataFrame, configs: DataFrame, run: str = "run_id") -> DataFrame:
    """One row per (run, stage): available, mode, reason.

    ``states``: run, model_dataset_hash (may be null or empty), training_hash, late_hash: as of the
    last attempt.  ``lineage``: run, stage_name, outputs (map of texts): current outputs of a stage.
    ``configs``: run and the three hashes of the configuration given now.

    A changed hash overrides missing outputs, the late-stage hash overrides the training hash.  States
    without a model-dataset hash are judged by their training hash.
    """
    c = configs.select(run, *[F.col(h).alias(f"_now_{h}") for h in ("model_dataset_hash", "training_hash", "late_hash")])
    rows = states.join(c, run, "left").select("*", F.explode(stage_plan()).alias("s")).select("*", "s.*").drop("s")
    outs = lineage.select(F.col(run).alias("_run"), F.col("stage_name").alias("_stage"), "outputs")
    j = rows.join(outs, (F.col(run) == F.col("_run")) & (F.col("needs") == F.col("_stage")), "left")
    known = F.coalesce(F.col("model_dataset_hash") != "", F.lit(False))
    training = F.when(known, ~F.col("model_dataset_hash").eqNullSafe(F.col("_now_model_dataset_hash"))).otherwise(
        ~F.col("training_hash").eqNullSafe(F.col("_now_training_hash"))
    )
    late = ~F.col("late_hash").eqNullSafe(F.col("_now_late_hash")) & ~F.col("stage").isin(*LATE_STAGES)
    reason = (
        F.when(late, LATE_CHANGED)
        .when(training, TRAINING_CHANGED)
        .when(~_usable(F.col("stage"), F.col("outputs")), F.col("missing"))
        .otherwise(ALLOWED)
    )
    return j.select(run, "pos", "stage", (reason == ALLOWED).alias("available"), "mode", reason.alias("reason"))


def lineage_invalidate(lineage: DataFrame, starts: DataFrame, run: str = "run_id") -> DataFrame:
    """The outputs that stay valid when a run starts again at a stage: those of the stages before it.

    ``starts``: run, start_stage.  Runs that do not start again keep all; outputs of a stage that
    is not in the order stay.
    """
    order = F.array(*[F.lit(s) for s in STAGES])
    j = lineage.join(starts.select(run, "start_stage"), run, "left")
    place, start = F.array_position(order, F.col("stage_name")), F.array_position(order, F.col("start_stage"))
    gone = F.col("start_stage").isNotNull() & (place >= start) & (place > 0)
    return j.where(~F.coalesce(gone, F.lit(False))).select(*lineage.columns)
