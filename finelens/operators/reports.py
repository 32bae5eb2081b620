"""Evaluation run summaries and roll-ups, strategy metric profiles, registry and smoke reports.

All are aggregations of one row a plugin, run or configuration; lists that a
report shows (plugins of an evaluation, phases of a dataset) are short by
their nature and sorted by their own key, wherever the rows came from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# fixed values that must equal the reference
# ---------------------------------------------------------------------------
DEFAULT_METRICS = ("loss", "train_loss", "eval_loss", "learning_rate", "grad_norm", "train_samples_per_second", "epoch")
SFT_EXTRA = ("mean_token_accuracy", "entropy")
PREFERENCE_EXTRA = ("rewards/accuracies", "rewards/margins", "logps/chosen", "logps/rejected")
ONLINE_EXTRA = ("reward", "reward_std", "kl", "completion_length")
PROFILES = {
    "sft": SFT_EXTRA,
    "cpt": SFT_EXTRA,
    "cot": SFT_EXTRA,
    "dpo": PREFERENCE_EXTRA,
    "orpo": PREFERENCE_EXTRA,
    "sapo": ONLINE_EXTRA,
    "ppo": ONLINE_EXTRA,
    "grpo": ONLINE_EXTRA,
}
NO_PLUGINS = "No evaluation plugins enabled or registered"
RUNTIME_PARAMS = ("gpu_name", "training_type")
PRIMARY = "primary"
NO_DETAILS = "No error details captured. Check pipeline.log in run directory."


# ---------------------------------------------------------------------------
# evaluation
# ---------------------------------------------------------------------------
def skipped_plugins(plugins: DataFrame, samples: DataFrame, run: str = "run_id") -> DataFrame:
    """``plugins`` with ``skipped``: it needs expected answers and no sample of the run has one.

    ``plugins``: run, plugin_id, priority, requires_expected; ``samples``: run, expected_answer.
    """
    some = samples.where(F.col("expected_answer").isNotNull()).select(run).distinct().withColumn("_some", F.lit(True))
    j = plugins.join(some, run, "left")
    return j.withColumn("skipped", F.col("requires_expected") & F.col("_some").isNull()).drop("_some")


def eval_run_summary(runs: DataFrame, plugins: DataFrame, results: DataFrame, run: str = "run_id") -> DataFrame:
    """One row per run: overall verdict, sample count, plugins by outcome in priority order, errors.

    ``runs``: run, sample_count; ``plugins``: rows of ``skipped_plugins``; ``results``: run,
    plugin_id, passed.  A run passes if no plugin that ran has failed; skipped ones do not
    count; a plugin that ran without leaving a result has crashed and fails; a run without
    plugins fails with an error.
    """
    ran = plugins.join(results.select(run, "plugin_id", "passed"), [run, "plugin_id"], "left")
    outcome = F.when(F.col("skipped"), "skipped").when(F.coalesce("passed", F.lit(False)), "passed").otherwise("failed")
    listed = lambda name: F.transform(
        F.array_sort(F.collect_list(F.when(outcome == name, F.struct("priority", "plugin_id")))), lambda p: p["plugin_id"]
    ).alias(f"{name}_plugins")
    per = ran.groupBy(run).agg(*[listed(n) for n in ("passed", "failed", "skipped")])
    j = runs.select(run, "sample_count").join(per, run, "left")
    none = F.col("passed_plugins").isNull()
    empty = F.array().cast("array<string>")
    names = [F.coalesce(f"{n}_plugins", empty).alias(f"{n}_plugins") for n in ("passed", "failed", "skipped")]
    return j.select(
        run,
        (~none & (F.size(F.coalesce("failed_plugins", empty)) == 0)).alias("overall_passed"),
        "sample_count",
        *names,
        F.when(none, F.array(F.lit(NO_PLUGINS))).otherwise(empty).alias("errors"),
    )


def eval_rollup(results: DataFrame) -> DataFrame:
    """``results`` with numeric metrics only and the number of failed samples.

    ``metrics`` is a map of JSON texts: numbers stay, texts, booleans and nulls go.
    ``failed_samples`` is a JSON text: a list counts its elements, a number is itself, else 0.
    """
    number = r"^-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$"
    numeric = F.transform_values(F.map_filter("metrics", lambda _, v: v.rlike(number)), lambda _, v: v.cast("double"))
    failed = F.col("failed_samples")
    count = F.coalesce(F.json_array_length(F.when(failed.startswith("["), failed)).cast("bigint"), failed.try_cast("double").cast("bigint"), F.lit(0))
    return results.withColumn("metrics", numeric).withColumn("failed_samples", count)


# ---------------------------------------------------------------------------
# runs and configurations
# ---------------------------------------------------------------------------
def metric_profile(phases: DataFrame) -> DataFrame:
    """``phases`` (any keys, strategy) times the metrics that matter for the strategy: metric, pos.

    An unknown strategy has the default metrics.
    """
    extra = F.create_map(*[x for s, m in PROFILES.items() for x in (F.lit(s), F.array(*map(F.lit, m)))])
    own = F.coalesce(F.element_at(extra, F.lower("strategy")), F.array().cast("array<string>"))
    return phases.select("*", F.posexplode(F.concat(F.array(*map(F.lit, DEFAULT_METRICS)), own)).alias("pos", "metric"))


def training_run(runs: DataFrame, roots: DataFrame) -> DataFrame:
    """The training run of each root: its first child with a runtime parameter, else its first with children.

    ``runs``: run_id, parent_run_id, start_ms, params (map of texts); ``roots``: run_id.  First is by
    start, then id.  Roots without such a child are absent.
    """
    parents = runs.where(F.col("parent_run_id").isNotNull()).select(F.col("parent_run_id").alias("run_id")).distinct()
    child = runs.join(roots.select(F.col("run_id").alias("root_run_id")), F.col("parent_run_id") == F.col("root_run_id"))
    child = child.join(parents.withColumn("_box", F.lit(True)), "run_id", "left")
    keyed = F.lit(False)
    for p in RUNTIME_PARAMS:
        keyed |= F.coalesce(F.map_contains_key("params", F.lit(p)), F.lit(False))
    rank = F.when(keyed, 0).when(F.col("_box"), 1)
    order = F.struct(rank.alias("r"), F.coalesce("start_ms", F.lit(0)), "run_id")
    best = child.where(rank.isNotNull()).groupBy("root_run_id").agg(F.min_by(F.struct("run_id", rank.alias("r")), order).alias("b"))
    return best.select("root_run_id", F.col("b.run_id").alias("run_id"), F.when(F.col("b.r") == 0, "params").otherwise("container").alias("found_by"))


def runs_by_config(configs: DataFrame, runs: DataFrame) -> DataFrame:
    """The newest run of each configuration path, looked up by its resolved path, else by the path as given.

    ``configs``: path, resolved; ``runs``: config_path, run_dir, started_ms.  Configurations
    without a run keep a null.
    """
    newest = runs.groupBy("config_path").agg(F.max_by("run_dir", F.struct("started_ms", "run_dir")).alias("run_dir"))
    by = lambda c: newest.select(F.col("config_path").alias(c), F.col("run_dir").alias(f"_by_{c}"))
    j = configs.join(by("resolved"), "resolved", "left").join(by("path"), "path", "left")
    return j.select(*configs.columns, F.coalesce("_by_resolved", "_by_path").alias("run_dir"))


def datasets_to_phases(datasets: DataFrame, phases: DataFrame, key: str = "config_id") -> DataFrame:
    """One row per configuration and dataset to validate: the strategies of the phases that use it, in order.

    ``datasets``: key, dataset (those the configuration knows); ``phases``: key, phase_idx, strategy,
    dataset.  Phases without a dataset or with an unknown one are passed over; a
    configuration that has none left is validated by its primary dataset, for no phase.
    """
    known = phases.where(F.col("dataset") != "").join(datasets.select(key, "dataset").distinct(), [key, "dataset"], "left_semi")
    used = known.groupBy(key, "dataset").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("phase_idx", "strategy"))), lambda p: p["strategy"]).alias("strategies")
    )
    bare = datasets.select(key).distinct().join(used.select(key).distinct(), key, "left_anti")
    return used.unionByName(
        bare.select(key, F.lit(PRIMARY).alias("dataset"), F.array().cast("array<string>").alias("strategies"))
    )


def smoke_report(results: DataFrame, group: str = "batch") -> DataFrame:
    """One row per configuration of a batch, and the batch's totals under a null configuration.

    ``results``: batch, config, exit_code, timed_out, duration_s, error.  A configuration that was
    ended for want of output is shown as IDLE; whether it passed is for its exit code to say.
    """
    passed = F.coalesce(F.col("exit_code") == 0, F.lit(False))
    status = F.when(F.col("timed_out"), "IDLE").when(passed, "PASSED").otherwise("FAILED")
    error = F.when(~passed, F.coalesce("error", F.lit(NO_DETAILS)))
    rows = results.select(group, "config", status.alias("status"), minutes_text(F.col("duration_s")).alias("duration"), error.alias("error"))
    none = [F.lit(None).cast("bigint").alias(c) for c in ("configs", "passed", "failed")]
    totals = results.groupBy(group).agg(
        F.sum("duration_s").alias("_s"),
        F.count(F.lit(1)).cast("bigint").alias("configs"),
        F.count_if(passed).cast("bigint").alias("passed"),
        F.count_if(~passed).cast("bigint").alias("failed"),
    )
    blank = [F.lit(None).cast("string").alias(c) for c in ("config", "status", "error")]
    return rows.select("*", *none).unionByName(
        totals.select(group, *blank, minutes_text(F.col("_s")).alias("duration"), "configs", "passed", "failed")
    )


def minutes_text(seconds: Column) -> Column:
    """Minutes and two digits of seconds."""
    s = seconds.cast("bigint")
    return F.format_string("%dm %02ds", F.floor(s / 60), s % 60)
