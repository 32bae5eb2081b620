"""Raw probe texts of training machines to resource figures; GPU and model facts from events.

Probe texts are parsed by native string functions, one projection a row.
The facts of a run are folds over its events with a stop rule; both are
aggregations that combine in the map tasks, so no run is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finelens.functions.text import fixed

# ---------------------------------------------------------------------------
# fixed values that must equal the reference
# ---------------------------------------------------------------------------
UNLIMITED = 1 << 60  # limits from here on mean that there is none
CGROUP_V2 = ("memory.max", "memory.current")
CGROUP_V1 = ("memory.limit_in_bytes", "memory.usage_in_bytes")
MEM_TOTAL, MEM_AVAILABLE, MEM_FREE = "MemTotal", "MemAvailable", "MemFree"
GPU_FIELDS = 4  # utilisation, memory used, memory total (MB), temperature
GPU_NAME_PARAM = "mm.gpu_name"
VRAM_KEYS, TIER_KEYS = ("total_vram_gb", "vram_gb"), ("gpu_tier", "tier")
MODEL_SOURCE, MODEL_SIZE = "Model Retriever", r"Model size: ([0-9.]+) MB"
MODEL_KEYS = ("total_parameters", "trainable_parameters", "trainable_percent", "model_loading_time_seconds")

_BLANK = r"[ \t\r\f\x0B]*"


def parse_gpu_csv(text: Column) -> Column:
    """(gpu_util, vram_used_mb, vram_total_mb, vram_pct, gpu_temp) of a CSV line; zeros where it is none."""
    parts = F.split(F.trim(F.regexp_replace(text, r"^\s+|\s+$", "")), ",")
    field = lambda i: F.when(F.size(parts) >= GPU_FIELDS, F.trim(F.get(parts, F.lit(i))).try_cast("double"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    used, total = zero(field(1)), zero(field(2))
    return F.struct(
        zero(field(0)).alias("gpu_util"),
        used.alias("vram_used_mb"),
        total.alias("vram_total_mb"),
        F.when(total > 0, used / total * F.lit(100.0)).otherwise(F.lit(0.0)).alias("vram_pct"),
        zero(field(3)).alias("gpu_temp"),
    )


def _last_line_value(text: Column, key: str, mark: str, value: str) -> Column:
    """What the last line ``key mark value`` of a text gives for its value, null if no line does."""
    pattern = rf"(?m)^{_BLANK}{key.replace('.', '[.]')}{_BLANK}{mark}{_BLANK}({value})"
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.lit(-1))


def _whole(text: Column) -> Column:
    """The number that the text is; "max", blank and anything else is none."""
    return F.when(text.rlike(r"^[0-9]+$"), text.try_cast("decimal(38,0)"))


def parse_cgroup(text: Column) -> Column:
    """(total_gb, used_gb) from ``key=value`` lines: version 2, else version 1; null without a limit."""

    def pair(keys: tuple[str, str]) -> Column:
        limit, used = (_whole(F.trim(_last_line_value(text, k, "=", r"[^\n]*"))) for k in keys)
        ok = limit.isNotNull() & used.isNotNull() & (limit > 0) & (limit < F.lit(UNLIMITED))
        return F.when(ok, F.struct(limit.alias("total"), F.least(used, limit).alias("used")))

    both = F.coalesce(pair(CGROUP_V2), pair(CGROUP_V1))
    return _gib(both["total"].cast("double"), both["used"].cast("double"), 1 << 30)


def parse_meminfo(text: Column) -> Column:
    """(total_gb, used_gb) from ``Key: n kB`` lines; null without the total."""
    total, available, free = (
        _last_line_value(text, k, ":", r"[0-9]+(?![^\s])").try_cast("double") for k in (MEM_TOTAL, MEM_AVAILABLE, MEM_FREE)
    )
    return _gib(total, total - F.coalesce(available, free, F.lit(0.0)), 1 << 20)


def _gib(total: Column, used: Column, unit: int) -> Column:
    return F.when(
        total.isNotNull(), F.struct((total / F.lit(float(unit))).alias("total_gb"), (used / F.lit(float(unit))).alias("used_gb"))
    )


def resource_samples(probes: DataFrame) -> DataFrame:
    """``probes`` (gpu_text, cgroup_text, meminfo_text and keys) with resource columns instead of texts.

    Memory comes from the container's limit, and from the host's figures where there is none.
    """
    texts = ("gpu_text", "cgroup_text", "meminfo_text")
    keys = [c for c in probes.columns if c not in texts]
    parsed = probes.select(
        *keys,
        parse_gpu_csv(F.coalesce("gpu_text", F.lit(""))).alias("g"),
        F.coalesce(parse_cgroup(F.col("cgroup_text")), parse_meminfo(F.col("meminfo_text"))).alias("m"),
    )
    return parsed.select(
        *keys,
        "g.gpu_util",
        (F.col("g.vram_used_mb") / 1024).alias("vram_used_gb"),
        (F.col("g.vram_total_mb") / 1024).alias("vram_total_gb"),
        "g.vram_pct",
        "g.gpu_temp",
        F.coalesce("m.used_gb", F.lit(0.0)).alias("ram_used_gb"),
        F.coalesce("m.total_gb", F.lit(0.0)).alias("ram_total_gb"),
    )


def resource_totals(samples: DataFrame, run: str = "run_id") -> DataFrame:
    """Per run: samples, mean and peak use of GPU, its memory and main memory."""
    return samples.groupBy(run).agg(
        F.count(F.lit(1)).cast("bigint").alias("samples"),
        F.avg("gpu_util").alias("avg_gpu_util"),
        F.max("vram_pct").alias("peak_vram_pct"),
        F.max("gpu_temp").alias("peak_gpu_temp"),
        F.avg("ram_used_gb").alias("avg_ram_used_gb"),
        F.max("ram_total_gb").alias("ram_total_gb"),
    )


def _attr(keys: tuple[str, ...]) -> Column:
    """The first of an event's attributes that is given (not empty, not zero)."""
    values = [F.col("attributes")[k] for k in keys]
    return F.coalesce(*[F.when((v != "") & ~F.coalesce(v.try_cast("double") == 0, F.lit(False)), v) for v in values])


def gpu_info(events: DataFrame, params: DataFrame | None = None, run: str = "run_id") -> DataFrame:
    """Name, memory and tier of each run's GPU.

    Later events override earlier ones up to the first that gives memory and tier both: that one
    overrides all before it and ends the search.  So a run's facts are those of its first
    complete event, and where there is none the last value of each.  ``params`` (run, params)
    gives the name where no event does.
    """
    name, vram, tier = F.col("attributes")["gpu_name"], _attr(VRAM_KEYS).try_cast("double"), _attr(TIER_KEYS)
    seen = events.select(run, "seq", name.alias("name"), vram.alias("vram"), tier.alias("tier")).where(F.col("name").isNotNull())
    whole = F.col("vram").isNotNull() & F.col("tier").isNotNull()
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq")))
    folded = seen.groupBy(run).agg(
        F.min_by(F.struct("name", "vram", "tier"), F.when(whole, F.col("seq"))).alias("first"),
        *[last(c).alias(c) for c in ("name", "vram", "tier")],
    )
    pick = lambda c: F.when(F.col("first").isNotNull(), F.col(f"first.{c}")).otherwise(F.col(c))
    facts = folded.select(run, *[pick(c).alias(c) for c in ("name", "vram", "tier")])
    if params is not None:
        given = params.select(run, F.col("params")[GPU_NAME_PARAM].alias("_given"))
        facts = facts.join(given.where("_given IS NOT NULL"), run, "full").withColumn("name", F.coalesce("name", "_given"))
    return facts.select(
        run, "name", F.concat(fixed(F.col("vram"), 1), F.lit("GB")).alias("_shown"), F.col("vram").alias("total_vram_gb"), "tier"
    ).select(run, "name", F.when(F.col("total_vram_gb").isNotNull(), F.col("_shown")).alias("total_vram"), "total_vram_gb", "tier")


def model_info(events: DataFrame, run: str = "run_id") -> DataFrame:
    """Parameter counts of the last event that gives them, and the size that the last retrieval names."""
    size = F.when(F.col("source") == MODEL_SOURCE, F.regexp_extract(F.coalesce("message", F.lit("")), MODEL_SIZE, 1).try_cast("double"))
    rows = events.select(run, "seq", size.alias("_size"), *[F.col("attributes")[k].alias(k) for k in MODEL_KEYS])
    counted = F.when(F.col(MODEL_KEYS[0]).isNotNull(), F.col("seq"))
    folded = rows.where(F.col("_size").isNotNull() | F.col(MODEL_KEYS[0]).isNotNull()).groupBy(run).agg(
        F.max_by(F.struct(*MODEL_KEYS), counted).alias("m"),
        F.max_by("_size", F.when(F.col("_size").isNotNull(), F.col("seq"))).alias("model_size_mb"),
    )
    types = ("bigint", "bigint", "double", "double")
    return folded.select(run, *[F.col(f"m.{k}").try_cast(t).alias(k) for k, t in zip(MODEL_KEYS, types)], "model_size_mb")
