"""GPU tiers and memory levels: a tier by card name, else by memory, and the tier's alarm levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# fixed values that must equal the reference
# ---------------------------------------------------------------------------
# tier -> parts of card names (lower case); the first tier with a match counts
TIER_NAMES = {
    "datacenter": ("h100", "a100", "h200"),
    "professional": ("a6000", "a5000", "a4500", "l40", "rtx 6000"),
    "consumer_high": ("4090", "3090", "titan"),
    "consumer_mid": ("4080", "4070 ti", "3080 ti", "3080"),
    "consumer_low": ("4060", "4070", "3070", "3060 ti", "2080"),
    "minimal": ("3060", "2070", "2060", "1080", "1070", "1060"),
}
# tier -> least memory in GB, largest first; below all of them: minimal
TIER_GB = {"datacenter": 40, "consumer_high": 24, "consumer_mid": 12, "consumer_low": 8}
# tier -> (critical %, warning %)
TIER_LEVELS = {
    "minimal": (92.0, 85.0),
    "consumer_low": (90.0, 80.0),
    "consumer_mid": (90.0, 80.0),
    "consumer_high": (90.0, 80.0),
    "professional": (92.0, 82.0),
    "datacenter": (95.0, 85.0),
}


def gpu_tier(name: Column, total_mb: Column) -> Column:
    """Tier of a card by its name, by its memory where the name says nothing."""
    by_name = F.lit(None).cast("string")
    for tier, parts in reversed(TIER_NAMES.items()):
        by_name = F.when(F.lower(name).rlike("|".join(parts)), F.lit(tier)).otherwise(by_name)
    by_memory = F.lit("minimal")
    for tier, gb in reversed(TIER_GB.items()):
        by_memory = F.when(total_mb / 1024 >= gb, F.lit(tier)).otherwise(by_memory)
    return F.coalesce(by_name, by_memory)


def memory_levels(points: DataFrame) -> DataFrame:
    """Adds tier and level (critical, warning, ok) to points with gpu_name, total_mb, used_mb."""
    tier = gpu_tier(F.col("gpu_name"), F.col("total_mb"))
    rows = points.withColumn("tier", tier).withColumn("utilization_percent", F.col("used_mb") / F.col("total_mb") * 100)
    critical, warning = F.lit(None).cast("double"), F.lit(None).cast("double")
    for name, (c, w) in TIER_LEVELS.items():
        critical = F.when(F.col("tier") == name, c).otherwise(critical)
        warning = F.when(F.col("tier") == name, w).otherwise(warning)
    u = F.col("utilization_percent")
    return rows.withColumn("level", F.when(u > critical, "critical").when(u > warning, "warning").otherwise("ok"))
