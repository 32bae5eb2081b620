"""Dataset validation checks as fused DataFrame aggregations.

A check is a set of column/aggregate expressions plus a verdict; several
checks share one scan.  Results come back as rows, one per (dataset, check),
shaped like the reference's validation result: passed flag, metrics,
thresholds, errors, warnings.

Scale notes
-----------
* ``text_profile`` reads the samples once.  Tokens are exploded with
  ``posexplode_outer``; the per-row statistics ride on the first token row, so
  count / length / short-text / token totals and the exact distinct-token
  count come from one pipeline with map-side partial aggregation on
  ``(dataset, token)`` (a hot token or a hot dataset is combined before the
  shuffle, never collected).
* duplicates are counted by grouping on ``(dataset, md5(text))`` (16-byte key,
  partial aggregation collapses boilerplate copies on the map side); the
  duplicate -> first-occurrence pairs use a join on that key, not a window, so
  a hot hash is split by AQE's skew-join handling instead of landing in one
  window partition.
* example indices per error type are bounded with ``row_number() <= n``,
  which Spark plans as a partial ``WindowGroupLimit`` before the shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finelens.functions.text import normalize_pair_text, py_split, py_str, py_strip, py_strip_length
from finelens.session import spread

# ---------------------------------------------------------------------------
# fixed values that must equal the reference (defaults and priorities)
# ---------------------------------------------------------------------------
PRIORITY = {
    "min_samples": 10,
    "preference_format": 15,
    "avg_length": 20,
    "empty_ratio": 25,
    "prompt_contract": 25,
    "diversity_score": 30,
    "identical_pairs": 35,
    "preference_semantics": 35,
    "deduplication": 40,
    "gold_outcomes": 40,
}
MIN_SAMPLES_THRESHOLD = 100
AVG_LENGTH_MIN, AVG_LENGTH_MAX, AVG_LENGTH_NEAR_FACTOR = 50, 8192, 1.2
EMPTY_MAX_RATIO, EMPTY_MIN_CHARS, EMPTY_CRITICAL = 0.1, 10, 0.2
DIVERSITY_MIN_SCORE, DIVERSITY_NEAR_FACTOR, DIVERSITY_CRITICAL = 0.7, 1.1, 0.3
DEDUP_MAX_RATIO, DEDUP_CRITICAL = 0.1, 0.3
IDENTICAL_MAX_RATIO, IDENTICAL_CRITICAL = 0.01, 0.05
PREF_MIN_VALID_RATIO, PREF_CRITICAL = 0.95, 0.8

# The default set used when a dataset configures no checks.
DEFAULT_CHECKS = {
    "min_samples": {"threshold": 100},
    "avg_length": {"min": 50, "max": 8192},
    "empty_ratio": {"max_ratio": 0.05},
    "diversity_score": {"min_score": 0.3},
}


@dataclass(frozen=True)
class TextThresholds:
    min_samples: int = MIN_SAMPLES_THRESHOLD
    avg_min: float = AVG_LENGTH_MIN
    avg_max: float = AVG_LENGTH_MAX
    empty_max_ratio: float = EMPTY_MAX_RATIO
    empty_min_chars: int = EMPTY_MIN_CHARS
    diversity_min: float = DIVERSITY_MIN_SCORE

    @classmethod
    def defaults(cls) -> "TextThresholds":
        d = DEFAULT_CHECKS
        return cls(
            min_samples=d["min_samples"]["threshold"],
            avg_min=d["avg_length"]["min"],
            avg_max=d["avg_length"]["max"],
            empty_max_ratio=d["empty_ratio"]["max_ratio"],
            diversity_min=d["diversity_score"]["min_score"],
        )


def safe_ratio(num: Column, den: Column) -> Column:
    """n / d, 0 when d is 0."""
    return F.when(den == 0, F.lit(0.0)).otherwise(num.cast("double") / den.cast("double"))


# ---------------------------------------------------------------------------
# sampling (head-N by position, never random)
# ---------------------------------------------------------------------------
def head_n(samples: DataFrame, n: int | None, by: list[str] | None = None) -> DataFrame:
    """First ``n`` rows by ``row_idx`` (per ``by`` group when given).

    With ``by`` unset this is a plain ``row_idx < n`` style cut on the global
    order; rows carry an explicit ``row_idx`` so the result is deterministic.
    """
    if n is None:
        return samples
    if not by:
        return samples.orderBy("row_idx").limit(n)
    w = Window.partitionBy(*by).orderBy("row_idx")
    return samples.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


# ---------------------------------------------------------------------------
# fused text profile
# ---------------------------------------------------------------------------
def text_profile(samples: DataFrame, by: list[str], text: Column | None = None, min_chars: int = EMPTY_MIN_CHARS) -> DataFrame:
    """One scan -> per group: rows, total length, short rows, tokens, distinct tokens.

    ``samples`` must hold the ``by`` columns and a ``text`` column (or pass
    ``text``).  Length is in code points, tokens are ``lower(text).split()``.
    """
    txt = text if text is not None else py_str("text")
    # Per-row values are computed before the explode: an expression placed in
    # the same select as the generator would be evaluated once per token.
    rows = spread(samples.select(*by, txt.alias("_t"))).select(
        *by,
        F.length("_t").alias("_len"),
        (py_strip_length("_t") < min_chars).cast("int").alias("_short"),
        py_split(F.lower("_t")).alias("_toks"),
    )
    per_row = rows.select(*by, "_len", "_short", F.posexplode_outer("_toks").alias("_pos", "_tok"))
    first = F.coalesce(F.col("_pos"), F.lit(0)) == 0
    by_token = per_row.groupBy(*by, "_tok").agg(
        F.sum(F.when(first, 1).otherwise(0)).alias("_rows"),
        F.sum(F.when(first, F.col("_len")).otherwise(0)).alias("_len"),
        F.sum(F.when(first, F.col("_short")).otherwise(0)).alias("_short"),
        F.count("_tok").alias("_ntok"),
    )
    return by_token.groupBy(*by).agg(
        F.sum("_rows").cast("bigint").alias("sample_count"),
        F.sum("_len").cast("bigint").alias("total_length"),
        F.sum("_short").cast("bigint").alias("empty_count"),
        F.sum("_ntok").cast("bigint").alias("total_tokens"),
        F.count("_tok").cast("bigint").alias("unique_tokens"),
    )


def diversity_score_expr(unique: Column, total: Column) -> Column:
    raw = F.when(total > 0, unique.cast("double") / total.cast("double")).otherwise(F.lit(0.0))
    return F.least(raw * F.lit(10.0), F.lit(1.0))


def default_check_columns(profile: DataFrame, th: TextThresholds | None = None) -> DataFrame:
    """Verdict columns of min_samples, avg_length, empty_ratio, diversity_score."""
    th = th or TextThresholds.defaults()
    n = F.col("sample_count")
    avg_len = F.when(n > 0, F.col("total_length").cast("double") / n.cast("double")).otherwise(F.lit(0.0))
    empty_ratio = safe_ratio(F.col("empty_count"), n)
    div = diversity_score_expr(F.col("unique_tokens"), F.col("total_tokens"))
    out = profile.select(
        "*",
        (n >= th.min_samples).alias("min_samples_passed"),
        avg_len.alias("avg_length"),
        empty_ratio.alias("empty_ratio"),
        div.alias("diversity_score"),
    )
    out = out.select(
        "*",
        ((F.col("avg_length") >= th.avg_min) & (F.col("avg_length") <= th.avg_max)).alias("avg_length_passed"),
        (F.col("empty_ratio") <= th.empty_max_ratio).alias("empty_ratio_passed"),
        (F.col("diversity_score") >= th.diversity_min).alias("diversity_passed"),
    )
    return out.withColumn(
        "passed",
        F.col("min_samples_passed") & F.col("avg_length_passed") & F.col("empty_ratio_passed") & F.col("diversity_passed"),
    )


def default_check_results(profile: DataFrame, by: list[str], th: TextThresholds | None = None) -> DataFrame:
    """Long result rows (one per dataset and check) with metrics, errors, warnings."""
    th = th or TextThresholds.defaults()
    v = default_check_columns(profile, th)
    n = F.col("sample_count")

    def row(check: str, passed: Column, metrics: dict, thresholds: dict, errors: list, warnings: list) -> Column:
        return F.struct(
            F.lit(check).alias("check"),
            F.lit(PRIORITY[check]).alias("priority"),
            passed.alias("passed"),
            F.create_map(*[x for k, c in metrics.items() for x in (F.lit(k), c.cast("double"))]).alias("metrics"),
            F.create_map(*[x for k, c in thresholds.items() for x in (F.lit(k), F.lit(float(c)))]).alias("thresholds"),
            F.array_compact(F.array(*errors, F.lit(None).cast("string"))).alias("errors"),
            F.array_compact(F.array(*warnings, F.lit(None).cast("string"))).alias("warnings"),
        )

    avg = F.col("avg_length")
    er = F.col("empty_ratio")
    div = F.col("diversity_score")
    rows = F.array(
        row(
            "min_samples", F.col("min_samples_passed"), {"sample_count": n}, {"threshold": th.min_samples},
            [F.when(~F.col("min_samples_passed"), F.format_string("Not enough examples: %d < %d", n, F.lit(th.min_samples)))],
            [],
        ),
        row(
            "avg_length", F.col("avg_length_passed"),
            {"avg_length": F.round(avg, 2), "samples_checked": n}, {"min": th.avg_min, "max": th.avg_max},
            [
                F.when(avg < th.avg_min, F.format_string("Average length too low: %.1f < %s", avg, F.lit(str(th.avg_min))))
                .when(avg > th.avg_max, F.format_string("Average length too high: %.1f > %s", avg, F.lit(str(th.avg_max))))
            ],
            [F.when(avg < th.avg_min * AVG_LENGTH_NEAR_FACTOR,
                    F.format_string("Average length is close to the minimum: %.1f (min: %s)", avg, F.lit(str(th.avg_min))))],
        ),
        row(
            "empty_ratio", F.col("empty_ratio_passed"),
            {"empty_ratio": F.round(er, 4), "empty_count": F.col("empty_count"), "total_checked": n},
            {"max_ratio": th.empty_max_ratio},
            [F.when(~F.col("empty_ratio_passed"), F.format_string("Too many empty examples: %.2f%% > %.2f%%", er * 100, F.lit(th.empty_max_ratio * 100)))],
            [F.when(F.col("empty_ratio_passed") & (er > 0.5 * th.empty_max_ratio),
                    F.format_string("Empty-example ratio is close to the threshold: %.2f%% (max: %.2f%%)", er * 100, F.lit(th.empty_max_ratio * 100)))],
        ),
        row(
            "diversity_score", F.col("diversity_passed"),
            {"diversity_score": F.round(div, 4), "unique_tokens": F.col("unique_tokens"),
             "total_tokens": F.col("total_tokens"), "samples_checked": n},
            {"min_score": th.diversity_min},
            [F.when(~F.col("diversity_passed"), F.format_string("Diversity score too low: %.2f < %s", div, F.lit(str(th.diversity_min))))],
            [F.when(div < th.diversity_min * DIVERSITY_NEAR_FACTOR,
                    F.format_string("Diversity score is close to the minimum: %.2f (min: %s)", div, F.lit(str(th.diversity_min))))],
        ),
    )
    return v.select(*by, F.inline(rows))


# ---------------------------------------------------------------------------
# deduplication
# ---------------------------------------------------------------------------
def text_hashes(samples: DataFrame, by: list[str], text: Column | None = None) -> DataFrame:
    txt = text if text is not None else py_str("text")
    return samples.select(*by, "row_idx", F.md5(txt).alias("text_md5"))


def dedup_stats(samples: DataFrame, by: list[str], text: Column | None = None, max_ratio: float = DEDUP_MAX_RATIO) -> DataFrame:
    """Per group: total, unique, duplicate count and ratio (md5 of the text)."""
    per_hash = text_hashes(samples, by, text).groupBy(*by, "text_md5").agg(F.count(F.lit(1)).alias("_n"))
    agg = per_hash.groupBy(*by).agg(
        F.sum("_n").cast("bigint").alias("total_checked"),
        F.count(F.lit(1)).cast("bigint").alias("unique_count"),
    )
    dup = F.col("total_checked") - F.col("unique_count")
    return agg.select(
        *by,
        "total_checked",
        "unique_count",
        dup.alias("duplicate_count"),
        safe_ratio(dup, F.col("total_checked")).alias("duplicate_ratio"),
    ).withColumn("passed", F.col("duplicate_ratio") <= max_ratio)


def duplicate_pairs(samples: DataFrame, by: list[str], text: Column | None = None) -> DataFrame:
    """Each duplicate row with the index of the first row holding the same text."""
    h = text_hashes(samples, by, text)
    first = h.groupBy(*by, "text_md5").agg(F.min("row_idx").alias("first_idx"), F.count(F.lit(1)).alias("_n"))
    first = first.where(F.col("_n") > 1).drop("_n")
    return (
        h.join(first, [*by, "text_md5"], "inner")
        .where(F.col("row_idx") != F.col("first_idx"))
        .select(*by, F.col("row_idx").alias("dup_idx"), "first_idx", "text_md5")
    )


# ---------------------------------------------------------------------------
# error groups
# ---------------------------------------------------------------------------
def error_groups(issues: DataFrame, by: list[str], max_examples: int = 5) -> DataFrame:
    """Group sample-level issues (``by + [error_type, row_idx]``) by type.

    Returns ``by, error_type, total_count, sample_indices`` with the first
    ``max_examples`` indices (0 -> empty list).  ``-1`` (all indices) gives the long
    table ``by, error_type, sample_index, total_count`` instead of unbounded arrays.
    """
    keys = [*by, "error_type"]
    totals = issues.groupBy(*keys).agg(F.count(F.lit(1)).cast("bigint").alias("total_count"))
    if max_examples == 0:
        return totals.withColumn("sample_indices", F.array().cast("array<bigint>"))
    if max_examples < 0:
        # all indices: the long table, one row per index
        rows = issues.select(*keys, F.col("row_idx").alias("sample_index"))
        return rows.join(totals, keys)
    w = Window.partitionBy(*keys).orderBy("row_idx")
    top = (
        issues.select(*keys, "row_idx")
        .withColumn("_rn", F.row_number().over(w))
        .where(F.col("_rn") <= max_examples)
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.col("row_idx").cast("bigint"))).alias("sample_indices"))
    )
    return totals.join(top, keys, "left")


# ---------------------------------------------------------------------------
# preference datasets
# ---------------------------------------------------------------------------
def identical_pair_flags(pairs: DataFrame) -> Column:
    return normalize_pair_text("chosen") == normalize_pair_text("rejected")


def identical_pairs_stats(pairs: DataFrame, by: list[str], max_ratio: float = IDENTICAL_MAX_RATIO) -> DataFrame:
    """identical / all rows (denominator is every row)."""
    if "chosen" not in pairs.columns or "rejected" not in pairs.columns:
        ident = F.lit(False)
    else:
        ident = identical_pair_flags(pairs)
    agg = pairs.groupBy(*by).agg(
        F.count(F.lit(1)).cast("bigint").alias("total_checked"),
        F.count_if(ident).cast("bigint").alias("identical_count"),
    )
    r = safe_ratio(F.col("identical_count"), F.col("total_checked"))
    return agg.select(*by, "total_checked", "identical_count", r.alias("identical_ratio")).withColumn(
        "passed", F.col("identical_ratio") <= max_ratio
    )


def preference_issue(pairs: DataFrame, required: tuple[str, ...] = ("chosen", "rejected")) -> Column:
    """First issue of a row: ``missing_field.<f>`` then ``invalid_type.<f>``.

    A column absent from the schema is missing for every row; a null value is
    an invalid type (it is neither str, dict nor list).
    """
    for f in required:
        if f not in pairs.columns:
            return F.lit(f"missing_field.{f}")
    expr = None
    for f in required:
        cond = F.col(f).isNull()
        expr = F.when(cond, F.lit(f"invalid_type.{f}")) if expr is None else expr.when(cond, F.lit(f"invalid_type.{f}"))
    return expr


def preference_format_stats(pairs: DataFrame, by: list[str], min_valid_ratio: float = PREF_MIN_VALID_RATIO) -> DataFrame:
    issue = preference_issue(pairs)
    agg = pairs.groupBy(*by).agg(
        F.count(F.lit(1)).cast("bigint").alias("total_checked"),
        F.count_if(issue.isNull()).cast("bigint").alias("valid_count"),
    )
    r = safe_ratio(F.col("valid_count"), F.col("total_checked"))
    return agg.select(
        *by,
        "total_checked",
        "valid_count",
        (F.col("total_checked") - F.col("valid_count")).alias("invalid_count"),
        r.alias("valid_ratio"),
    ).withColumn("passed", F.col("valid_ratio") >= min_valid_ratio)


def preference_issues(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Long table of sample-level preference issues (for ``error_groups``)."""
    return pairs.select(*by, "row_idx", preference_issue(pairs).alias("error_type")).where(F.col("error_type").isNotNull())
