"""Metric time-series analytics: trends, index-rule percentiles, verdicts,
phase slices and the nearest-point (as-of) fallback.

Scale notes
-----------
* ``trend`` is a single aggregation (``min_by``/``max_by`` on ``seq``) with
  map-side partial aggregation: no window, no sort of a run's series.
* ``index_percentiles`` is exact without sorting a whole group in one task:
  a mergeable ``percentile_approx`` sketch brackets the target rank with a
  narrow value band, one counting pass gives the exact rank offset below
  the band, and only the rows inside the band are ranked.  Groups whose band
  misses the rank (not expected, but possible with ties) fall back to the
  whole group.  The per-group bound tables are small; AQE broadcasts them
  when their measured size allows, else they are shuffled-joined (with
  skew-join splitting of a hot group's rows).
* ``slice_by_phase`` is a range join expressed as an equi-join on
  ``(run, time bucket)``: each phase is expanded to the buckets it covers,
  each point falls in exactly one, so the candidate set stays linear.
* ``slice_nearest`` looks only at the three 30-second buckets around the
  phase centre, which contain every point closer than 30 s; ties take the
  earliest sequence number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finelens.functions.text import fixed

# ---------------------------------------------------------------------------
# fixed values that must equal the reference
# ---------------------------------------------------------------------------
TREND_BAND_PCT = 5.0  # direction changes only beyond +-5 %
WARMUP_MARGIN = 1.1
KL_THRESHOLD = 10.0
GRAD_NORM_WARNING = 10.0
LOSS_SIGNIFICANT_INCREASE = 5.0
LOSS_VOLATILITY_RATIO = 10.0
PFLOP_SCALE, TFLOP_SCALE, GFLOP_SCALE = 1e15, 1e12, 1e9
NEAREST_CAP_MS = 30_000
PERCENTILES = (0.95, 0.99)
DIR_STABLE, DIR_DECREASED, DIR_INCREASED = "Stable", "decreased", "increased"


# ---------------------------------------------------------------------------
# trend
# ---------------------------------------------------------------------------
def trend(points: DataFrame, by: list[str], value: str = "value", order: str = "seq") -> DataFrame:
    """first, last (by ``order``), min, max, change_pct, direction, points."""
    agg = points.groupBy(*by).agg(
        F.min_by(value, order).alias("first"),
        F.max_by(value, order).alias("last"),
        F.min(value).alias("min_val"),
        F.max(value).alias("max_val"),
        F.count(F.lit(1)).cast("bigint").alias("data_points"),
    )
    return agg.select("*", *_trend_cols())


def _trend_cols() -> list[Column]:
    first, last = F.col("first"), F.col("last")
    change = F.when(first != 0, (last - first) / first * F.lit(100.0)).otherwise(F.lit(0.0))
    direction = (
        F.when(change < -TREND_BAND_PCT, F.lit(DIR_DECREASED))
        .when(change > TREND_BAND_PCT, F.lit(DIR_INCREASED))
        .otherwise(F.lit("stable"))
    )
    return [change.alias("change_pct"), direction.alias("direction")]


# ---------------------------------------------------------------------------
# verdicts
# ---------------------------------------------------------------------------
def _fmt(pattern: str, x: Column) -> Column:
    return fixed(x, int(pattern[2:-1]))


def verdict(key: Column, tr: dict[str, Column]) -> tuple[Column, Column]:
    """(status, verdict) of a metric from its trend; dispatch by key substring in order.

    The verdict texts and the order of the families are fixed values: both must equal the reference's.
    """
    k = F.lower(key)
    d = tr["direction"]
    first, last, mn, mx, ch = tr["first"], tr["last"], tr["min_val"], tr["max_val"], tr["change_pct"]
    inc, dec = d == DIR_INCREASED, d == DIR_DECREASED

    # loss: down good; small rise warning; big rise bad; spikes not at start -> volatility
    loss_status = F.when(dec, "GOOD").when(inc & (ch < LOSS_SIGNIFICANT_INCREASE), "WARNING").when(inc, "BAD").otherwise("NEUTRAL")
    loss_text = (
        F.when(dec, F.concat(F.lit("Improved by "), _fmt("%.1f", F.abs(ch)), F.lit("%")))
        .when(inc & (ch < LOSS_SIGNIFICANT_INCREASE), F.lit("Small increase (noise?)"))
        .when(inc, F.lit("Degradation"))
        .otherwise(F.lit(DIR_STABLE))
    )
    volatile = (
        mx.isNotNull() & mn.isNotNull() & (mn > 0) & ((mx / mn) > LOSS_VOLATILITY_RATIO)
        & ~(first.isNotNull() & (mx <= first * WARMUP_MARGIN))
    )
    loss_status = F.when(volatile, F.lit("WARNING")).otherwise(loss_status)
    loss_text = F.when(volatile, F.concat(loss_text, F.lit(" (high volatility)"))).otherwise(loss_text)

    flops = (
        F.when(last.isNull(), F.lit("N/A"))
        .when(last >= PFLOP_SCALE, F.concat(_fmt("%.2f", last / PFLOP_SCALE), F.lit(" PFLOPs")))
        .when(last >= TFLOP_SCALE, F.concat(_fmt("%.2f", last / TFLOP_SCALE), F.lit(" TFLOPs")))
        .when(last >= GFLOP_SCALE, F.concat(_fmt("%.2f", last / GFLOP_SCALE), F.lit(" GFLOPs")))
        .otherwise(F.concat(_fmt("%.0f", last), F.lit(" FLOPs")))
    )
    rules: list[tuple[Column, Column, Column]] = [
        (k.contains("loss"), loss_status, loss_text),
        (
            k.contains("accuracy") | k.contains("accuracies"),
            F.when(inc, "GOOD").when(dec, "BAD").otherwise("NEUTRAL"),
            F.when(inc, "Improving").when(dec, "Worsening").otherwise(DIR_STABLE),
        ),
        (
            k.contains("grad_norm"),
            F.when(mx.isNull() | first.isNull(), "NEUTRAL").when(mx > first * GRAD_NORM_WARNING, "WARNING").otherwise("GOOD"),
            F.when(mx.isNull() | first.isNull(), "Insufficient data").when(mx > first * GRAD_NORM_WARNING, "Spikes detected")
            .otherwise("Stable gradients"),
        ),
        (k.contains("learning_rate"), F.lit("NEUTRAL"), F.lit("Follows schedule")),
        (
            k.contains("per_second"),
            F.lit("NEUTRAL"),
            F.when(last.isNull(), "N/A").otherwise(F.concat(F.lit("~"), _fmt("%.1f", last), F.lit(" samples/sec"))),
        ),
        (
            k.contains("entropy"),
            F.when(dec, "GOOD").when(inc, "WARNING").otherwise("NEUTRAL"),
            F.when(dec, "Model becoming more confident").when(inc, "Rising model uncertainty").otherwise("Stable confidence"),
        ),
        (k.contains("flos"), F.lit("NEUTRAL"), flops),
        (
            k.contains("margin"),
            F.when(inc, "GOOD").when(dec, "WARNING").otherwise("NEUTRAL"),
            F.when(inc, "Margin increasing (confidence)").when(dec, "Margin decreasing").otherwise(DIR_STABLE),
        ),
        (
            k.contains("reward"),
            F.when(inc, "GOOD").when(dec, "BAD").otherwise("NEUTRAL"),
            F.when(inc, "Reward increasing (training progressing)").when(dec, "Reward decreasing (degradation)")
            .otherwise("Stable reward"),
        ),
        (
            k.contains("kl"),
            F.when(mx.isNotNull() & (mx > KL_THRESHOLD), "WARNING").when(inc, "NEUTRAL").otherwise("GOOD"),
            F.when(mx.isNotNull() & (mx > KL_THRESHOLD), "High divergence (mode collapse risk)")
            .when(inc, "Divergence increasing (normal)").otherwise(DIR_STABLE),
        ),
        (
            k.contains("length"),
            F.lit("NEUTRAL"),
            F.when(last.isNull(), "N/A").otherwise(F.concat(F.lit("~"), _fmt("%.0f", last), F.lit(" tokens"))),
        ),
        (
            k.contains("logp"),
            F.when(k.contains("chosen") & dec, "NEUTRAL").when(k.contains("rejected") & dec, "GOOD").otherwise("NEUTRAL"),
            F.when(k.contains("chosen") & dec, "Decreasing (expected for DPO)")
            .when(k.contains("rejected") & dec, "Model picks rejected less often").otherwise(DIR_STABLE),
        ),
    ]
    status = F.lit("NEUTRAL")
    text = F.lit(DIR_STABLE)
    for cond, s, t in reversed(rules):
        status = F.when(cond, s).otherwise(status)
        text = F.when(cond, t).otherwise(text)
    return status, text


def metric_verdicts(trends: DataFrame, key: str = "key") -> DataFrame:
    cols = {c: F.col(c) for c in ("direction", "first", "last", "min_val", "max_val", "change_pct")}
    status, text = verdict(F.col(key), cols)
    return trends.select("*", status.alias("status"), text.alias("verdict"))


# ---------------------------------------------------------------------------
# exact index-rule percentiles
# ---------------------------------------------------------------------------
def index_percentiles(
    points: DataFrame,
    by: list[str],
    value: str = "value",
    ps: tuple[float, ...] = PERCENTILES,
    accuracy: int = 100_000,
) -> DataFrame:
    """avg, min, max, n and ``sorted(v)[min(int(n*p), n-1)]`` for each p.

    Exact, and no task ever sorts more than the narrow band around the target
    rank of one group (see module notes).
    """
    base = points.select(*by, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    eps = 3.0 / accuracy
    qs: list[float] = []
    for p in ps:
        qs += [max(p - eps, 0.0), min(p + eps, 1.0)]
    stats = base.groupBy(*by).agg(
        F.count(F.lit(1)).cast("bigint").alias("n"),
        F.avg("_v").alias("avg"),
        F.min("_v").alias("min_val"),
        F.max("_v").alias("max_val"),
        F.percentile_approx("_v", qs, accuracy).alias("_q"),
    )
    # one bound row per (group, p)
    bounds = stats.select(
        *by,
        "n",
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(i).alias("pi"),
                        F.least(F.floor(F.col("n") * F.lit(p)), F.col("n") - 1).cast("bigint").alias("k"),
                        F.col("_q")[2 * i].alias("lo"),
                        F.col("_q")[2 * i + 1].alias("hi"),
                    )
                    for i, p in enumerate(ps)
                ]
            )
        ).alias("b"),
    ).select(*by, "n", "b.*")
    # exact rank offset below the band, and band size
    counted = (
        base.join(bounds, by)
        .groupBy(*by, "pi")
        .agg(
            F.count_if(F.col("_v") < F.col("lo")).alias("below"),
            F.count_if((F.col("_v") >= F.col("lo")) & (F.col("_v") <= F.col("hi"))).alias("inside"),
        )
    )
    ok = (F.col("below") <= F.col("k")) & (F.col("k") < F.col("below") + F.col("inside"))
    band = bounds.join(counted, [*by, "pi"]).select(
        *by,
        "pi",
        F.when(ok, F.col("lo")).alias("lo"),
        F.when(ok, F.col("hi")).alias("hi"),
        (F.col("k") - F.when(ok, F.col("below")).otherwise(F.lit(0))).alias("r"),
    )
    in_band = base.join(band, by).where(
        (F.col("lo").isNull() | (F.col("_v") >= F.col("lo"))) & (F.col("hi").isNull() | (F.col("_v") <= F.col("hi")))
    )
    # equal values are counted, not ranked: what a window sorts are the distinct values of a band
    values = in_band.groupBy(*by, "pi", "_v").agg(F.count(F.lit(1)).alias("_c"), F.any_value("r").alias("r"))
    w = Window.partitionBy(*by, "pi").orderBy("_v")
    picked = (
        values.withColumn("_upto", F.sum("_c").over(w))
        .where((F.col("_upto") > F.col("r")) & (F.col("_upto") - F.col("_c") <= F.col("r")))
        .groupBy(*by)
        .pivot("pi", list(range(len(ps))))
        .agg(F.first("_v"))
    )
    names = [f"p{int(round(p * 100))}" for p in ps]
    picked = picked.select(*by, *[F.col(str(i)).alias(n) for i, n in enumerate(names)])
    return stats.drop("_q").join(picked, by, "left").select(
        *by, "avg", "min_val", "max_val", *names, F.col("n").alias("data_points")
    )


# ---------------------------------------------------------------------------
# phase slices
# ---------------------------------------------------------------------------
def closed(phases: DataFrame, as_of_ms: int | None = None) -> DataFrame:
    """Started phases; one that still runs (null ``end_ms``) ends at ``as_of_ms``, by default now."""
    now = F.lit(as_of_ms).cast("bigint") if as_of_ms is not None else F.unix_millis(F.current_timestamp())
    end = F.greatest("start_ms", F.coalesce("end_ms", now))
    return phases.where(F.col("start_ms").isNotNull()).withColumn("end_ms", end)


def slice_by_phase(
    points: DataFrame, phases: DataFrame, run: str = "run_id", bucket_ms: int = 3_600_000, as_of_ms: int | None = None
) -> DataFrame:
    """Points with ``start_ms <= ts_ms <= end_ms`` of a phase of the same run.

    ``phases``: run, phase_idx, start_ms, end_ms (null start -> no slice, null end -> still running).
    Range join as an equi-join on (run, bucket).
    """
    ph = closed(phases, as_of_ms).select(
        run,
        "phase_idx",
        "start_ms",
        "end_ms",
        F.explode(F.sequence(F.floor(F.col("start_ms") / bucket_ms), F.floor(F.col("end_ms") / bucket_ms))).alias("_b"),
    )
    pts = points.withColumn("_b", F.floor(F.col("ts_ms") / bucket_ms))
    return (
        pts.join(ph, [run, "_b"])
        .where((F.col("ts_ms") >= F.col("start_ms")) & (F.col("ts_ms") <= F.col("end_ms")))
        .select(run, "phase_idx", "key", "step", "ts_ms", "value", "seq")
    )


def slice_nearest(
    points: DataFrame, phases: DataFrame, run: str = "run_id", cap_ms: int = NEAREST_CAP_MS, as_of_ms: int | None = None
) -> DataFrame:
    """For (phase, key) pairs with no point inside the phase: the point of the
    run's key series nearest to the phase centre, if closer than ``cap_ms``.
    Ties take the earliest ``seq``."""
    keys = points.select(run, "key").distinct()
    ph = closed(phases, as_of_ms)
    pairs = ph.join(keys, run)
    inside = slice_by_phase(points, ph, run).select(run, "phase_idx", "key").distinct()
    empty = pairs.join(inside, [run, "phase_idx", "key"], "left_anti")
    centre = (F.col("start_ms") + F.col("end_ms")) / F.lit(2.0)
    q = empty.select(run, "phase_idx", "key", centre.alias("centre")).withColumn(
        "_b", F.explode(F.sequence(F.floor(F.col("centre") / cap_ms) - 1, F.floor(F.col("centre") / cap_ms) + 1))
    )
    pts = points.select(run, "key", "step", "ts_ms", "value", "seq", F.floor(F.col("ts_ms") / cap_ms).alias("_b"))
    cand = q.join(pts, [run, "key", "_b"]).withColumn("distance_ms", F.abs(F.col("ts_ms") - F.col("centre")))
    cand = cand.where(F.col("distance_ms") < cap_ms)
    best = cand.groupBy(run, "phase_idx", "key").agg(
        F.min_by(F.struct("step", "ts_ms", "value", "seq", "distance_ms"), F.struct("distance_ms", "seq")).alias("p")
    )
    return best.select(run, "phase_idx", "key", "p.*")


def phase_resource_fill(points: DataFrame, phases: DataFrame, run: str = "run_id", as_of_ms: int | None = None) -> DataFrame:
    """Series of each (phase, key): the points inside the phase, else the nearest one."""
    phases = closed(phases, as_of_ms)
    inside = slice_by_phase(points, phases, run).withColumn("source", F.lit("slice"))
    near = slice_nearest(points, phases, run).drop("distance_ms").withColumn("source", F.lit("nearest"))
    return inside.unionByName(near)
