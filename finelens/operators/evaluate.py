"""Model-answer evaluation: semantic match, syntax rules, judge replies,
score aggregation, rewards.

Everything but the Ratcliff-Obershelp ratio is a native expression.  The
ratio has no built-in; it runs in an Arrow ``pandas_udf`` over the
*distinct* (candidate, expected) pairs only, and the result is joined back.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from finelens.functions import query_text as Q
from finelens.session import spread

# ---------------------------------------------------------------------------
# fixed values that must equal the reference
# ---------------------------------------------------------------------------
SCORE_MIN, SCORE_MAX = 1, 5
DEFAULT_MIN_MEAN_SCORE = 0.6
SEMANTIC_SAMPLE_FAIL_BELOW = 0.7
SYNTAX_MIN_VALID_RATIO = 0.8
PRIORITY = {"eval_outcomes": 8, "eval_syntax": 10, "eval_semantic": 20, "eval_judge": 60}


@F.pandas_udf(T.DoubleType())
def sequence_ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    """``SequenceMatcher(a=a, b=b).ratio()`` (Python's default junk heuristic)."""
    out = []
    for x, y in zip(a, b):
        out.append(difflib.SequenceMatcher(a=x or "", b=y or "").ratio())
    return pd.Series(out, dtype="float64")


def score_label(score: Column, raw_score: Column) -> Column:
    """Label of an evaluated row: no score fails; a raw score is shown; else only a full score is OK."""
    shown = F.concat(F.lit("raw: "), raw_score.cast("string"), F.lit(f"/{SCORE_MAX}"))
    return F.when(score.isNull(), "FAILED").when(raw_score.isNotNull(), shown).when(score == 1.0, "OK").otherwise("FAILED")


def with_sequence_ratio(df: DataFrame, a: str, b: str, out: str = "sequence_ratio") -> DataFrame:
    """Attach the ratio of columns ``a`` and ``b``, computed once per distinct pair."""
    pairs = df.select(F.col(a).alias("_a"), F.col(b).alias("_b")).distinct()
    n = max(df.sparkSession.sparkContext.defaultParallelism, 1)
    scored = pairs.repartition(n, "_a", "_b").select("_a", "_b", sequence_ratio_udf("_a", "_b").alias(out))
    return df.join(scored, (F.col(a).eqNullSafe(F.col("_a"))) & (F.col(b).eqNullSafe(F.col("_b"))), "left").drop("_a", "_b")


def semantic_match(samples: DataFrame, candidate: str = "model_answer", expected: str = "expected_answer",
                   user_text: str = "question") -> DataFrame:
    """Per-sample semantic match details (score clamped to [0, 1], exact -> 1)."""
    cn = Q.normalize_query_text(candidate)
    en = Q.normalize_query_text(expected)
    base = spread(samples).select(
        "*",
        cn.alias("_cn"),
        en.alias("_en"),
        F.lower(cn).alias("_cl"),
        F.lower(en).alias("_el"),
        Q.hard_eval_errors(F.col(user_text), F.col(candidate)).alias("_errs"),
    )
    base = with_sequence_ratio(base, "_cl", "_el", "_seq")
    blank = (F.col("_cn") == "") | (F.col("_en") == "")
    exact = F.col("_cn") == F.col("_en")
    jac = Q.token_jaccard(F.col("_cl"), F.col("_el"))
    penalty = F.least(F.lit(Q.PENALTY_MAX), F.lit(Q.PENALTY_PER_ERROR) * F.size("_errs"))
    raw = F.lit(Q.W_SEQUENCE) * F.col("_seq") + F.lit(Q.W_JACCARD) * jac + F.when(exact, F.lit(Q.W_EXACT)).otherwise(F.lit(0.0))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw - penalty))
    hard_pass = F.size("_errs") == 0
    out = base.select(
        *samples.columns,
        F.when(blank, F.lit(0.0)).when(exact, F.lit(1.0)).otherwise(score).alias("score"),
        F.when(blank, F.lit(False)).otherwise(exact).alias("exact_match"),
        F.when(blank, F.lit(False)).when(exact, F.lit(True)).otherwise((score >= Q.NEAR_MATCH) & hard_pass).alias("near_match"),
        F.when(blank, F.lit(0.0)).otherwise(F.col("_seq")).alias("sequence_ratio"),
        F.when(blank, F.lit(0.0)).otherwise(jac).alias("token_jaccard"),
        F.when(blank, F.lit(False)).otherwise(hard_pass).alias("hard_eval_pass"),
        F.when(blank, F.array(F.lit("empty_candidate_or_expected"))).otherwise(F.col("_errs")).alias("hard_eval_errors"),
    )
    return out


def raw_score_from_unit(score: Column) -> Column:
    """``max(1, min(5, round(score * 5)))`` with Python's half-even rounding."""
    return F.greatest(F.lit(SCORE_MIN), F.least(F.lit(SCORE_MAX), F.bround(score * 5, 0).cast("int")))


def aggregate_scores(scored: DataFrame, by: list[str], score: str = "score", raw: str = "raw_score",
                     failed: Column | None = None, min_mean: float = DEFAULT_MIN_MEAN_SCORE) -> DataFrame:
    """mean, interpolated p50, 1..5 distribution, verdict.  ``failed`` rows
    (unscorable) are counted apart and excluded from the statistics."""
    failed = failed if failed is not None else F.lit(False)
    ok = ~failed
    dist = [F.count_if(ok & (F.col(raw) == i)).cast("bigint").alias(f"score_{i}") for i in range(SCORE_MIN, SCORE_MAX + 1)]
    agg = scored.groupBy(*by).agg(
        F.count_if(ok).cast("bigint").alias("sample_count"),
        F.count_if(failed).cast("bigint").alias("failed_count"),
        F.avg(F.when(ok, F.col(score))).alias("_mean"),
        F.percentile(F.when(ok, F.col(score)), F.lit(0.5)).alias("_p50"),
        *dist,
    )
    mean = F.coalesce(F.col("_mean"), F.lit(0.0))
    return agg.select(
        *by,
        "sample_count",
        "failed_count",
        mean.alias("mean_score"),
        F.coalesce(F.col("_p50"), F.lit(0.0)).alias("p50_score"),
        *[f"score_{i}" for i in range(SCORE_MIN, SCORE_MAX + 1)],
        F.when(F.col("sample_count") == 0, F.lit(True)).otherwise(mean >= min_mean).alias("passed"),
    )


# ---------------------------------------------------------------------------
# judge replies
# ---------------------------------------------------------------------------
def judge_score(raw: Column) -> Column:
    """Integer score of a judge reply: JSON, else the first ``{...}`` as JSON,
    else a ``"score": n`` pattern (1..5); clamped to 1..5; null if none."""

    def numeric_score(v: Column) -> Column:
        sv = F.try_variant_get(v, "$.score", "variant")
        typ = F.schema_of_variant(sv)
        is_num = typ.rlike("^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)")
        return F.when(is_num, F.try_variant_get(v, "$.score", "double"))

    whole = F.try_parse_json(raw)
    first_obj = F.try_parse_json(F.nullif(F.regexp_extract(raw, r"\{[^}]+\}", 0), F.lit("")))
    parsed_score = F.coalesce(
        F.when(whole.isNotNull(), numeric_score(whole)),
        F.when(whole.isNull() & first_obj.isNotNull(), numeric_score(first_obj)),
    )
    # int() truncates toward zero
    as_int = F.when(parsed_score.isNotNull(), F.when(parsed_score < 0, F.ceil(parsed_score)).otherwise(F.floor(parsed_score)))
    fallback = F.nullif(F.regexp_extract(raw, r'"score"\s*:\s*([1-5])', 1), F.lit("")).cast("bigint")
    s = F.coalesce(as_int.cast("bigint"), fallback)
    return F.when(s.isNotNull(), F.greatest(F.lit(SCORE_MIN), F.least(F.lit(SCORE_MAX), s)))
