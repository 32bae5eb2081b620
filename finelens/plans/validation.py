"""Dataset-validation jobs on the driver tables.

Text dataset = ``documents`` (dataset = ``source``, ``row_idx = doc_id``).
Preference dataset = each document paired with the document that follows it
in ``doc_id`` order (an equi-join on a unique key, so no skew): ``chosen`` is
the document, ``rejected`` the next one; copies are injected where
``doc_id % 97 = 0`` and nulls where ``doc_id % 53 = 0`` so the checks have
failures to find.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finelens.functions.text import extract_text, py_str
from finelens.operators import checks as C
from finelens.plans.registry import job
from finelens.sources.tables import Tables

BY = ["dataset"]


def preference_pairs(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", "source", "text")
    nxt = t.documents.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("_next"))
    j = d.join(nxt, "doc_id", "left")
    rejected = (
        F.when(F.col("doc_id") % 53 == 0, F.lit(None).cast("string"))
        .when(F.col("doc_id") % 97 == 0, F.col("text"))
        .otherwise(F.col("_next"))
    )
    return j.select(
        F.col("source").alias("dataset"),
        F.col("doc_id").alias("row_idx"),
        F.col("text").alias("chosen"),
        rejected.alias("rejected"),
    )


PAIRS_SQL = """
pairs AS (
  SELECT d.source AS dataset, d.doc_id AS row_idx, d.text AS chosen,
         CASE WHEN d.doc_id % 53 = 0 THEN NULL
              WHEN d.doc_id % 97 = 0 THEN d.text
              ELSE n.text END AS rejected
  FROM documents d LEFT JOIN documents n ON n.doc_id = d.doc_id + 1
)"""

# fused profile in SQL: the oracle computes the same numbers with separate
# aggregates and DISTINCT.
PROFILE_SQL = """
docs AS (SELECT source AS dataset, doc_id AS row_idx, coalesce(text, 'None') AS t FROM documents),
prof AS (
  SELECT dataset, count(*) AS sample_count, sum(length(t)) AS total_length,
         count(*) FILTER (WHERE length(regexp_replace(t, '^@WS@+|@WS@+$', '', 'g')) < 10) AS empty_count
  FROM docs GROUP BY dataset),
toks AS (
  SELECT dataset, tok FROM (
    SELECT dataset, unnest(regexp_split_to_array(lower(t), '@WS@+')) AS tok FROM docs) WHERE tok <> ''),
tstat AS (SELECT dataset, count(*) AS total_tokens, count(DISTINCT tok) AS unique_tokens FROM toks GROUP BY dataset),
p AS (
  SELECT prof.dataset, CAST(sample_count AS BIGINT) AS sample_count, CAST(total_length AS BIGINT) AS total_length,
         CAST(empty_count AS BIGINT) AS empty_count,
         CAST(coalesce(total_tokens, 0) AS BIGINT) AS total_tokens, CAST(coalesce(unique_tokens, 0) AS BIGINT) AS unique_tokens,
         CASE WHEN sample_count > 0 THEN CAST(total_length AS DOUBLE) / sample_count ELSE 0.0 END AS avg_length,
         CASE WHEN sample_count = 0 THEN 0.0 ELSE CAST(empty_count AS DOUBLE) / sample_count END AS empty_ratio,
         least(CASE WHEN coalesce(total_tokens, 0) > 0 THEN CAST(unique_tokens AS DOUBLE) / total_tokens ELSE 0.0 END * 10.0, 1.0)
           AS diversity_score
  FROM prof LEFT JOIN tstat USING (dataset))"""


def _profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return C.text_profile(t.text_samples, BY)


@job(
    "default_checks",
    sql="WITH " + PROFILE_SQL + """
SELECT dataset, sample_count, total_length, empty_count, total_tokens, unique_tokens,
       sample_count >= 100 AS min_samples_passed, avg_length, empty_ratio, diversity_score,
       avg_length >= 50 AND avg_length <= 8192 AS avg_length_passed,
       empty_ratio <= 0.05 AS empty_ratio_passed,
       diversity_score >= 0.3 AS diversity_passed,
       sample_count >= 100 AND avg_length >= 50 AND avg_length <= 8192 AND empty_ratio <= 0.05
         AND diversity_score >= 0.3 AS passed
FROM p""",
)
def default_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """min_samples 100, avg_length 50..8192, empty_ratio 0.05, diversity 0.3 in one fused scan."""
    return C.default_check_columns(_profile(spark, sf_dir))


@job(
    "min_samples",
    sql="""SELECT source AS dataset, CAST(count(*) AS BIGINT) AS sample_count, count(*) >= 100 AS passed
FROM documents GROUP BY source""",
)
def min_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    n = F.count(F.lit(1)).cast("bigint")
    return t.text_samples.groupBy(*BY).agg(n.alias("sample_count")).withColumn(
        "passed", F.col("sample_count") >= C.MIN_SAMPLES_THRESHOLD
    )


@job(
    "avg_length",
    sql="""SELECT source AS dataset, CAST(count(*) AS BIGINT) AS samples_checked,
  CAST(sum(length(coalesce(text, 'None'))) AS DOUBLE) / count(*) AS avg_length,
  CAST(sum(length(coalesce(text, 'None'))) AS DOUBLE) / count(*) BETWEEN 50 AND 8192 AS passed,
  CAST(sum(length(coalesce(text, 'None'))) AS DOUBLE) / count(*) < 50 * 1.2 AS near_minimum
FROM documents GROUP BY source""",
)
def avg_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    s = t.text_samples.groupBy(*BY).agg(
        F.count(F.lit(1)).cast("bigint").alias("samples_checked"),
        F.sum(F.length(py_str("text"))).cast("double").alias("_sum"),
    )
    avg = F.when(F.col("samples_checked") > 0, F.col("_sum") / F.col("samples_checked")).otherwise(F.lit(0.0))
    return s.select(
        *BY,
        "samples_checked",
        avg.alias("avg_length"),
        avg.between(C.AVG_LENGTH_MIN, C.AVG_LENGTH_MAX).alias("passed"),
        (avg < C.AVG_LENGTH_MIN * C.AVG_LENGTH_NEAR_FACTOR).alias("near_minimum"),
    )


@job(
    "empty_ratio",
    sql="""SELECT dataset, total_checked, empty_count, ratio AS empty_ratio, ratio <= 0.1 AS passed,
  ratio <= 0.1 AND ratio > 0.5 * 0.1 AS near_threshold, ratio > 0.2 AS critical
FROM (
  SELECT source AS dataset, CAST(count(*) AS BIGINT) AS total_checked,
    CAST(count(*) FILTER (WHERE length(regexp_replace(coalesce(text, 'None'), '^@WS@+|@WS@+$', '', 'g')) < 10) AS BIGINT) AS empty_count,
    CAST(count(*) FILTER (WHERE length(regexp_replace(coalesce(text, 'None'), '^@WS@+|@WS@+$', '', 'g')) < 10) AS DOUBLE)
      / count(*) AS ratio
  FROM documents GROUP BY source)""",
)
def empty_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    from finelens.functions.text import py_strip_length

    t = Tables(spark, sf_dir)
    short = py_strip_length(py_str("text")) < C.EMPTY_MIN_CHARS
    s = t.text_samples.groupBy(*BY).agg(
        F.count(F.lit(1)).cast("bigint").alias("total_checked"),
        F.count_if(short).cast("bigint").alias("empty_count"),
    )
    r = C.safe_ratio(F.col("empty_count"), F.col("total_checked"))
    mx = C.EMPTY_MAX_RATIO
    return s.select(
        *BY,
        "total_checked",
        "empty_count",
        r.alias("empty_ratio"),
        (r <= mx).alias("passed"),
        ((r <= mx) & (r > 0.5 * mx)).alias("near_threshold"),
        (r > C.EMPTY_CRITICAL).alias("critical"),
    )


@job(
    "diversity_score",
    sql="WITH " + PROFILE_SQL + """
SELECT dataset, unique_tokens, total_tokens, sample_count AS samples_checked, diversity_score,
  diversity_score >= 0.7 AS passed, diversity_score < 0.7 * 1.1 AS near_minimum, diversity_score < 0.3 AS critical
FROM p""",
)
def diversity_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact distinct tokens: two-phase (dataset, token) aggregation, never a set on one task."""
    p = _profile(spark, sf_dir)
    div = C.diversity_score_expr(F.col("unique_tokens"), F.col("total_tokens"))
    return p.select(
        *BY,
        "unique_tokens",
        "total_tokens",
        F.col("sample_count").alias("samples_checked"),
        div.alias("diversity_score"),
        (div >= C.DIVERSITY_MIN_SCORE).alias("passed"),
        (div < C.DIVERSITY_MIN_SCORE * C.DIVERSITY_NEAR_FACTOR).alias("near_minimum"),
        (div < C.DIVERSITY_CRITICAL).alias("critical"),
    )


@job(
    "deduplication",
    sql="""SELECT dataset, total_checked, unique_count, total_checked - unique_count AS duplicate_count,
  CASE WHEN total_checked = 0 THEN 0.0 ELSE CAST(total_checked - unique_count AS DOUBLE) / total_checked END AS duplicate_ratio,
  CASE WHEN total_checked = 0 THEN 0.0 ELSE CAST(total_checked - unique_count AS DOUBLE) / total_checked END <= 0.1 AS passed
FROM (SELECT source AS dataset, CAST(count(*) AS BIGINT) AS total_checked,
             CAST(count(DISTINCT md5(coalesce(text, 'None'))) AS BIGINT) AS unique_count
      FROM documents GROUP BY source)""",
)
def deduplication(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return C.dedup_stats(t.text_samples, BY)


@job(
    "duplicate_pairs",
    sql="""WITH h AS (SELECT source AS dataset, doc_id AS row_idx, md5(coalesce(text, 'None')) AS text_md5 FROM documents),
f AS (SELECT dataset, text_md5, min(row_idx) AS first_idx FROM h GROUP BY dataset, text_md5 HAVING count(*) > 1)
SELECT h.dataset, h.row_idx AS dup_idx, f.first_idx, h.text_md5
FROM h JOIN f USING (dataset, text_md5) WHERE h.row_idx <> f.first_idx""",
)
def duplicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return C.duplicate_pairs(t.text_samples, BY)


@job(
    "identical_pairs",
    sql="WITH " + PAIRS_SQL + """
SELECT dataset, total_checked, identical_count, identical_ratio, identical_ratio <= 0.01 AS passed
FROM (SELECT dataset, CAST(count(*) AS BIGINT) AS total_checked,
  CAST(count(*) FILTER (WHERE lower(regexp_replace(coalesce(chosen, 'None'), '^@WS@+|@WS@+$', '', 'g'))
                            = lower(regexp_replace(coalesce(rejected, 'None'), '^@WS@+|@WS@+$', '', 'g'))) AS BIGINT) AS identical_count,
  CAST(count(*) FILTER (WHERE lower(regexp_replace(coalesce(chosen, 'None'), '^@WS@+|@WS@+$', '', 'g'))
                            = lower(regexp_replace(coalesce(rejected, 'None'), '^@WS@+|@WS@+$', '', 'g'))) AS DOUBLE) / count(*) AS identical_ratio
  FROM pairs GROUP BY dataset)""",
)
def identical_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.identical_pairs_stats(preference_pairs(Tables(spark, sf_dir)), BY)


@job(
    "preference_format",
    sql="WITH " + PAIRS_SQL + """
SELECT dataset, total_checked, valid_count, total_checked - valid_count AS invalid_count,
  CAST(valid_count AS DOUBLE) / total_checked AS valid_ratio, CAST(valid_count AS DOUBLE) / total_checked >= 0.95 AS passed
FROM (SELECT dataset, CAST(count(*) AS BIGINT) AS total_checked,
             CAST(count(*) FILTER (WHERE chosen IS NOT NULL AND rejected IS NOT NULL) AS BIGINT) AS valid_count
      FROM pairs GROUP BY dataset)""",
)
def preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.preference_format_stats(preference_pairs(Tables(spark, sf_dir)), BY)


@job(
    "error_groups",
    sql="WITH " + PAIRS_SQL + """,
docs AS (SELECT source AS dataset, doc_id AS row_idx, coalesce(text, 'None') AS t FROM documents),
h AS (SELECT dataset, row_idx, md5(t) AS m FROM docs),
f AS (SELECT dataset, m, min(row_idx) AS first_idx FROM h GROUP BY dataset, m),
issues AS (
  SELECT dataset, row_idx, 'short_text' AS error_type FROM docs
    WHERE length(regexp_replace(t, '^@WS@+|@WS@+$', '', 'g')) < 10
  UNION ALL
  SELECT h.dataset, h.row_idx, 'duplicate' FROM h JOIN f USING (dataset, m) WHERE h.row_idx <> f.first_idx
  UNION ALL
  SELECT dataset, row_idx, CASE WHEN chosen IS NULL THEN 'invalid_type.chosen' ELSE 'invalid_type.rejected' END
    FROM pairs WHERE chosen IS NULL OR rejected IS NULL
  UNION ALL
  SELECT dataset, row_idx, 'identical_pair' FROM pairs
    WHERE lower(regexp_replace(coalesce(chosen, 'None'), '^@WS@+|@WS@+$', '', 'g'))
        = lower(regexp_replace(coalesce(rejected, 'None'), '^@WS@+|@WS@+$', '', 'g'))
)
SELECT dataset, error_type, CAST(count(*) AS BIGINT) AS total_count,
       array_to_string(list_sort(list(row_idx ORDER BY row_idx)[1:5]), ',') AS sample_indices
FROM issues GROUP BY dataset, error_type""",
)
def error_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample-level issues of the text and preference checks grouped by type, first 5 indices."""
    from finelens.functions.text import py_strip_length

    t = Tables(spark, sf_dir)
    s = t.text_samples
    short = s.where(py_strip_length(py_str("text")) < C.EMPTY_MIN_CHARS).select(
        *BY, "row_idx", F.lit("short_text").alias("error_type")
    )
    dups = C.duplicate_pairs(s, BY).select(*BY, F.col("dup_idx").alias("row_idx"), F.lit("duplicate").alias("error_type"))
    pairs = preference_pairs(t)
    pref = C.preference_issues(pairs, BY)
    ident = pairs.where(C.identical_pair_flags(pairs)).select(*BY, "row_idx", F.lit("identical_pair").alias("error_type"))
    issues = short.unionByName(dups).unionByName(pref).unionByName(ident)
    g = C.error_groups(issues, BY, max_examples=5)
    return g.select(*BY, "error_type", "total_count", F.array_join("sample_indices", ",").alias("sample_indices"))


@job(
    "extract_text",
    sql="""SELECT conv_id AS row_idx,
  array_to_string(list(coalesce(text, 'None') ORDER BY turn), ' ') AS text
FROM conversations GROUP BY conv_id""",
)
def extract_text_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat rows (messages array) -> text, contents joined by a space."""
    from finelens.sources.chat import chat_samples

    chats = chat_samples(Tables(spark, sf_dir))
    return chats.select("row_idx", extract_text(chats.columns).alias("text"))
