"""Dataset-level jobs: splits, head-N, profiles, column contracts, the
check cascade and roll-ups.

Split stand-in (fixed rule): a document is in the ``eval`` split when
``doc_id % 10 = 9``, else in ``train``.  Preference columns come from the
document pairs of ``plans.validation``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from finelens.operators import checks as C
from finelens.plans.registry import job
from finelens.plans.validation import PAIRS_SQL, PROFILE_SQL, preference_pairs
from finelens.sources.tables import Tables

BY = ["dataset"]
HEAD_N = 10
MAX_SAMPLES = 30
CRITICAL_FAILURES = 2

# Required fields per training strategy (fixed values of the reference);
# a tuple inside the list means "any of".
CONTRACTS = {
    "sft": [("messages", "text")],
    "cot": [("messages", "text")],
    "cpt": ["text"],
    "dpo": ["chosen", "rejected"],
    "orpo": ["chosen", "rejected"],
    "grpo": ["prompt"],
    "sapo": ["prompt"],
    "reward_labelling": ["prompt", "reference_answer"],
}


def split_samples(t: Tables) -> DataFrame:
    return t.documents.select(
        F.col("source").alias("dataset"),
        F.when(F.col("doc_id") % 10 == 9, "eval").otherwise("train").alias("split"),
        F.col("doc_id").alias("row_idx"),
        "text",
    )


SPLIT_SQL = """ss AS (SELECT source AS dataset, CASE WHEN doc_id % 10 = 9 THEN 'eval' ELSE 'train' END AS split,
  doc_id AS row_idx, text FROM documents)"""


@job("list_splits", sql="WITH " + SPLIT_SQL + " SELECT DISTINCT dataset, split FROM ss")
def list_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_samples(Tables(spark, sf_dir)).select("dataset", "split").distinct()


@job("head_n", sql="""SELECT source AS dataset, doc_id AS row_idx, text FROM documents
QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 10""")
def head_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First 10 rows of every dataset by position (the sampling operator itself)."""
    return C.head_n(Tables(spark, sf_dir).text_samples, HEAD_N, by=BY)


@job("scan_train_eval", sql="WITH " + SPLIT_SQL + """
SELECT dataset, split, row_idx FROM ss
QUALIFY row_number() OVER (PARTITION BY dataset, split ORDER BY row_idx)
        <= CASE WHEN split = 'train' THEN 30 ELSE greatest(30 // 10, 1) END""")
def scan_train_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train capped at max_samples, eval at max(max_samples // 10, 1), per dataset."""
    s = split_samples(Tables(spark, sf_dir)).select("dataset", "split", "row_idx")
    train = C.head_n(s.where(F.col("split") == "train"), MAX_SAMPLES, by=["dataset", "split"])
    ev = C.head_n(s.where(F.col("split") == "eval"), max(MAX_SAMPLES // 10, 1), by=["dataset", "split"])
    return train.unionByName(ev)


@job("dataset_profile", sql="WITH " + SPLIT_SQL + """
SELECT dataset, split, CAST(count(*) AS BIGINT) AS rows, 'dataset,split,row_idx,text' AS columns FROM ss GROUP BY dataset, split""")
def dataset_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = split_samples(Tables(spark, sf_dir))
    cols = ",".join(s.columns)
    return s.groupBy("dataset", "split").agg(F.count(F.lit(1)).cast("bigint").alias("rows")).withColumn("columns", F.lit(cols))


@job("dataset_not_empty", sql="WITH " + SPLIT_SQL + """
SELECT dataset, CAST(count(*) FILTER (WHERE split = 'train') AS BIGINT) AS train_rows,
  CAST(count(*) FILTER (WHERE split = 'eval') AS BIGINT) AS eval_rows,
  count(*) FILTER (WHERE split = 'train') > 0 AS passed
FROM ss GROUP BY dataset""")
def dataset_not_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = split_samples(Tables(spark, sf_dir))
    g = s.groupBy("dataset").agg(
        F.count_if(F.col("split") == "train").cast("bigint").alias("train_rows"),
        F.count_if(F.col("split") == "eval").cast("bigint").alias("eval_rows"),
    )
    # a split without rows is absent here, and an absent eval split is no failure
    return g.withColumn("passed", F.col("train_rows") > 0)


def contract_samples(t: Tables) -> DataFrame:
    p = preference_pairs(t)
    d = t.documents.select(F.col("doc_id").alias("row_idx"), "text")
    return p.join(d, "row_idx")


@job("contract_coverage", sql="WITH " + PAIRS_SQL + """,
cs AS (SELECT p.dataset, p.row_idx, p.chosen, p.rejected, d.text FROM pairs p JOIN documents d ON d.doc_id = p.row_idx),
cov AS (
  SELECT dataset, 'sft' AS strategy, count(*) AS rows, count(*) FILTER (WHERE text IS NOT NULL) AS covered, NULL AS first_missing FROM cs GROUP BY dataset
  UNION ALL SELECT dataset, 'cot', count(*), count(*) FILTER (WHERE text IS NOT NULL), NULL FROM cs GROUP BY dataset
  UNION ALL SELECT dataset, 'cpt', count(*), count(*) FILTER (WHERE text IS NOT NULL), NULL FROM cs GROUP BY dataset
  UNION ALL SELECT dataset, 'dpo', count(*), count(*) FILTER (WHERE chosen IS NOT NULL AND rejected IS NOT NULL), NULL FROM cs GROUP BY dataset
  UNION ALL SELECT dataset, 'orpo', count(*), count(*) FILTER (WHERE chosen IS NOT NULL AND rejected IS NOT NULL), NULL FROM cs GROUP BY dataset
  UNION ALL SELECT dataset, 'grpo', count(*), 0, 'prompt' FROM cs GROUP BY dataset
  UNION ALL SELECT dataset, 'sapo', count(*), 0, 'prompt' FROM cs GROUP BY dataset
  UNION ALL SELECT dataset, 'reward_labelling', count(*), 0, 'prompt' FROM cs GROUP BY dataset)
SELECT dataset, strategy, CAST(rows AS BIGINT) AS rows, CAST(covered AS BIGINT) AS covered,
  CASE WHEN rows = 0 THEN 0.0 ELSE CAST(covered AS DOUBLE) / rows END AS coverage, CAST(first_missing AS VARCHAR) AS first_missing
FROM cov""")
def contract_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per dataset x strategy: rows, rows with every required field, coverage, first absent column."""
    s = contract_samples(Tables(spark, sf_dir))
    cols = set(s.columns)
    aggs, meta = [], []
    for strategy, req in CONTRACTS.items():
        conds, missing = [], None
        for f in req:
            alts = f if isinstance(f, tuple) else (f,)
            present = [a for a in alts if a in cols]
            if not present:
                missing = missing or alts[0]
                conds.append(F.lit(False))
            else:
                c = None
                for a in present:
                    c = F.col(a).isNotNull() if c is None else (c | F.col(a).isNotNull())
                conds.append(c)
        ok = conds[0]
        for c in conds[1:]:
            ok = ok & c
        aggs.append(F.count_if(ok).cast("bigint").alias(f"c_{strategy}"))
        meta.append((strategy, missing))
    g = s.groupBy(*BY).agg(F.count(F.lit(1)).cast("bigint").alias("rows"), *aggs)
    long = g.select(
        *BY, "rows",
        F.explode(F.array(*[
            F.struct(F.lit(st).alias("strategy"), F.col(f"c_{st}").alias("covered"), F.lit(m).cast("string").alias("first_missing"))
            for st, m in meta
        ])).alias("x"),
    )
    return long.select(
        *BY, "x.strategy", "rows", "x.covered",
        C.safe_ratio(F.col("x.covered"), F.col("rows")).alias("coverage"), "x.first_missing",
    )


# ---------------------------------------------------------------------------
# check cascade and roll-ups over the default checks
# ---------------------------------------------------------------------------
CHECK_ROWS_SQL = PROFILE_SQL + """,
checks AS (
  SELECT dataset, 'min_samples' AS check_id, 10 AS priority, sample_count >= 100 AS passed FROM p
  UNION ALL SELECT dataset, 'avg_length', 20, avg_length >= 50 AND avg_length <= 8192 FROM p
  UNION ALL SELECT dataset, 'empty_ratio', 25, empty_ratio <= 0.05 FROM p
  UNION ALL SELECT dataset, 'diversity_score', 30, diversity_score >= 0.3 FROM p)"""


def check_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    prof = C.text_profile(Tables(spark, sf_dir).text_samples, BY)
    v = C.default_check_columns(prof)
    return v.select(*BY, F.explode(F.array(
        F.struct(F.lit("min_samples").alias("check_id"), F.lit(10).alias("priority"), F.col("min_samples_passed").alias("passed")),
        F.struct(F.lit("avg_length").alias("check_id"), F.lit(20).alias("priority"), F.col("avg_length_passed").alias("passed")),
        F.struct(F.lit("empty_ratio").alias("check_id"), F.lit(25).alias("priority"), F.col("empty_ratio_passed").alias("passed")),
        F.struct(F.lit("diversity_score").alias("check_id"), F.lit(30).alias("priority"), F.col("diversity_passed").alias("passed")),
    )).alias("c")).select(*BY, "c.check_id", "c.priority", "c.passed")


@job("run_checks", sql="WITH " + CHECK_ROWS_SQL + """
SELECT dataset, check_id, priority, passed FROM (
  SELECT *, coalesce(sum(CASE WHEN passed THEN 0 ELSE 1 END) OVER (PARTITION BY dataset ORDER BY priority, check_id
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS failed_before FROM checks)
WHERE failed_before < 2""")
def run_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks in priority order; a dataset stops once failures reach critical_failures (2)."""
    rows = check_rows(spark, sf_dir)
    w = Window.partitionBy(*BY).orderBy("priority", "check_id").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.when(F.col("passed"), 0).otherwise(1)).over(w), F.lit(0))
    return rows.withColumn("_fb", before).where(F.col("_fb") < CRITICAL_FAILURES).drop("_fb")


@job("validation_rollup", sql="WITH " + CHECK_ROWS_SQL + """,
g AS (SELECT dataset, count(*) AS total, count(*) FILTER (WHERE passed) AS ok, count(*) FILTER (WHERE NOT passed) AS bad FROM checks GROUP BY dataset),
k AS (SELECT DISTINCT source AS dataset FROM documents UNION SELECT DISTINCT 'planned_' || lang FROM documents)
SELECT dataset, coalesce(total, 0) AS total_plugins, coalesce(ok, 0) AS passed_plugins, coalesce(bad, 0) AS failed_plugins,
  coalesce(bad > 0 AND bad < 2, false) AS partial_failure,
  CASE WHEN total IS NULL THEN 'unknown' WHEN bad = 0 THEN 'passed' ELSE 'failed' END AS status FROM k LEFT JOIN g USING (dataset)""")
def validation_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per dataset: plugins total / passed / failed, partial failure (0 < failed < critical), status.

    Datasets without a result (here a planned one a language) are unknown.
    """
    g = check_rows(spark, sf_dir).groupBy(*BY).agg(
        F.count(F.lit(1)).cast("bigint").alias("total_plugins"),
        F.count_if("passed").cast("bigint").alias("passed_plugins"),
        F.count_if(~F.col("passed")).cast("bigint").alias("failed_plugins"),
    )
    docs = Tables(spark, sf_dir).documents
    planned = docs.select(F.concat(F.lit("planned_"), F.col("lang")).alias("dataset")).distinct()
    known = docs.select(F.col("source").alias("dataset")).distinct().unionByName(planned)
    j = known.join(g, "dataset", "left").withColumn("_seen", F.col("total_plugins").isNotNull())
    j = j.fillna(0, ["total_plugins", "passed_plugins", "failed_plugins"])
    f = F.col("failed_plugins")
    return j.select(
        *BY, "total_plugins", "passed_plugins", "failed_plugins", ((f > 0) & (f < CRITICAL_FAILURES)).alias("partial_failure"),
        F.when(~F.col("_seen"), "unknown").when(f == 0, "passed").otherwise("failed").alias("status"),
    )


@job("aggregate_datasets", sql="WITH " + CHECK_ROWS_SQL + """,
ds AS (SELECT dataset, bool_and(passed) AS ok FROM checks GROUP BY dataset)
SELECT dataset, ok AS passed, CAST(NULL AS BIGINT) AS datasets_validated, CAST(NULL AS BIGINT) AS datasets_passed, CAST(NULL AS BIGINT) AS datasets_failed FROM ds
UNION ALL SELECT NULL, bool_and(ok), count(*), count(*) FILTER (WHERE ok), count(*) FILTER (WHERE NOT ok) FROM ds""")
def aggregate_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per dataset, and the totals (validated, passed, failed) under a null dataset."""
    ds = check_rows(spark, sf_dir).groupBy(*BY).agg(F.bool_and("passed").alias("passed"))
    none = [F.lit(None).cast("bigint").alias(c) for c in ("datasets_validated", "datasets_passed", "datasets_failed")]
    total = ds.agg(
        F.bool_and("passed").alias("passed"),
        F.count(F.lit(1)).cast("bigint").alias("datasets_validated"),
        F.count_if("passed").cast("bigint").alias("datasets_passed"),
        F.count_if(~F.col("passed")).cast("bigint").alias("datasets_failed"),
    )
    return ds.select(*BY, "passed", *none).unionByName(total.select(F.lit(None).cast("string").alias("dataset"), "*"))


@job("recommendations", sql="WITH " + PROFILE_SQL + """
SELECT * FROM (
  SELECT dataset, 'min_samples' AS check_id, sample_count < 100 * 0.5 AS critical FROM p WHERE sample_count < 100
  UNION ALL SELECT dataset, 'avg_length', false FROM p WHERE NOT (avg_length >= 50 AND avg_length <= 8192)
  UNION ALL SELECT dataset, 'empty_ratio', empty_ratio > 0.2 FROM p WHERE empty_ratio > 0.05
  UNION ALL SELECT dataset, 'diversity_score', diversity_score < 0.3 FROM p WHERE diversity_score < 0.3)""")
def recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Advice rows for failed default checks with the CRITICAL escalation of each check."""
    v = C.default_check_columns(C.text_profile(Tables(spark, sf_dir).text_samples, BY))
    n = F.col("sample_count")
    recs = F.array(
        F.when(~F.col("min_samples_passed"), F.struct(F.lit("min_samples").alias("check_id"), (n < 100 * 0.5).alias("critical"))),
        F.when(~F.col("avg_length_passed"), F.struct(F.lit("avg_length").alias("check_id"), F.lit(False).alias("critical"))),
        F.when(~F.col("empty_ratio_passed"),
               F.struct(F.lit("empty_ratio").alias("check_id"), (F.col("empty_ratio") > C.EMPTY_CRITICAL).alias("critical"))),
        F.when(~F.col("diversity_passed"),
               F.struct(F.lit("diversity_score").alias("check_id"), (F.col("diversity_score") < C.DIVERSITY_CRITICAL).alias("critical"))),
    )
    return v.select(*BY, F.explode(F.array_compact(recs)).alias("r")).select(*BY, "r.check_id", "r.critical")


@job("dataset_registry", sql="""SELECT source AS dataset, count(*) AS samples, count(DISTINCT lang) AS languages FROM documents GROUP BY source""")
def dataset_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The datasets in use, one row each, with their size."""
    return Tables(spark, sf_dir).documents.groupBy(F.col("source").alias("dataset")).agg(
        F.count(F.lit(1)).cast("bigint").alias("samples"), F.count_distinct("lang").alias("languages")
    )
