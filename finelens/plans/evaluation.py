"""Evaluation jobs.

Stand-ins built from the driver tables at scale (fixed rules):

* eval items from ``part``: a question with a fenced schema block for the
  part type, an expected query, and a model answer whose form depends on
  ``p_partkey % 7`` (exact copy, re-spaced copy, fenced, vector passed to
  Embed, bad RerankRRF arguments, ``:=`` without QUERY, unbalanced brace);
  every 11th answer is empty.  An exclusion request is added to the
  question when ``p_size % 3 = 0``.
* chat eval samples from ``conversations``: first user text = question,
  first assistant text = expected answer, last assistant text = answer.
* judge replies from ``benchmark``: by ``item_id % 4`` a JSON reply, a
  fenced JSON reply, a reply with only a ``"score": n`` fragment, or a
  broken reply; the score is ``item_id % 7``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finelens.functions import query_text as Q
from finelens.operators import evaluate as EVAL
from finelens.plans.registry import job
from finelens.sources.tables import Tables


def eval_items(t: Tables) -> DataFrame:
    p = t.part
    typ = F.regexp_replace("p_type", "[^A-Za-z]", "")
    excl = F.col("p_size") % 3 == 0
    k = F.col("p_partkey")
    schema = F.format_string("N::%s {\n    name: String,\n    size: I64\n}", typ)
    question = F.concat(
        F.lit("```helixschema\n"), schema, F.lit("\n```\nFind "), F.col("p_name"), F.lit(" parts of "), F.col("p_brand"),
        F.lit("."), F.when(excl, F.lit(" Exclude `size` from the result.")).otherwise(F.lit("")),
    )
    expected = F.format_string(
        "QUERY find%d(name: String) =>\n    p <- N<%s>::WHERE(_::{name}::EQ(name))%s\n    RETURN p",
        k, typ, F.when(excl, F.lit("::!{size}")).otherwise(F.lit("")),
    )
    m = k % 7
    answer = (
        F.when(k % 11 == 10, F.lit(""))
        .when(m == 0, expected)
        .when(m == 1, F.regexp_replace(expected, "    ", "  "))
        .when(m == 2, F.concat(F.lit("```\n"), expected, F.lit("\n```")))
        .when(m == 3, F.format_string("QUERY find%d(v: [F64]) =>\n    p <- SearchV<%s>(Embed(v), 10)\n    RETURN p", k, typ))
        .when(m == 4, F.format_string(
            "QUERY find%d(q: String) =>\n    p <- SearchBM25<%s>(q, 10)::RerankRRF(k: 60, w: 2)\n    RETURN p", k, typ))
        .when(m == 5, F.format_string("p := N<%s>\nRETURN p", typ))
        .otherwise(F.format_string("QUERY find%d(name: String) =>\n    p <- N<%s>::{name\n    RETURN p", k, typ))
    )
    return p.select(
        k.alias("sample_idx"), question.alias("question"), expected.alias("expected_answer"), answer.alias("model_answer")
    )


ITEMS_SQL = r"""items AS (
  SELECT p_partkey AS sample_idx,
    '```helixschema' || chr(10) || printf('N::%s {' || chr(10) || '    name: String,' || chr(10) || '    size: I64' || chr(10) || '}',
      regexp_replace(p_type, '[^A-Za-z]', '', 'g'))
      || chr(10) || '```' || chr(10) || 'Find ' || p_name || ' parts of ' || p_brand || '.'
      || CASE WHEN p_size % 3 = 0 THEN ' Exclude `size` from the result.' ELSE '' END AS question,
    printf('QUERY find%d(name: String) =>' || chr(10) || '    p <- N<%s>::WHERE(_::{name}::EQ(name))%s' || chr(10) || '    RETURN p',
      p_partkey, regexp_replace(p_type, '[^A-Za-z]', '', 'g'), CASE WHEN p_size % 3 = 0 THEN '::!{size}' ELSE '' END)
      AS expected_answer,
    p_partkey % 7 AS m, p_partkey % 11 = 10 AS blank, regexp_replace(p_type, '[^A-Za-z]', '', 'g') AS typ
  FROM part),
ev_items AS (
  SELECT sample_idx, question, expected_answer,
    CASE WHEN blank THEN ''
      WHEN m = 0 THEN expected_answer
      WHEN m = 1 THEN replace(expected_answer, '    ', '  ')
      WHEN m = 2 THEN '```' || chr(10) || expected_answer || chr(10) || '```'
      WHEN m = 3 THEN printf('QUERY find%d(v: [F64]) =>' || chr(10) || '    p <- SearchV<%s>(Embed(v), 10)' || chr(10) || '    RETURN p',
                             sample_idx, typ)
      WHEN m = 4 THEN printf('QUERY find%d(q: String) =>' || chr(10) || '    p <- SearchBM25<%s>(q, 10)::RerankRRF(k: 60, w: 2)'
                             || chr(10) || '    RETURN p', sample_idx, typ)
      WHEN m = 5 THEN printf('p := N<%s>' || chr(10) || 'RETURN p', typ)
      ELSE printf('QUERY find%d(name: String) =>' || chr(10) || '    p <- N<%s>::{name' || chr(10) || '    RETURN p', sample_idx, typ)
    END AS model_answer
  FROM items)"""

# RE2 forms of the rule patterns (RE2 treats only \n as a line break)
HARD_SQL = r"""hard AS (
  SELECT sample_idx, list_filter([
    CASE WHEN NOT starts_with(regexp_replace(model_answer, '^@WS@+', ''), 'QUERY') THEN 'not_starting_with_query' END,
    CASE WHEN contains(model_answer, '```') THEN 'contains_markdown_fence' END,
    CASE WHEN contains(model_answer, ':=') THEN 'contains_colon_equals' END,
    CASE WHEN NOT regexp_matches(model_answer, '(?m)^@WS@*QUERY@WS@+') THEN 'missing_query_keyword' END,
    CASE WHEN len(list_filter(
        list_filter(
          list_transform(
            list_filter(list_transform(string_split(regexp_replace(regexp_extract(model_answer,
              '(?m)^@WS@*QUERY@WS@+([A-Za-z_][A-Za-z0-9_]*)@WS@*\((.*?)\)@WS@*=>', 2), '^@WS@+|@WS@+$', '', 'g'), ','),
              lambda p: regexp_replace(p, '^@WS@+|@WS@+$', '', 'g')), lambda p: p <> '' AND contains(p, ':')),
            lambda p: {'name': regexp_replace(split_part(p, ':', 1), '^@WS@+|@WS@+$', '', 'g'),
                       'type': regexp_replace(substr(p, strpos(p, ':') + 1), '^@WS@+|@WS@+$', '', 'g')}),
          lambda x: x.name <> '' AND replace(x.type, ' ', '') = '[F64]'),
        lambda x: regexp_matches(model_answer, '\bEmbed\s*\(\s*' || x.name || '\s*\)'))) > 0 THEN 'embed_vector_misuse' END,
    CASE WHEN len(list_filter(regexp_extract_all(model_answer, '::RerankRRF\s*\(([^)]*)\)', 1),
        lambda a: trim(a) <> '' AND (
          len(list_filter(list_transform(string_split(trim(a), ','), lambda q: trim(q)), lambda q: q <> '')) <> 1
          OR NOT regexp_matches(list_filter(list_transform(string_split(trim(a), ','), lambda q: trim(q)), lambda q: q <> '')[1],
                                '^k\s*:\s*.+$')))) > 0 THEN 'rerank_rrf_invalid_args' END,
    CASE WHEN len(req) > 0 AND len(list_filter(req, lambda r: NOT list_contains(got, r))) > 0
         THEN 'missing_required_exclusions' END
  ], lambda e: e IS NOT NULL) AS errs
  FROM (SELECT *,
          list_distinct(regexp_extract_all(array_to_string(list_filter(string_split(question, chr(10)),
            lambda ln: regexp_matches(ln, '(?i)(exclude|exclusion)')), chr(10)), '`([A-Za-z_][A-Za-z0-9_]*)`', 1)) AS req,
          flatten(list_transform(regexp_extract_all(model_answer, '::!\{([^}]*)\}', 1),
            lambda x: regexp_extract_all(x, '[A-Za-z_][A-Za-z0-9_]*'))) AS got
        FROM ev_items))"""


@job("hard_eval_rules", sql="WITH " + ITEMS_SQL + ", " + HARD_SQL + """
SELECT rule, CAST(count(*) AS BIGINT) AS failures FROM (SELECT unnest(errs) AS rule FROM hard) GROUP BY rule""")
def hard_eval_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures per rule over all generated answers."""
    items = eval_items(Tables(spark, sf_dir))
    errs = items.select(F.explode(Q.hard_eval_errors(F.col("question"), F.col("model_answer"))).alias("rule"))
    return errs.groupBy("rule").agg(F.count(F.lit(1)).cast("bigint").alias("failures"))


@job("extract_fenced_block", sql="WITH " + ITEMS_SQL + r""" SELECT sample_idx,
  regexp_replace(regexp_extract(question, '```helixschema\n([\s\S]*?)\n```', 1), '^@WS@+|@WS@+$', '', 'g') AS schema_block
FROM ev_items""")
def extract_fenced_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = eval_items(Tables(spark, sf_dir))
    return items.select("sample_idx", Q.fenced_schema("question").alias("schema_block"))


@job("normalize_query_text", sql="WITH " + ITEMS_SQL + """ SELECT sample_idx,
  array_to_string(list_filter(list_transform(string_split(regexp_replace(model_answer, '^@WS@+|@WS@+$', '', 'g'), chr(10)),
    lambda ln: regexp_replace(regexp_replace(ln, '^@WS@+|@WS@+$', '', 'g'), '@WS@+', ' ', 'g')), lambda ln: ln <> ''), chr(10))
  AS normalized
FROM ev_items""")
def normalize_query_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = eval_items(Tables(spark, sf_dir))
    return items.select("sample_idx", Q.normalize_query_text("model_answer").alias("normalized"))


TOKJ_SQL = """SELECT sample_idx,
  CASE WHEN len(list_distinct(list_concat(ta, tb))) = 0 THEN 0.0
       ELSE CAST(len(list_intersect(ta, tb)) AS DOUBLE) / len(list_distinct(list_concat(ta, tb))) END AS token_jaccard
FROM (SELECT sample_idx,
        list_distinct(regexp_extract_all(lower(coalesce(model_answer, '')), '[A-Za-z_][A-Za-z0-9_]*')) AS ta,
        list_distinct(regexp_extract_all(lower(coalesce(expected_answer, '')), '[A-Za-z_][A-Za-z0-9_]*')) AS tb
      FROM ev_items)"""


@job("token_jaccard", sql="WITH " + ITEMS_SQL + " " + TOKJ_SQL)
def token_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = eval_items(Tables(spark, sf_dir))
    return items.select(
        "sample_idx", Q.token_jaccard(F.lower("model_answer"), F.lower("expected_answer")).alias("token_jaccard")
    )


SYNTAX_SQL = """syn AS (SELECT sample_idx,
  CASE WHEN regexp_replace(model_answer, '^@WS@+|@WS@+$', '', 'g') = '' THEN 'empty response'
       WHEN NOT regexp_matches(model_answer, '(?m)^@WS@*QUERY@WS@+') THEN 'missing QUERY keyword'
       WHEN NOT regexp_matches(model_answer, '(?m)^@WS@*QUERY@WS@+[A-Za-z_][A-Za-z0-9_]*@WS@*\\(.*?\\)@WS@*=>')
         THEN 'invalid QUERY signature (expected: QUERY name(...) =>)'
       WHEN NOT list_bool_or(list_transform(string_split(model_answer, chr(10)),
         lambda ln: starts_with(regexp_replace(ln, '^@WS@+|@WS@+$', '', 'g'), 'RETURN')))
         THEN 'missing RETURN statement'
       WHEN length(model_answer) - length(replace(model_answer, '{', '')) <> length(model_answer) - length(replace(model_answer, '}', ''))
         THEN printf('unmatched braces (open=%d, close=%d)', length(model_answer) - length(replace(model_answer, '{', '')),
                     length(model_answer) - length(replace(model_answer, '}', '')))
  END AS reason FROM ev_items)"""


@job("eval_syntax", sql="WITH " + ITEMS_SQL + ", " + SYNTAX_SQL + """
SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE reason IS NULL) AS BIGINT) AS valid,
  CASE WHEN count(*) = 0 THEN 1.0 ELSE CAST(count(*) FILTER (WHERE reason IS NULL) AS DOUBLE) / count(*) END AS valid_ratio,
  CASE WHEN count(*) = 0 THEN 1.0 ELSE CAST(count(*) FILTER (WHERE reason IS NULL) AS DOUBLE) / count(*) END >= 0.8 AS passed,
  CAST(count(*) FILTER (WHERE reason IS NOT NULL) AS BIGINT) AS failed_count,
  array_to_string(list_sort(list(sample_idx) FILTER (WHERE reason IS NOT NULL))[1:20], ',') AS first_failed
FROM syn""")
def eval_syntax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """valid / total >= 0.8; empty input passes with ratio 1.0; first 20 failed indices."""
    items = eval_items(Tables(spark, sf_dir))
    syn = items.select("sample_idx", Q.syntax_failure("model_answer").alias("reason"))
    ok = F.col("reason").isNull()
    agg = syn.agg(
        F.count(F.lit(1)).cast("bigint").alias("total"),
        F.count_if(ok).cast("bigint").alias("valid"),
        F.count_if(~ok).cast("bigint").alias("failed_count"),
    )
    ratio = F.when(F.col("total") == 0, F.lit(1.0)).otherwise(F.col("valid") / F.col("total"))
    # top-20 smallest failed indices: a bounded TakeOrdered, then one row
    first = syn.where(~ok).orderBy("sample_idx").limit(20).agg(
        F.array_join(F.array_sort(F.collect_list("sample_idx")), ",").alias("first_failed")
    )
    one = F.lit(1).alias("_one")
    return agg.select("*", one).join(first.select("*", one), "_one").select(
        "total", "valid", ratio.alias("valid_ratio"), (ratio >= EVAL.SYNTAX_MIN_VALID_RATIO).alias("passed"),
        "failed_count", "first_failed",
    )


@job("syntax_reasons", sql="WITH " + ITEMS_SQL + ", " + SYNTAX_SQL + """
SELECT reason, CAST(count(*) AS BIGINT) AS n FROM syn WHERE reason IS NOT NULL GROUP BY reason""")
def syntax_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failing samples per syntax reason."""
    items = eval_items(Tables(spark, sf_dir))
    syn = items.select(Q.syntax_failure("model_answer").alias("reason")).where(F.col("reason").isNotNull())
    return syn.groupBy("reason").agg(F.count(F.lit(1)).cast("bigint").alias("n"))


@job("semantic_match")
def semantic_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-sample semantic match of generated answers (ratio kernel in a pandas UDF)."""
    items = eval_items(Tables(spark, sf_dir))
    sm = EVAL.semantic_match(items)
    return sm.select(
        "sample_idx", "score", "exact_match", "near_match", "sequence_ratio", "token_jaccard", "hard_eval_pass",
        F.array_join("hard_eval_errors", ",").alias("hard_eval_errors"),
    )


@job("sequence_ratio")
def sequence_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratcliff-Obershelp ratio of lowered, normalized chat answers vs expected answers (whole texts)."""
    from finelens.plans.chat_eval import chat_eval_samples

    s = chat_eval_samples(Tables(spark, sf_dir))
    s = s.select(
        "sample_idx",
        F.lower(Q.normalize_query_text("model_answer")).alias("a"),
        F.lower(Q.normalize_query_text("expected_answer")).alias("b"),
    )
    return EVAL.with_sequence_ratio(s, "a", "b").select("sample_idx", "sequence_ratio")


@job("eval_semantic")
def eval_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semantic evaluator verdict: mean / p50 / distribution, exact, near, hard-pass ratios."""
    items = eval_items(Tables(spark, sf_dir))
    sm = EVAL.semantic_match(items)
    scored = sm.select(
        F.round("score", 4).alias("score"),
        EVAL.raw_score_from_unit(F.round("score", 4)).alias("raw_score"),
        "exact_match", "near_match", "hard_eval_pass",
    )
    agg = EVAL.aggregate_scores(scored.withColumn("_g", F.lit(1)), ["_g"])
    extra = scored.agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if("exact_match").alias("_e"),
        F.count_if("near_match").alias("_m"),
        F.count_if("hard_eval_pass").alias("_h"),
        F.count_if(F.col("score") < EVAL.SEMANTIC_SAMPLE_FAIL_BELOW).cast("bigint").alias("failed_samples"),
    )
    r = lambda c: F.when(F.col("_n") > 0, F.col(c) / F.col("_n")).otherwise(F.lit(0.0))
    return agg.join(extra.withColumn("_g", F.lit(1)), "_g").drop("_g").select(
        "*", r("_e").alias("exact_match_ratio"), r("_m").alias("near_match_ratio"), r("_h").alias("hard_eval_pass_ratio")
    ).drop("_n", "_e", "_m", "_h")


JUDGE_SQL = r"""replies AS (
  SELECT item_id AS sample_idx, CASE item_id % 4
    WHEN 0 THEN printf('{"score": %d, "reasoning": "%s"}', item_id % 7, 'reply ' || item_id)
    WHEN 1 THEN '```json' || chr(10) || printf('{"score": %d, "reasoning": "fenced"}', item_id % 7) || chr(10) || '```'
    WHEN 2 THEN printf('The "score": %d was given; {broken', item_id % 7)
    ELSE 'no score here' END AS raw
  FROM benchmark),
parsed AS (SELECT sample_idx, raw,
  CASE WHEN json_valid(raw) THEN CASE WHEN json_type(raw, '$.score') IN ('BIGINT', 'UBIGINT', 'DOUBLE')
                                      THEN trunc(CAST(json_extract(raw, '$.score') AS DOUBLE)) END
       WHEN json_valid(regexp_extract(raw, '\{[^}]+\}', 0)) THEN
         CASE WHEN json_type(regexp_extract(raw, '\{[^}]+\}', 0), '$.score') IN ('BIGINT', 'UBIGINT', 'DOUBLE')
              THEN trunc(CAST(json_extract(regexp_extract(raw, '\{[^}]+\}', 0), '$.score') AS DOUBLE)) END END AS s0
  FROM replies),
judged AS (SELECT sample_idx,
  CASE WHEN s IS NOT NULL THEN CAST(greatest(1, least(5, s)) AS BIGINT) END AS score
  FROM (SELECT sample_idx, coalesce(CAST(s0 AS BIGINT),
          CAST(nullif(regexp_extract(raw, '"score"\s*:\s*([1-5])', 1), '') AS BIGINT)) AS s FROM parsed))"""


def judge_replies(t: Tables) -> DataFrame:
    i = F.col("item_id")
    raw = (
        F.when(i % 4 == 0, F.format_string('{"score": %d, "reasoning": "%s"}', i % 7, F.concat(F.lit("reply "), i.cast("string"))))
        .when(i % 4 == 1, F.concat(F.lit("```json\n"), F.format_string('{"score": %d, "reasoning": "fenced"}', i % 7), F.lit("\n```")))
        .when(i % 4 == 2, F.format_string('The "score": %d was given; {broken', i % 7))
        .otherwise(F.lit("no score here"))
    )
    return t.benchmark.select(i.alias("sample_idx"), raw.alias("raw"))


@job("judge_parse", sql="WITH " + JUDGE_SQL + " SELECT sample_idx, score FROM judged")
def judge_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = judge_replies(Tables(spark, sf_dir))
    return r.select("sample_idx", EVAL.judge_score(F.col("raw")).alias("score"))


@job("eval_judge", sql="WITH " + JUDGE_SQL + """
SELECT CAST(count(score) AS BIGINT) AS sample_count, CAST(count(*) FILTER (WHERE score IS NULL) AS BIGINT) AS failed_count,
  coalesce(avg((score - 1) / 4.0), 0.0) AS mean_score, coalesce(quantile_cont((score - 1) / 4.0, 0.5), 0.0) AS p50_score,
  CAST(count(*) FILTER (WHERE score = 1) AS BIGINT) AS score_1, CAST(count(*) FILTER (WHERE score = 2) AS BIGINT) AS score_2,
  CAST(count(*) FILTER (WHERE score = 3) AS BIGINT) AS score_3, CAST(count(*) FILTER (WHERE score = 4) AS BIGINT) AS score_4,
  CAST(count(*) FILTER (WHERE score = 5) AS BIGINT) AS score_5,
  count(score) > 0 AND coalesce(avg((score - 1) / 4.0), 0.0) >= 0.6 AS passed
FROM judged""")
def eval_judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge replies -> normalised (raw - 1) / 4 scores; unparsable replies fail; all failed -> not passed."""
    r = judge_replies(Tables(spark, sf_dir)).select(EVAL.judge_score(F.col("raw")).alias("raw_score"))
    scored = r.select("raw_score", ((F.col("raw_score") - 1) / F.lit(4.0)).alias("score"), F.lit(1).alias("_g"))
    agg = EVAL.aggregate_scores(scored, ["_g"], failed=F.col("raw_score").isNull()).drop("_g")
    return agg.withColumn("passed", (F.col("sample_count") > 0) & F.col("passed"))


# ---------------------------------------------------------------------------
# compile outcomes: memoised per (schema, query) pair, joined back
# ---------------------------------------------------------------------------
SEP = "\x1f"


def pair_key(schema, query):
    return F.sha2(F.concat_ws(SEP, F.coalesce(schema, F.lit("")), F.coalesce(query, F.lit(""))), 256)


def outcomes_table(t: Tables) -> DataFrame:
    """Compile outcomes (stand-in): labels of the item's ``doc_id`` decide ok /
    error type for both the generated and the gold query of that item."""
    items = eval_items(t).select("sample_idx", Q.fenced_schema("question").alias("schema"), "model_answer", "expected_answer")
    lab = t.labels.select(F.col("doc_id").alias("sample_idx"), "quality", "toxic")
    j = items.join(lab, "sample_idx")
    ok = F.col("quality") == 1
    err = F.when(ok, F.lit(None).cast("string")).when(F.col("toxic") == 1, "compile_error").otherwise("schema_error")
    gen = j.select(pair_key(F.col("schema"), F.col("model_answer")).alias("pair_key"), ok.alias("ok"), err.alias("error_type"))
    gold = j.select(pair_key(F.col("schema"), F.col("expected_answer")).alias("pair_key"), ok.alias("ok"), err.alias("error_type"))
    # conflicting outcomes of one pair: a failure wins, then the smallest error type
    one = gen.unionByName(gold).groupBy("pair_key").agg(F.min(F.struct("ok", "error_type")).alias("o"))
    return one.select("pair_key", "o.ok", "o.error_type")


def with_outcome(t: Tables, query_col: str) -> DataFrame:
    """Eval items with the outcome of (schema, query): distinct pairs are joined once."""
    items = eval_items(t).select("sample_idx", Q.fenced_schema("question").alias("schema"), F.col(query_col).alias("query"))
    keyed = items.withColumn("pair_key", pair_key(F.col("schema"), F.col("query")))
    pairs = keyed.select("pair_key").distinct()
    resolved = pairs.join(outcomes_table(t), "pair_key", "left")
    return keyed.join(resolved, "pair_key", "left")


OUT_SQL = ITEMS_SQL + r""",
sch AS (SELECT sample_idx, regexp_replace(regexp_extract(question, '```helixschema\n([\s\S]*?)\n```', 1), '^@WS@+|@WS@+$', '', 'g')
  AS schema, model_answer, expected_answer FROM ev_items),
lab AS (SELECT s.*, l.quality, l.toxic FROM sch s JOIN labels l ON l.doc_id = s.sample_idx),
outc AS (SELECT DISTINCT ON (pair_key) pair_key, ok, error_type FROM (
  SELECT sha256(coalesce(schema, '') || chr(31) || coalesce(model_answer, '')) AS pair_key, quality = 1 AS ok,
    CASE WHEN quality = 1 THEN NULL WHEN toxic = 1 THEN 'compile_error' ELSE 'schema_error' END AS error_type FROM lab
  UNION ALL
  SELECT sha256(coalesce(schema, '') || chr(31) || coalesce(expected_answer, '')), quality = 1,
    CASE WHEN quality = 1 THEN NULL WHEN toxic = 1 THEN 'compile_error' ELSE 'schema_error' END FROM lab)
  ORDER BY pair_key, ok, error_type),
gen AS (SELECT s.sample_idx, s.schema, s.model_answer AS query, o.ok, o.error_type FROM sch s
  LEFT JOIN outc o ON o.pair_key = sha256(coalesce(s.schema, '') || chr(31) || coalesce(s.model_answer, ''))),
gold AS (SELECT s.sample_idx, s.schema, s.expected_answer AS query, o.ok, o.error_type FROM sch s
  LEFT JOIN outc o ON o.pair_key = sha256(coalesce(s.schema, '') || chr(31) || coalesce(s.expected_answer, '')))"""


@job("join_outcomes", sql="WITH " + OUT_SQL + """
SELECT DISTINCT sha256(coalesce(schema, '') || chr(31) || coalesce(query, '')) AS pair_key, ok, error_type FROM gen""")
def join_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (schema, query) pairs of generated answers with their compile outcome."""
    return with_outcome(Tables(spark, sf_dir), "model_answer").select("pair_key", "ok", "error_type").distinct()


def _taxonomy(df: DataFrame) -> DataFrame:
    blank = lambda c: F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"^\s+|\s+$", "") == ""
    return df.select(
        "sample_idx",
        F.when(blank("schema"), "missing_schema").when(blank("query"), "missing_query")
        .when(F.col("ok"), "ok").when(F.col("ok").isNull(), "unknown").otherwise(F.col("error_type")).alias("outcome"),
    )


TAX_SQL = """CASE WHEN trim(coalesce(schema, '')) = '' THEN 'missing_schema' WHEN trim(coalesce(query, '')) = '' THEN 'missing_query'
  WHEN ok THEN 'ok' WHEN ok IS NULL THEN 'unknown' ELSE error_type END"""


@job("eval_outcomes", sql="WITH " + OUT_SQL + f"""
SELECT {TAX_SQL} AS outcome, CAST(count(*) AS BIGINT) AS n FROM gen GROUP BY 1""")
def eval_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome taxonomy of generated answers (missing schema / query, ok, error types, unknown)."""
    tax = _taxonomy(with_outcome(Tables(spark, sf_dir), "model_answer"))
    return tax.groupBy("outcome").agg(F.count(F.lit(1)).cast("bigint").alias("n"))


@job("gold_outcomes", sql="WITH " + OUT_SQL + f""",
g AS (SELECT {TAX_SQL} AS outcome FROM gold)
SELECT CAST(count(*) AS BIGINT) AS checked, CAST(count(*) FILTER (WHERE outcome = 'ok') AS BIGINT) AS compiled,
  CAST(count(*) FILTER (WHERE outcome = 'ok') AS DOUBLE) / count(*) AS ratio,
  CAST(count(*) FILTER (WHERE outcome = 'ok') AS DOUBLE) / count(*) >= 1.0 AS passed FROM g""")
def gold_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold answers that compile / checked (missing schema or query count as checked)."""
    tax = _taxonomy(with_outcome(Tables(spark, sf_dir), "expected_answer"))
    g = tax.agg(F.count(F.lit(1)).cast("bigint").alias("checked"), F.count_if(F.col("outcome") == "ok").cast("bigint").alias("compiled"))
    r = F.col("compiled") / F.col("checked")
    return g.select("checked", "compiled", r.alias("ratio"), (r >= 1.0).alias("passed"))


@job("reward_compile", sql="WITH " + OUT_SQL + """
SELECT sample_idx, CASE WHEN trim(coalesce(schema, '')) = '' OR trim(coalesce(query, '')) = '' THEN -1
  WHEN ok IS NULL THEN 0 WHEN ok THEN 1 ELSE -1 END AS reward FROM gen""")
def reward_compile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """-1 blank or failing, +1 compiling, 0 without an outcome (no compiler result)."""
    w = with_outcome(Tables(spark, sf_dir), "model_answer")
    blank = lambda c: F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"^\s+|\s+$", "") == ""
    r = F.when(blank("schema") | blank("query"), -1).when(F.col("ok").isNull(), 0).when(F.col("ok"), 1).otherwise(-1)
    return w.select("sample_idx", r.alias("reward"))


@job("flatten_eval_metrics", sql="WITH " + JUDGE_SQL + """,
agg AS (SELECT CAST(count(score) AS DOUBLE) AS sample_count, coalesce(avg((score - 1) / 4.0), 0.0) AS mean_score,
  coalesce(quantile_cont((score - 1) / 4.0, 0.5), 0.0) AS p50_score,
  CASE WHEN count(score) > 0 AND coalesce(avg((score - 1) / 4.0), 0.0) >= 0.6 THEN 1.0 ELSE 0.0 END AS passed FROM judged)
SELECT 'eval.judge.' || k AS metric, v AS value FROM (
  SELECT 'sample_count' AS k, sample_count AS v FROM agg UNION ALL SELECT 'mean_score', mean_score FROM agg
  UNION ALL SELECT 'p50_score', p50_score FROM agg UNION ALL SELECT 'passed', passed FROM agg)""")
def flatten_eval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``eval.<plugin>.<metric>`` numeric rows plus ``passed`` as 0/1."""
    j = eval_judge(spark, sf_dir)
    m = F.create_map(
        F.lit("sample_count"), F.col("sample_count").cast("double"), F.lit("mean_score"), F.col("mean_score"),
        F.lit("p50_score"), F.col("p50_score"), F.lit("passed"), F.col("passed").cast("double"),
    )
    return j.select(F.explode(m).alias("k", "value")).select(F.concat(F.lit("eval.judge."), "k").alias("metric"), "value")


@job("prompt_contract", sql="WITH " + ITEMS_SQL + r""",
c AS (SELECT sample_idx, trim(coalesce(question, '')) = '' AS no_prompt,
  regexp_replace(regexp_extract(question, '```helixschema\n([\s\S]*?)\n```', 1), '^@WS@+|@WS@+$', '', 'g') = '' AS no_schema,
  trim(coalesce(model_answer, '')) = '' AS no_reference FROM ev_items)
SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE NOT (no_prompt OR no_schema OR no_reference)) AS BIGINT) AS clean,
  CAST(count(*) FILTER (WHERE NOT (no_prompt OR no_schema OR no_reference)) AS DOUBLE) / count(*) AS ratio,
  CAST(count(*) FILTER (WHERE NOT (no_prompt OR no_schema OR no_reference)) AS DOUBLE) / count(*) >= 1.0 AS passed,
  CAST(count(*) FILTER (WHERE no_prompt) AS BIGINT) AS missing_prompt,
  CAST(count(*) FILTER (WHERE no_schema) AS BIGINT) AS missing_schema_context,
  CAST(count(*) FILTER (WHERE no_reference) AS BIGINT) AS missing_reference_answer
FROM c""")
def prompt_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without contract issues / rows >= 1.0 (prompt = question, schema context = fenced
    block, reference answer = the generated answer column)."""
    items = eval_items(Tables(spark, sf_dir))
    blank = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "") == ""
    c = items.select(
        blank(F.col("question")).alias("p"), (Q.fenced_schema("question") == "").alias("s"), blank(F.col("model_answer")).alias("r")
    )
    clean = ~(F.col("p") | F.col("s") | F.col("r"))
    g = c.agg(
        F.count(F.lit(1)).cast("bigint").alias("total"), F.count_if(clean).cast("bigint").alias("clean"),
        F.count_if("p").cast("bigint").alias("missing_prompt"), F.count_if("s").cast("bigint").alias("missing_schema_context"),
        F.count_if("r").cast("bigint").alias("missing_reference_answer"),
    )
    r = F.col("clean") / F.col("total")
    return g.select("total", "clean", r.alias("ratio"), (r >= 1.0).alias("passed"),
                    "missing_prompt", "missing_schema_context", "missing_reference_answer")
