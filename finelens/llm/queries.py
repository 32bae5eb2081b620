"""Registered queries of the subpackage: ``opN_<name>`` and their DuckDB SQL.

Each query reads its whole table and is a thin reading of its operator's
output.  Operators that SQL cannot express have no entry in ORACLES; their
results are held against brute force in ``tests/llm``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finelens.llm import (
    best_position,
    exact_dedup,
    hyperminhash,
    kd_shards,
    merge_replay,
    packing,
    periodic_runs,
    pii_surrogates,
    quality_rules,
    repair,
    reply_trees,
    toxicity_mil,
    warc_derivatives,
)
from finelens.llm.common import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return deco


EXACT_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""


@query("op5_exact_tree_merge", EXACT_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(read_table(spark, sf_dir, "documents"))


QUALITY_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
base AS (
  SELECT doc_id, text,
         list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(text, chr(10)), lambda x: translate(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '') <> '') AS lines,
         translate(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '') AS solid
  FROM t
),
win AS (
  SELECT doc_id, i, array_to_string(words[i:i + 4], ' ') AS gram
  FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 4)) AS i FROM base WHERE len(words) >= 5)
),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM win) WHERE c > 1),
cov AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + 4)) AS p FROM dup) GROUP BY doc_id
),
line AS (
  SELECT doc_id, regexp_replace(l, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS s, l
  FROM (SELECT doc_id, unnest(lines) AS l FROM base)
),
judged AS (
  SELECT doc_id, length(translate(l, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS chars,
    (NOT regexp_matches(s, '@END@') AND len(regexp_split_to_array(s, '[\x20\x09-\x0D]+')) < @MIN_LINE@)
    OR (length(s) - length(translate(s, '@SYM@', '')) > @SHARE@ * length(s))
    OR (length(s) - length(translate(s, '|»›·', '')) >= 2)
    OR (len(regexp_split_to_array(s, '[\x20\x09-\x0D]+')) <= @MAX_NAV@ AND regexp_matches(lower(s), '@NAV@'))
    OR (len(regexp_split_to_array(s, '[\x20\x09-\x0D]+')) <= @MAX_BOILER@ AND regexp_matches(lower(s), '@BOILER@')) AS failed
  FROM line
),
lines AS (
  SELECT doc_id, sum(CASE WHEN failed THEN 0 ELSE chars END) AS good_chars,
         count(*) FILTER (WHERE failed) AS n_lines_removed
  FROM judged GROUP BY doc_id
),
counts AS (
  SELECT b.doc_id, len(words) AS n_words, length(solid) AS word_chars,
         length(text) - length(translate(text, '@SYM@', '')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(cov.n, 0) AS n_repeat_words,
         coalesce(l.good_chars, 0) AS good_chars, coalesce(l.n_lines_removed, 0) AS n_lines_removed
  FROM base b LEFT JOIN cov USING (doc_id) LEFT JOIN lines l USING (doc_id)
),
verdict AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counts
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars - good_chars <= @LOSS@ * word_chars AS kept, n_lines_removed
FROM verdict
"""


def quality_sql() -> str:
    q, sql = quality_rules, QUALITY_SQL
    for key, value in {
        "@END@": q.END_MARKS,
        "@NAV@": q.NAVIGATION,
        "@BOILER@": q.BOILERPLATE,
        "@SYM@": q.SYMBOLS,
        "@MIN_LINE@": str(q.MIN_LINE_WORDS),
        "@MAX_NAV@": str(q.MAX_NAVIGATION_WORDS),
        "@MAX_BOILER@": str(q.MAX_BOILERPLATE_WORDS),
        "@SHARE@": str(q.MAX_SYMBOL_SHARE),
        "@LOSS@": str(q.MAX_LOSS),
    }.items():
        sql = sql.replace(key, value.replace("'", "''"))
    return sql


@query("op6_line_first_quality", quality_sql())
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge_documents(read_table(spark, sf_dir, "documents"))


@query("op2_hyperminhash")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperminhash.near_groups(read_table(spark, sf_dir, "documents"))


@query("op3_pii_surrogates")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii_surrogates.replaced(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "text", F.size("__pii").cast("long").alias("n_entities"), F.col("__pii").alias("entities"))


@query("op9_certified_packing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(read_table(spark, sf_dir, "documents"))


@query("op7_repair_tokens")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.round_trip(read_table(spark, sf_dir, "documents"))


@query("op10_bpe_merge_replay")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_replay.encoded(read_table(spark, sf_dir, "documents"))


@query("op8_toxicity_mil")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_mil.scored(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


THREADS_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
),
e AS (
  SELECT *, regexp_replace(text, '@CONTROL@', '\1\\\2\3', 'g') AS esc,
         regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '@CONTROL@', '\1\\\2\3', 'g') AS esc_role
  FROM c
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
       sum(length(esc_role) + length(esc) + 24)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
""".replace("@CONTROL@", reply_trees._FIRST + r"(\\*)" + reply_trees._REST)


@query("op4_reply_trees", THREADS_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame(
        [(-1, 0, "user", control), (-1, 1, "assistant", control)], "conv_id long, turn long, role string, text string"
    )
    return reply_trees.conversation_digests(rows.unionByName(extra))


@query("op1_warc_derivatives")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = warc_derivatives.responses(read_table(spark, sf_dir, "pages"))
    return warc_derivatives.checked(warc_derivatives.round_trip(rows))


#: CRC-32 of UTF-8 bytes by its table, then four levels of weighted splits.
KD_SQL = r"""
WITH RECURSIVE crc(n, k, c) AS (
  SELECT range, 0, range FROM range(256)
  UNION ALL
  SELECT n, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc WHERE k < 8
),
tab AS (SELECT list(c ORDER BY n) AS t FROM crc WHERE k = 8),
p0 AS (
  SELECT doc_id, coalesce(doc_id, -9223372036854775808) AS id, octet_length(encode(coalesce(text, ''))) + 1 AS size,
    xor(4294967295, list_reduce(
      list_prepend(4294967295::BIGINT,
                   list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS crc,
    ('0x' || rpad(substr(hex(encode(coalesce(lang, ''))), 1, 12), 12, '0'))::BIGINT AS d0,
    ('0x' || rpad(substr(hex(encode(coalesce(source, ''))), 1, 12), 12, '0'))::BIGINT AS d1,
    size AS d2, 0 AS shard
  FROM documents, tab
),
g AS (
  SELECT greatest(1, max(d0) - min(d0)) AS g0, greatest(1, max(d1) - min(d1)) AS g1, greatest(1, max(d2) - min(d2)) AS g2
  FROM p0
),
@LEVELS@
SELECT doc_id, size::BIGINT AS size, crc AS text_crc32, 'bytes' AS law, shard::INTEGER AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY id, crc) - 1 AS slot, NULL::INTEGER AS grown_shard
FROM p@DEPTH@
"""

KD_LEVEL = """
r@L@ AS (
  SELECT p.*, sum(size) OVER w AS bytes, (max(d0) OVER w - min(d0) OVER w)::DOUBLE / g0 AS w0,
         (max(d1) OVER w - min(d1) OVER w)::DOUBLE / g1 AS w1, (max(d2) OVER w - min(d2) OVER w)::DOUBLE / g2 AS w2
  FROM p@L@ AS p, g WINDOW w AS (PARTITION BY shard)
),
c@L@ AS (SELECT *, CASE WHEN w0 >= w1 AND w0 >= w2 THEN d0 WHEN w1 >= w2 THEN d1 ELSE d2 END AS c FROM r@L@),
s@L@ AS (
  SELECT *, sum(size) OVER (PARTITION BY shard ORDER BY c, id, crc ROWS UNBOUNDED PRECEDING) - size AS before FROM c@L@
),
p@N@ AS (
  SELECT doc_id, id, size, crc, d0, d1, d2,
         shard + CASE WHEN 2 * (bytes * @HALF@ - before * @K@) >= size * @K@ THEN 0 ELSE @HALF@ END AS shard
  FROM s@L@
)"""


def kd_sql(shards: int = kd_shards.SHARDS) -> str:
    """The tree of ``shards`` (a power of two) leaves, level by level."""
    depth = shards.bit_length() - 1
    levels = [
        KD_LEVEL.replace("@L@", str(i)).replace("@N@", str(i + 1)).replace("@K@", str(shards >> i)).replace("@HALF@", str(shards >> i + 1))
        for i in range(depth)
    ]
    return KD_SQL.replace("@LEVELS@", ",".join(levels)).replace("@DEPTH@", str(depth))


@query("op11_kd_shards", kd_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = kd_shards.shard_rows(read_table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query("op12_periodic_runs")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = periodic_runs.with_planted_period(read_table(spark, sf_dir, "documents"))
    return periodic_runs.run_digests(periodic_runs.periodic_runs(rows))


BEST_SQL = r"""
WITH terms AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '@UPPER@', '@LOWER@'), '@TERM@') AS t FROM documents
),
stat AS (SELECT count(*) FILTER (len(t) > 0) AS n_docs, sum(len(t))::BIGINT AS n_terms FROM terms),
tf AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM terms) GROUP BY ALL),
df AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, stat GROUP BY term, n_docs
),
q AS (
  SELECT item_id, term, count(*) AS repeats
  FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '@UPPER@', '@LOWER@'), '@TERM@')) AS term
        FROM (SELECT DISTINCT item_id, text FROM benchmark))
  GROUP BY ALL
),
scored AS (
  SELECT item_id, doc_id,
         sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM q JOIN df USING (term) JOIN tf USING (term), stat
  GROUP BY ALL
),
ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
  FROM scored WHERE score > 0
)
SELECT * FROM ranked WHERE rank <= @K@
"""


def best_sql() -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    sql = BEST_SQL.replace("@UPPER@", upper).replace("@LOWER@", upper.lower()).replace("@K@", str(best_position.K))
    return sql.replace("@TERM@", best_position.TERM.pattern)


@query("op13_best_position", best_sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_position.best_documents(read_table(spark, sf_dir, "benchmark"), read_table(spark, sf_dir, "documents"))
