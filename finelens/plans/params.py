"""Jobs on run parameters.

Stand-in (fixed rules): a run is an order; its root params are texts whose
presence, name and form follow the order key (``PARAMS`` below: name, when it is
given, its text).  Phase params and a source config of the same run overlay them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finelens.operators import params as P
from finelens.plans.registry import job
from finelens.sources.tables import Tables

#: (name, condition, text) over the order key; the expressions mean the same in Spark and DuckDB.
PARAMS = [
    ("training.hyperparams.actual.learning_rate", "o_orderkey % 7 = 0", "'0.000' || CAST(o_orderkey % 89 + 1 AS STRING)"),
    ("config.training.learning_rate", "o_orderkey % 3 = 0", "'2e-' || CAST(o_orderkey % 5 + 1 AS STRING)"),
    ("learning_rate", "o_orderkey % 2 = 0", "CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE ' 1_0.5 ' END"),
    ("lr", "o_orderkey % 5 = 0", "'.5'"),
    ("training.hyperparams.per_device_train_batch_size", "o_orderkey % 4 = 1", "' +8 '"),
    ("batch_size", "o_orderkey % 2 = 1", "CASE WHEN o_orderkey % 9 = 1 THEN '1_024' ELSE CAST(o_orderkey % 64 AS STRING) END"),
    ("model_name", "o_orderkey % 11 <> 0", "CASE WHEN o_orderkey % 6 = 0 THEN 'TRUE' ELSE o_orderpriority END"),
    ("strategy", "o_orderkey % 13 <> 0", "CASE WHEN o_orderkey % 3 = 0 THEN 'sft, 2.5,None , true,7' ELSE 'dpo' END"),
    ("chain_type", "o_orderkey % 10 = 3", "'cpt,sft'"),
    ("gradient_accumulation_steps", "o_orderkey % 8 = 2", "'4'"),
    ("grad_accum", "o_orderkey % 4 = 2", "'-1.5e3'"),
    ("scheduler", "o_orderkey % 6 = 5", "'None'"),
    ("lr_scheduler_type", "o_orderkey % 12 = 5", "'cosine'"),
    ("warmup_ratio", "o_orderkey % 5 = 2", "CASE WHEN o_orderkey % 2 = 0 THEN '1__0' ELSE '0.' END"),
    ("fp16", "o_orderkey % 4 = 0", "CASE WHEN o_orderkey % 8 = 0 THEN 'False' ELSE 'true' END"),
    ("epochs", "o_orderkey % 3 = 1", "CAST(o_orderkey % 4 AS STRING)"),
    ("num_epochs", "o_orderkey % 6 = 1", "'0'"),
    ("total", "true", "CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING)"),
]

PARAM_ROWS = ", ".join(f"struct('{n}' AS key, CASE WHEN {c} THEN {t} END AS raw)" for n, c, t in PARAMS)
PARAM_SQL = "p AS (" + " UNION ALL ".join(
    f"SELECT o_orderkey AS run_id, '{n}' AS source_key, {t} AS raw FROM orders WHERE {c}" for n, c, t in PARAMS
) + ")"


def run_params(t: Tables) -> DataFrame:
    rows = t.orders.select(
        F.col("o_orderkey").alias("run_id"), F.expr(f"filter(array({PARAM_ROWS}), x -> x.raw IS NOT NULL)").alias("kv")
    )
    return rows.select("run_id", F.map_from_entries("kv").alias("params"))


PLACES = ", ".join(f"('{k}', '{n}', {i})" for n, keys in P.ALTERNATES.items() for i, k in enumerate(keys))
CANONICAL = ", ".join(f"'{n}'" for n in P.ALTERNATES)
FLOATY = r"regexp_full_match(s, '[+-]?([0-9]+(_[0-9]+)*(\.([0-9]+(_[0-9]+)*)?)?|\.[0-9]+(_[0-9]+)*)([eE][+-]?[0-9]+(_[0-9]+)*)?')"
WHOLE = "regexp_full_match(s, '[+-]?[0-9]+(_[0-9]+)*')"


def _value_sql(kind: str, text: str) -> str:
    return f"""{kind} AS kind, CASE WHEN {kind} = 'bool' THEN lower({text}) = 'true' END AS bool_value,
  CASE WHEN {kind} = 'int' THEN TRY_CAST(replace(s, '_', '') AS BIGINT) END AS int_value,
  CASE WHEN {kind} = 'float' THEN TRY_CAST(replace(s, '_', '') AS DOUBLE) END AS float_value,
  CASE WHEN {kind} = 'string' THEN {text} END AS text_value"""


NORM_SQL = PARAM_SQL + f""",
places(source_key, name, pos) AS (VALUES {PLACES}),
chosen AS (SELECT run_id, name, arg_min(source_key, pos) AS source_key, arg_min(raw, pos) AS raw FROM p JOIN places USING (source_key)
  GROUP BY run_id, name),
named AS (SELECT run_id, name, source_key, raw FROM chosen
  UNION ALL SELECT run_id, source_key, source_key, raw FROM p
  WHERE NOT EXISTS (SELECT 1 FROM chosen c WHERE c.run_id = p.run_id AND c.name = p.source_key)),
tx AS (SELECT *, regexp_replace(raw, '^@WS@+|@WS@+$', '', 'g') AS s FROM named)"""

PARSE_KIND = f"CASE WHEN lower(raw) IN ('true', 'false') THEN 'bool' WHEN {WHOLE} THEN 'int' WHEN {FLOATY} THEN 'float' ELSE 'string' END"
DUMP_KIND = f"""CASE WHEN lower(s) = 'none' THEN 'null' WHEN lower(s) IN ('true', 'false') THEN 'bool' WHEN {WHOLE} THEN 'int'
  WHEN contains(s, '.') AND {FLOATY} THEN 'float' WHEN contains(s, ',') THEN 'list' ELSE 'string' END"""


@job("normalize_params", sql="WITH " + NORM_SQL + f"""
SELECT run_id, name, source_key, raw, {_value_sql(PARSE_KIND, 'raw')} FROM tx""")
def normalize_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per run and parameter: canonical name, the name it was given under, typed value."""
    n = P.normalize_params(run_params(Tables(spark, sf_dir)))
    return n.select("run_id", "name", "source_key", "raw", "value.*")


@job("convert_params", sql="WITH " + PARAM_SQL + f""",
tx AS (SELECT run_id, source_key AS key, regexp_replace(raw, '^@WS@+|@WS@+$', '', 'g') AS s FROM p),
k AS (SELECT *, {DUMP_KIND} AS k0 FROM tx)
SELECT run_id, key, -1 AS item, {_value_sql('k0', 's')} FROM k
UNION ALL
SELECT run_id, key, item, {_value_sql('(' + DUMP_KIND + ')', 's')} FROM (
  SELECT run_id, key, generate_subscripts(string_split(s, ','), 1)::INTEGER - 1 AS item,
         regexp_replace(unnest(string_split(s, ',')), '^@WS@+|@WS@+$', '', 'g') AS s FROM k WHERE k0 = 'list')""")
def convert_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of a configuration dump: one row per run and parameter (item -1), and one per element of a list."""
    rows = run_params(Tables(spark, sf_dir)).select("run_id", F.explode("params").alias("key", "raw"))
    c = rows.select("run_id", "key", P.convert_param(F.col("raw")).alias("c"))
    whole = c.select("run_id", "key", F.lit(-1).alias("item"), "c.value.*")
    items = c.select("run_id", "key", F.posexplode("c.items").alias("item", "v")).select("run_id", "key", "item", "v.*")
    return whole.unionByName(items)


#: The overlays of a run: phase params are typed, root params are texts, the source config is typed.
SOURCES = [("phase", "o_orderkey % 3 <> 2", True), ("root", "true", False), ("source", "true", True)]
OVERLAY = {
    "phase": "CASE WHEN o_orderkey % 2 = 0 THEN raw END",
    "root": "CASE WHEN o_orderkey % 3 <> 0 THEN raw END",
    "source": "'src ' || raw",
}


@job("merge_params", sql="WITH " + PARAM_SQL + ", s AS (" + " UNION ALL ".join(
    f"SELECT run_id, {i} AS precedence, '{n}' AS source, {str(typed).lower()} AS typed, source_key AS key, "
    f"{OVERLAY[n].replace('o_orderkey', 'run_id')} AS raw FROM p WHERE {c.replace('o_orderkey', 'run_id')}"
    for i, (n, c, typed) in enumerate(SOURCES)
) + f"""),
t AS (SELECT *, regexp_replace(raw, '^@WS@+|@WS@+$', '', 'g') AS s FROM s WHERE raw IS NOT NULL),
g AS (SELECT * FROM t WHERE CASE WHEN NOT typed THEN raw <> '' ELSE CASE {PARSE_KIND}
  WHEN 'bool' THEN lower(raw) = 'true' WHEN 'int' THEN CAST(replace(s, '_', '') AS BIGINT) <> 0
  WHEN 'float' THEN CAST(replace(s, '_', '') AS DOUBLE) <> 0 ELSE raw <> '' END END),
f(key, field, pos) AS (VALUES {", ".join(f"('{k}', '{n}', {i})" for n, keys in P.FIELDS.items() for i, k in enumerate(keys))})
SELECT run_id, field, arg_min(key, (pos, precedence)) AS key, arg_min(source, (pos, precedence)) AS source,
  arg_min(raw, (pos, precedence)) AS raw FROM g JOIN f USING (key) GROUP BY run_id, field""")
def merge_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The configuration fields of each run with the source that decides them."""
    given = Tables(spark, sf_dir).orders.select("o_orderkey", F.expr(f"filter(array({PARAM_ROWS}), x -> x.raw IS NOT NULL)").alias("given"))
    rows = given.select(
        F.col("o_orderkey").alias("run_id"),
        F.expr("inline(array(" + ", ".join(
            f"struct({i} AS precedence, '{n}' AS source, {str(typed).lower()} AS typed, "
            f"CASE WHEN {c} THEN transform(given, x -> struct(x.key AS key, {OVERLAY[n].replace('raw', 'x.raw')} AS raw)) END AS kv)"
            for i, (n, c, typed) in enumerate(SOURCES)
        ) + "))"),
    )
    sources = rows.where("kv IS NOT NULL").select("run_id", "precedence", "source", "typed", F.map_from_entries("kv").alias("params"))
    return P.merge_params(sources)
