"""Run parameters: texts to typed values, canonical names, merged sources.

Parameters of a run are a map of texts.  All rules are column expressions on
one exploded row a parameter; the choice among alternate names is a mergeable
``min_by`` on their order, so no run's parameters meet in a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finelens.functions.text import PY_BLANKS

# ---------------------------------------------------------------------------
# fixed values that must equal the reference: canonical name -> names it may have, first found wins
# ---------------------------------------------------------------------------
ALTERNATES = {
    "learning_rate": (
        "training.hyperparams.actual.learning_rate",
        "training.hyperparams.learning_rate",
        "config.training.learning_rate",
        "learning_rate",
        "lr",
    ),
    "batch_size": ("training.hyperparams.per_device_train_batch_size", "config.training.batch_size", "batch_size"),
    "model_name": ("config.model.name", "model_name"),
    "strategy_type": ("training.strategy_type", "chain_type", "strategy"),
    "grad_accum": (
        "training.hyperparams.gradient_accumulation_steps",
        "gradient_accumulation_steps",
        "config.training.hyperparams.gradient_accumulation_steps",
    ),
    "scheduler": ("training.hyperparams.lr_scheduler_type", "lr_scheduler_type", "learning_rate_scheduler"),
    "warmup_ratio": ("training.hyperparams.warmup_ratio", "warmup_ratio"),
}
# report field -> keys, the first that gives a value wins
FIELDS = {
    "batch_size": ("batch_size",),
    "learning_rate": ("learning_rate",),
    "grad_accum": ("grad_accum",),
    "scheduler": ("scheduler",),
    "warmup_ratio": ("warmup_ratio",),
    "num_epochs": ("num_epochs", "epochs"),
    "max_steps": ("max_steps",),
    "optimizer": ("optim", "optimizer"),
    "weight_decay": ("weight_decay",),
    "fp16": ("fp16",),
    "bf16": ("bf16",),
    "gradient_checkpointing": ("gradient_checkpointing",),
}

_DIGITS = r"[0-9]+(_[0-9]+)*"
WHOLE = rf"^[+-]?{_DIGITS}$"
REAL = rf"^[+-]?({_DIGITS}(\.({_DIGITS})?)?|\.{_DIGITS})([eE][+-]?{_DIGITS})?$"
SPECIAL = r"^[+-]?([nN][aA][nN]|[iI][nN][fF]([iI][nN][iI][tT][yY])?)$"
#: How a number starts: what does not needs none of the patterns above.
NUMERIC = r"^[+-]?[0-9.iInN]"


def _strip(text: Column) -> Column:
    """``py_strip`` for short texts, without a pattern."""
    return F.btrim(text, F.lit(PY_BLANKS))


def _digits(text: Column) -> Column:
    return F.replace(text, F.lit("_"), F.lit(""))


def _real(text: Column) -> Column:
    """The double that a number text stands for; nan and infinities included."""
    special = F.regexp_replace(F.regexp_replace(F.lower(text), "inf(inity)?", "Infinity"), "[+-]?nan", "NaN")
    return F.when(text.rlike(REAL), _digits(text).try_cast("double")).when(text.rlike(SPECIAL), special.try_cast("double"))


def _typed(kind: Column, text: Column, flag: Column, whole: Column, real: Column) -> Column:
    return F.struct(
        kind.alias("kind"),
        F.when(kind == "bool", flag).alias("bool_value"),
        F.when(kind == "int", whole).alias("int_value"),
        F.when(kind == "float", real).alias("float_value"),
        F.when(kind == "string", text).alias("text_value"),
    )


def _kind(text: Column, s: Column) -> Column:
    """Kind of a parameter text; ``s``: the text without blanks around it."""
    return (
        F.when(text.isNull(), F.lit("null"))
        .when(F.lower(text).isin("true", "false"), "bool")
        .when(~s.rlike(NUMERIC), "string")
        .when(s.rlike(WHOLE), "int")
        .when(s.rlike(REAL) | s.rlike(SPECIAL), "float")
        .otherwise("string")
    )


def parse_value(text: Column, s: Column | None = None, kind: Column | None = None) -> Column:
    """kind and value of a parameter text: true / false, whole number, number, else the text itself.

    Numbers may have blanks around them and single underscores between digits.  A whole
    number beyond 64 bits keeps its kind, with a null value.  ``s``, ``kind``: where they are at hand.
    """
    s = _strip(text) if s is None else s
    kind = _kind(text, s) if kind is None else kind
    return _typed(kind, text, F.lower(text) == "true", _digits(s).try_cast("bigint"), _real(s))


def with_value(rows: DataFrame, text: str = "raw") -> DataFrame:
    """``rows`` with ``value``: ``parse_value`` of a column, each step of it evaluated once a row."""
    at = F.col(text)
    steps = rows.withColumn("_s", _strip(at)).withColumn("_kind", _kind(at, F.col("_s")))
    return steps.withColumn("value", parse_value(at, F.col("_s"), F.col("_kind"))).drop("_s", "_kind")


def _scalar(s: Column) -> Column:
    """As ``parse_value`` for configuration dumps: stripped, none is null, only texts with a point are floats."""
    low = F.lower(s)
    dotted = F.when(s.contains("."), _real(s))
    kind = (
        F.when(s.isNull() | (low == "none"), F.lit("null"))
        .when(low.isin("true", "false"), "bool")
        .when(~s.rlike(NUMERIC), "string")
        .when(s.rlike(WHOLE), "int")
        .when(dotted.isNotNull(), "float")
        .otherwise("string")
    )
    return _typed(kind, s, low == "true", _digits(s).try_cast("bigint"), dotted)


def convert_param(text: Column) -> Column:
    """(value, items): a dump's value; a text with commas that is no number is a list of such values.

    ``value.kind`` is ``list`` then, and ``items`` is null for anything else.
    """
    s = _strip(text)
    one = _scalar(s)
    many = (one["kind"] == "string") & s.contains(",")
    listed = F.struct(F.lit("list").alias("kind"), *[F.lit(None).cast(t).alias(n) for n, t in _VALUE_TYPES])
    return F.struct(
        F.when(many, listed).otherwise(one).alias("value"),
        F.when(many, F.transform(F.split(s, ","), lambda x: _scalar(_strip(x)))).alias("items"),
    )


_VALUE_TYPES = (("bool_value", "boolean"), ("int_value", "bigint"), ("float_value", "double"), ("text_value", "string"))


def normalize_params(runs: DataFrame, run: str = "run_id") -> DataFrame:
    """One row per (run, name): canonical names first, then every original name that is not one of them.

    ``runs``: run, params (map of texts).  ``source_key`` is the name the value was given
    under; ``value`` is typed by ``parse_value``.  A null text counts as absent.
    """
    # outer: else Spark filters by the size of the map first, and so builds it twice
    raw = runs.select(run, F.explode_outer("params").alias("source_key", "raw")).where(F.col("raw").isNotNull())
    keys = list(dict.fromkeys(k for ks in ALTERNATES.values() for k in ks))
    places = F.create_map(
        *[
            x
            for key in keys
            for x in (
                F.lit(key),
                F.array(*[F.struct(F.lit(n).alias("name"), F.lit(ks.index(key)).alias("pos")) for n, ks in ALTERNATES.items() if key in ks]),
            )
        ]
    )
    known = raw.where(F.col("source_key").isin(*keys))
    hits = known.select(run, "source_key", "raw", F.explode_outer(F.element_at(places, F.col("source_key"))).alias("at"))
    chosen = hits.groupBy(run, F.col("at.name").alias("name")).agg(F.min_by(F.struct("source_key", "raw"), "at.pos").alias("b"))
    chosen = chosen.select(run, "name", "b.*")
    # an original name that is canonical too is covered if it is among its own alternates, or if the run gives any of them;
    # a null run is equal to no other, so nothing covers its names
    own = raw.select(run, F.col("source_key").alias("name"), "source_key", "raw")
    rest = own.where(~F.col("name").isin(*ALTERNATES) | F.col(run).isNull())
    apart = {n: ks for n, ks in ALTERNATES.items() if n not in ks}
    left = own.where(F.col("name").isin(*apart) & F.col(run).isNotNull())
    covers = raw.where(F.col("source_key").isin(*[k for ks in apart.values() for k in ks]) & F.col(run).isNotNull())
    named = F.coalesce(*[F.when(F.col("source_key").isin(*ks), F.lit(n)) for n, ks in apart.items()])
    rest = rest.unionByName(left.join(covers.select(run, named.alias("name")), [run, "name"], "left_anti"))
    return with_value(chosen.unionByName(rest))


def truthy(text: Column) -> Column:
    """Whether the typed value of a text counts as given: not null, false, zero or empty."""
    s = _strip(text)
    number = F.when(s.rlike(REAL), _digits(s).try_cast("double") != 0).otherwise(True)
    return F.when(text.isNull() | (text == "") | (F.lower(text) == "false"), False).when(s.rlike(NUMERIC), number).otherwise(True)


def merge_params(sources: DataFrame, run: str = "run_id") -> DataFrame:
    """The report's configuration fields: for each the first key, then the first source, that gives a value.

    ``sources``: run, precedence (0 is first), source, params (map of texts), typed (whether the
    source's texts stand for typed values, so that "0" and "false" do not count).
    """
    # outer: else Spark filters by the size of the map first, and so builds it twice
    raw = sources.select(run, "precedence", "source", "typed", F.explode_outer("params").alias("key", "raw"))
    raw = raw.where(F.col("raw").isNotNull() & F.col("key").isin(*[k for keys in FIELDS.values() for k in keys]))
    given = F.when(F.col("typed"), truthy(F.col("raw"))).otherwise(F.col("raw") != "")
    fields = F.create_map(
        *[
            x
            for field, keys in FIELDS.items()
            for i, key in enumerate(keys)
            for x in (F.lit(key), F.struct(F.lit(field).alias("field"), F.lit(i).alias("pos")))
        ]
    )
    found = raw.where(given).withColumn("f", F.element_at(fields, F.col("key")))
    best = found.groupBy(run, F.col("f.field").alias("field")).agg(
        F.min_by(F.struct("key", "source", "raw"), F.struct(F.col("f.pos"), F.col("precedence"))).alias("b")
    )
    return best.select(run, "field", "b.key", "b.source", "b.raw")
