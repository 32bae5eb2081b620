"""Registry of named jobs over the driver tables.

Each job is ``fn(spark, sf_dir) -> DataFrame``; most also carry an
equivalent DuckDB SQL text over the same parquet tables (the oracle).  SQL
templates may use ``@WS@`` for the Python whitespace class.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from finelens.functions.text import PY_WS

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def render_sql(sql: str) -> str:
    return sql.replace("@WS@", PY_WS)


def job(name: str, sql: str | None = None):
    """Register ``fn`` under ``name`` with an optional oracle SQL."""

    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate job {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = render_sql(sql)
        return fn

    return deco


def load_all() -> None:
    """Import every plan module so their jobs register."""
    from finelens.plans import chat_eval, datasets, evaluation, events, io, machines, metrics, params, phases, records, reports, runs, streams, validation  # noqa: F401
