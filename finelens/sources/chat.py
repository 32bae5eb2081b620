"""Chat datasets: long-form turns -> one row per conversation with a
``messages ARRAY<STRUCT<role, content>>`` column ordered by turn."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finelens.sources.tables import Tables


def messages_from_turns(turns: DataFrame, key: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Group turns into an ordered messages array (a conversation is a bounded group)."""
    packed = F.struct(F.col(turn).alias("turn"), F.col("role").alias("role"), F.col("text").alias("content"))
    g = turns.groupBy(key).agg(F.array_sort(F.collect_list(packed)).alias("_m"))
    msgs = F.transform("_m", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    return g.select(F.col(key).alias("row_idx"), msgs.alias("messages"))


def chat_samples(t: Tables) -> DataFrame:
    return messages_from_turns(t.conversations)
