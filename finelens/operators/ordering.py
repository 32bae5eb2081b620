"""Positions of rows inside groups of any size, without a task that holds a group.

``row_number`` over a group sorts the group in one task.  Here rows are dealt
by ranges of (group, order), so a group of a third of all rows spans many
tasks; the rows of each range are counted by group and the counts added up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finelens.session import ensure_checkpoint_dir

#: Rows a range should hold.
RANGE_ROWS = 1 << 20


def with_position(df: DataFrame, by: list[str], order: list[Column], name: str, expected_rows: int | None = None) -> DataFrame:
    """``df`` with ``name``: the row's place, from 0, among the rows of its group in ``order``.

    ``order`` must be total for a result that does not depend on the layout.  The dealt rows
    are checkpointed, since their numbers must not change between the two reads of them.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    ranges = max(spark.sparkContext.defaultParallelism, (expected_rows or 0) // RANGE_ROWS)
    keys = [*[F.col(b) for b in by], *order]
    dealt = df.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys)
    rows = dealt.withColumn("_at", F.monotonically_increasing_id()).checkpoint()
    rows = rows.withColumn("_range", F.shiftright("_at", 33))
    counts = rows.groupBy(*by, "_range").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        *[F.col(b).alias(f"_g_{b}") for b in by], F.col("_range").alias("_r"), "_first",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
    )
    same = F.col("_range") == F.col("_r")
    for b in by:
        same &= F.col(b).eqNullSafe(F.col(f"_g_{b}"))
    return rows.join(starts, same).select(*df.columns, (F.col("_at") - F.col("_first") + F.col("_before")).alias(name))
