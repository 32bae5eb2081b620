"""File readers: JSON / JSONL datasets with row numbers, evaluation JSONL with bad lines,
any-format loading by suffix, per-file statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from finelens.operators.ordering import with_position


def _in_order(df: DataFrame, name: str) -> DataFrame:
    """``df`` of a file source with ``name``: the row's place by path, then place in the file."""
    rows = df.select(
        "*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_at"),
    )
    # a block is read by one task, in order
    return with_position(rows, [], [F.col("_path"), F.col("_block"), F.col("_at")], name).drop("_path", "_block", "_at")


def is_json_array(spark: SparkSession, path: str) -> bool:
    """Whether a JSON file (or the files of a folder) holds an array rather than a document a line."""
    first = spark.read.text(path).where(F.trim("value") != "").select(F.left(F.ltrim("value"), F.lit(1)).alias("c")).first()
    return first is not None and first["c"] == "["


def read_json_dataset(
    spark: SparkSession, path: str, multiline: bool | None = None, schema=None, row_idx: str | None = None, head: int | None = None
) -> DataFrame:
    """JSONL or JSON array files; schema inferred unless given.

    ``multiline``: arrays; None looks at the first character.  ``row_idx`` names a column for
    the place of a row over all files in path order, from 0; ``head`` keeps the first so many rows.
    """
    if multiline is None:
        multiline = is_json_array(spark, path)
    r = spark.read.option("multiLine", multiline)
    if schema is not None:
        r = r.schema(schema)
    df = r.json(path)
    if row_idx is None and head is None:
        return df
    placed = _in_order(df, row_idx or "_row")
    if head is not None:
        placed = placed.where(F.col(row_idx or "_row") < head)
    return placed if row_idx else placed.drop("_row")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, line_no (from 1 in each file), line."""
    lines = spark.read.text(path).select(
        F.col("value").alias("line"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_at"),
    )
    placed = with_position(lines, ["path"], [F.col("_block"), F.col("_at")], "line_no")
    return placed.select("path", (F.col("line_no") + 1).alias("line_no"), "line")


def read_eval_jsonl(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(good rows with path and line_no, bad lines with theirs and their text).

    Blank lines are skipped but counted; a line that is no JSON object is a bad one
    and fails nothing.  Both frames read one checkpoint of the numbered lines, nothing stays cached.
    """
    lines = read_lines(spark, path).where(F.trim("line") != "")
    parsed = lines.withColumn("_row", F.when(is_json_object(F.col("line")), F.from_json("line", schema)))
    good = parsed.where(F.col("_row").isNotNull()).select("path", "line_no", "_row.*")
    bad = parsed.where(F.col("_row").isNull()).select("path", "line_no", "line")
    return good, bad


def is_json_object(text: Column) -> Column:
    return F.ltrim(text).startswith("{") & F.try_parse_json(text).isNotNull()


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """Load JSONL / JSON (documents a line, or an array) / CSV / Parquet by suffix."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix == "jsonl":
        return spark.read.json(path)
    if suffix == "json":
        return read_json_dataset(spark, path)
    if suffix == "csv":
        return spark.read.option("header", True).csv(path)
    if suffix == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"unsupported file type: {suffix}")


def file_stats(spark: SparkSession, path: str) -> DataFrame:
    """Per file: size in bytes and MB, extension, line count (one pass over the lines)."""
    t = spark.read.text(path).select("_metadata.file_path", "_metadata.file_size")
    g = t.groupBy("file_path", "file_size").agg(F.count(F.lit(1)).cast("bigint").alias("line_count"))
    return g.select(
        "file_path",
        F.col("file_size").alias("size_bytes"),
        (F.col("file_size") / F.lit(1024.0 * 1024.0)).alias("size_mb"),
        F.regexp_extract("file_path", r"(\.[^./]+)$", 1).alias("extension"),
        "line_count",
    )
