"""Chat-derived evaluation jobs (``conversations``): role texts, eval
sample fields and the sample / model-answer join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finelens.plans.registry import job
from finelens.sources.tables import Tables


def role_texts(turns: DataFrame) -> DataFrame:
    """Per conversation: first / last user and assistant text (one aggregation,
    a conversation is a bounded group)."""
    u = F.col("role") == "user"
    a = F.col("role") == "assistant"
    txt = F.coalesce(F.col("text"), F.lit(""))
    return turns.groupBy("conv_id").agg(
        F.min_by(F.when(u, txt), F.when(u, F.col("turn"))).alias("first_user"),
        F.max_by(F.when(u, txt), F.when(u, F.col("turn"))).alias("last_user"),
        F.min_by(F.when(a, txt), F.when(a, F.col("turn"))).alias("first_assistant"),
        F.max_by(F.when(a, txt), F.when(a, F.col("turn"))).alias("last_assistant"),
        # evaluation takes the first *non-empty* user text as the question
        F.min_by(F.when(u & (txt != ""), txt), F.when(u & (txt != ""), F.col("turn"))).alias("question"),
    )


def chat_eval_samples(t: Tables) -> DataFrame:
    """question = first non-empty user text, expected = first assistant text,
    model answer = last assistant text; rows without a question are dropped."""
    r = role_texts(t.conversations)
    return r.where(F.col("question").isNotNull() & (F.col("question") != "")).select(
        F.col("conv_id").alias("sample_idx"),
        "question",
        F.col("first_assistant").alias("expected_answer"),
        F.coalesce(F.col("last_assistant"), F.lit("")).alias("model_answer"),
    )


ROLE_SQL = """rt AS (SELECT conv_id,
  arg_min(coalesce(text, ''), turn) FILTER (WHERE role = 'user') AS first_user,
  arg_max(coalesce(text, ''), turn) FILTER (WHERE role = 'user') AS last_user,
  arg_min(coalesce(text, ''), turn) FILTER (WHERE role = 'assistant') AS first_assistant,
  arg_max(coalesce(text, ''), turn) FILTER (WHERE role = 'assistant') AS last_assistant,
  arg_min(coalesce(text, ''), turn) FILTER (WHERE role = 'user' AND coalesce(text, '') <> '') AS question
  FROM conversations GROUP BY conv_id)"""


@job("first_role_text", sql="WITH " + ROLE_SQL + " SELECT conv_id, first_user, first_assistant FROM rt")
def first_role_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return role_texts(Tables(spark, sf_dir).conversations).select("conv_id", "first_user", "first_assistant")


@job("last_role_text", sql="WITH " + ROLE_SQL + " SELECT conv_id, last_user, last_assistant FROM rt")
def last_role_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return role_texts(Tables(spark, sf_dir).conversations).select("conv_id", "last_user", "last_assistant")


@job("eval_sample_fields", sql="WITH " + ROLE_SQL + """
SELECT conv_id AS sample_idx, question, first_assistant AS expected_answer, coalesce(last_assistant, '') AS model_answer
FROM rt WHERE question IS NOT NULL AND question <> ''""")
def eval_sample_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_eval_samples(Tables(spark, sf_dir))


@job("join_model_answers", sql="WITH " + ROLE_SQL + """,
s AS (SELECT conv_id AS sample_idx, question, first_assistant AS expected_answer FROM rt
      WHERE question IS NOT NULL AND question <> ''),
ans AS (SELECT conv_id AS sample_idx, arg_max(text, turn) AS answer FROM conversations
        WHERE role = 'assistant' AND turn > 1 GROUP BY conv_id)
SELECT s.sample_idx, s.question, s.expected_answer, coalesce(ans.answer, '') AS model_answer
FROM s LEFT JOIN ans USING (sample_idx)""")
def join_model_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples left-joined to an answers table; a missing answer (failed
    inference) becomes ''.  Answers = last assistant turn after turn 1."""
    t = Tables(spark, sf_dir)
    samples = chat_eval_samples(t).drop("model_answer")
    c = t.conversations
    answers = (
        c.where((F.col("role") == "assistant") & (F.col("turn") > 1))
        .groupBy(F.col("conv_id").alias("sample_idx"))
        .agg(F.max_by("text", "turn").alias("answer"))
    )
    j = samples.join(answers, "sample_idx", "left")
    return j.select("sample_idx", "question", "expected_answer", F.coalesce("answer", F.lit("")).alias("model_answer"))


@job("extract_nested_text", sql="""SELECT conv_id AS row_idx,
  array_to_string(list_filter(list(coalesce(text, '') ORDER BY turn), lambda x: x <> ''), chr(10)) AS text
FROM conversations GROUP BY conv_id""")
def extract_nested_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A messages list -> its non-empty contents joined by newlines (content key of each message)."""
    from finelens.sources.chat import chat_samples

    chats = chat_samples(Tables(spark, sf_dir))
    parts = F.transform("messages", lambda m: F.coalesce(m["content"], F.lit("")))
    return chats.select("row_idx", F.array_join(F.filter(parts, lambda p: p != ""), "\n").alias("text"))
