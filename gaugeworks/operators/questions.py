"""Questions about a one-row summary: prompts out, answers in, with a fixed answer where none came."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions.text import fill, strip, truncate
from gaugeworks.operators.replies import one_reply_per


def ask(
    questions: DataFrame, summary: Column, prompt: str, answer: str, key: str = "question_id", text: str = "question",
    max_chars: int | None = None,
) -> DataFrame:
    """(key, prompt, fallback_answer) per question; `summary` is a one-row subquery or a literal.

    Questions stay whole unless `max_chars` is given.
    """
    kept = questions.select(key, text).withColumn("_summary", summary)
    return kept.select(
        key,
        fill(prompt, summary=F.col("_summary"), question=truncate(F.col(text), max_chars)).alias("prompt"),
        fill(answer, summary=F.col("_summary")).alias("fallback_answer"),
    )


def answer(asked: DataFrame, replies: DataFrame, key: str = "question_id") -> DataFrame:
    """(key, answer): the stripped reply, or the fallback where there is none."""
    joined = asked.join(one_reply_per(replies, key), key, "left")
    given = F.when(F.col("reply") != "", strip(F.col("reply")))
    return joined.select(key, F.coalesce(given, F.col("fallback_answer")).alias("answer"))
