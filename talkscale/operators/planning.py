"""The question layer: what to ask of which text, request packing, and checks of answers' columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def plan_questions(units: DataFrame, questions: DataFrame, answered: DataFrame, unit: str, date: str) -> DataFrame:
    """Units times questions (a small table) that apply, minus what is answered for the same wording. An unknown date counts as too early."""
    asked = units.join(F.broadcast(questions), F.col("valid_from").isNull() | F.coalesce(F.col(date) >= F.col("valid_from"), F.lit(False)))
    return asked.join(answered.select(unit, "qid", "prompt_hash"), [unit, "qid", "prompt_hash"], "left_anti")


def layers(asked: DataFrame, text_key: str) -> DataFrame:
    """A question worded in two ways for one text goes to different requests."""
    return asked.withColumn("layer", F.dense_rank().over(Window.partitionBy(text_key, "qid").orderBy("prompt_hash")))


def distinct_texts(df: DataFrame, text: str, order: str) -> DataFrame:
    """One row for each text: its hash, the first id, and how many share it."""
    return df.groupBy(F.sha2(text, 256).alias("text_hash")).agg(F.min(order).alias(f"first_{order}"), F.count("*").alias("n"))


def answer_problem(kind: str = "type", levels: int = 5) -> Column:
    """Why an answer is refused, or null."""
    in_range = lambda c, top: F.col(c).isNotNull() & ~F.isnan(c) & F.col(c).between(0, top)
    return F.when(~F.col(kind).isin("noul", "score"), "unknown type").when((F.col(kind) == "noul") & ~in_range("noul", 1), "bad noul").when((F.col(kind) == "score") & ~in_range("score", levels - 1), "bad score")
