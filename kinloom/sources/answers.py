"""Model answers as a data source: a port that any adjudicator, classifier or writer can fill, and its replay from a table.

A port turns a table of questions (key, task, payload) into answers (key, response); nothing here calls a network. The
questions go out in batches of fixed size in order of key, so that the same questions make the same calls.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.shared import numbered


class Port(Protocol):
    def answer(self, questions: DataFrame) -> DataFrame:
        """(key, response) of those of the questions that it can answer."""


class Replay:
    """Answers from a table (key, response, ...); an unanswered question stays so."""

    def __init__(self, answers: DataFrame):
        self.answers = answers.groupBy("key").agg(F.max_by("response", "created_at").alias("response"))

    def answer(self, questions: DataFrame) -> DataFrame:
        return questions.join(self.answers, "key").select("key", "response")


def ask(questions: DataFrame, port: Port, strict: bool = False) -> DataFrame:
    """questions with response (null: none) and hit; strict: a miss is an error."""
    out = questions.join(port.answer(questions).withColumn("hit", F.lit(True)), "key", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    if strict and not out.filter("NOT hit").isEmpty():
        raise LookupError("offline, and some questions have no cached answer")
    return out


def usage(asked: DataFrame, batch: int, budget: int = 300) -> DataFrame:
    """Cache hits, misses, calls that the misses need, hit rate, and whether a budget of calls covers them."""
    n = asked.agg(F.count_if("hit").alias("cache_hits"), F.count_if(~F.col("hit")).alias("misses"))
    n = n.withColumn("calls", F.ceil(F.col("misses") / batch))
    rate = F.when(F.col("cache_hits") + F.col("misses") > 0, F.col("cache_hits") / (F.col("cache_hits") + F.col("misses"))).otherwise(0.0)
    return n.withColumns({"hit_rate": F.round(rate, 4), "within_budget": F.col("calls") <= budget})


def batches(questions: DataFrame, size: int) -> DataFrame:
    """(batch, payloads) of the questions in order of key; keys differ."""
    rows = numbered(questions, ["key"]).withColumn("batch", F.expr(f"n div {size}"))
    return rows.groupBy("batch").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "payload"))), lambda x: x["payload"]).alias("payloads"))
