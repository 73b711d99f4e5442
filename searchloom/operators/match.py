"""Matching answers to the passages of their article."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from searchloom.functions.python_functions import clean_string, longest_common_substring
from searchloom.functions.text import portal_key


def candidates(answers: DataFrame, passages: DataFrame) -> DataFrame:
    """Answers with the passages of their title. Portals match all their pages: both sides join on what those share."""
    left = answers.withColumn("_key", portal_key(F.col("title"))).withColumnRenamed("title", "answer_title")
    right = passages.withColumn("_key", portal_key(F.col("title"))).withColumnRenamed("title", "passage_title")
    rows = left.join(right, "_key")
    same = F.col("answer_title") == F.col("passage_title")
    portal = F.startswith("answer_title", F.lit("Portal:")) & F.startswith("passage_title", F.col("answer_title"))
    return rows.where(same | portal).drop("_key")


def best_passage(pairs: DataFrame, answer_key: str = "answer_id") -> DataFrame:
    """``answer_id, docid, score`` of pairs ``(answer_id, clean_answer, docid,
    passage_ix, clean_text)``: the first passage that holds the answer (score
    1), else the one with the longest common substring by its share of the
    answer; the lowest passage where equal. Empty answers match nothing. The
    substring is sought only for answers that no passage holds."""
    pairs = pairs.where(F.length("clean_answer") > 0)
    held = pairs.withColumn("held", F.contains("clean_text", F.col("clean_answer")))
    exact = (
        held.where("held").groupBy(answer_key).agg(F.min_by("docid", F.struct("passage_ix", "docid")).alias("docid"))
        .withColumn("score", F.lit(1.0))
    )
    rest = held.join(exact.select(answer_key), answer_key, "left_anti")
    share = longest_common_substring("clean_answer", "clean_text") / F.length("clean_answer")
    rest = rest.withColumn("score", share)
    order = F.struct((-F.col("score")).alias("s"), "passage_ix", "docid")
    near = rest.groupBy(answer_key).agg(F.min_by(F.struct("docid", "score"), order).alias("b"))
    return exact.unionByName(near.select(answer_key, "b.docid", "b.score"))


def match(answers: DataFrame, passages: DataFrame) -> DataFrame:
    """``answers(answer_id, title, answer)`` against ``passages(docid, title,
    passage_ix, text)``, each text cleaned once."""
    left = answers.withColumn("clean_answer", clean_string("answer"))
    right = passages.withColumn("clean_text", clean_string("text"))
    return best_passage(candidates(left, right))
