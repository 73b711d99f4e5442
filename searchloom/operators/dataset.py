"""The judged data set, from matched answers; and other collections in the same shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from searchloom.operators.corpus import dense_ids
from searchloom.operators.curate import matched


def narrowed_score(score: Column) -> Column:
    """Four decimals, halves to even, in single precision."""
    return F.bround(score, 4).cast("float")


def judged_dataset(queries: DataFrame, pages: DataFrame, extractions: DataFrame, passages: DataFrame, least: float = 0.5) -> DataFrame:
    """Queries with their page's date and matched passage: scores above a bound,
    no questions of another site, the general domain as no country."""
    rows = matched(extractions.where("corpus_docid IS NOT NULL"), "match_score", least)
    rows = rows.select("id", "corpus_docid", "match_score", "expanded_search", "answer_type").join(queries, "id")
    rows = rows.join(pages.select("id", F.col("date").alias("answer_date")), "id")
    texts = passages.groupBy(F.col("docid").alias("corpus_docid")).agg(F.min("text").alias("docid_text"))
    rows = rows.join(texts, "corpus_docid", "left").where(~F.endswith(F.lower("question"), F.lit("brainly")))
    country = F.when(F.col("country") == "general", "no_country").otherwise(F.col("country"))
    return rows.select(
        country.alias("country"), "id", F.col("question").alias("query"), F.col("corpus_docid").alias("docid"), "docid_text",
        F.col("date").alias("query_date"), "answer_date", narrowed_score(F.col("match_score")).alias("match_score"),
        "expanded_search", "answer_type",
    )


def training_passages(passages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Passages under dense numbers in the order of their ids, and the table of old and new ids."""
    numbered = dense_ids(passages, ["docid"], "_n").withColumn("id", F.col("_n").cast("string"))
    ids = numbered.select(F.col("docid").alias("old_id"), F.col("id").alias("new_id"))
    return numbered.select("id", F.col("text").alias("contents"), "title"), ids


def canonical_corpus(rows: DataFrame, docid: str, text: str, title: str | None = None) -> DataFrame:
    head = F.col(title) if title else F.lit("")
    return rows.select(F.col(docid).cast("string").alias("docid"), head.alias("title"), F.col(text).alias("text")).distinct()


def canonical_qrels(rows: DataFrame, qid: str, docid: str, rel: str | None = None) -> DataFrame:
    """Positive judgments, once."""
    if rel:
        rows = rows.where(F.col(rel) > 0)
    return rows.select(
        F.col(qid).cast("string").alias("qid"), F.lit("Q0").alias("q0"), F.col(docid).cast("string").alias("docid"), F.lit(1).alias("rel")
    ).distinct()


def listed_qrels(rows: DataFrame, qid: str, ids: str) -> DataFrame:
    """Judgments whose documents are one text, separated by spaces."""
    return canonical_qrels(rows.select(qid, F.explode(F.split(F.trim(ids), r"\s+")).alias("_doc")), qid, "_doc")


def wide_collection(rows: DataFrame, qid: str, query: str, docid: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One wide table as corpus, topics and qrels."""
    topics = rows.select(F.col(qid).cast("string").alias("qid"), F.col(query).alias("query")).distinct()
    return canonical_corpus(rows, docid, text), topics, canonical_qrels(rows, qid, docid)


def triples_stats(triples: DataFrame, queries: DataFrame) -> DataFrame:
    """Distinct (query, positive) pairs of training triples, and queries with a text among them."""
    pairs = triples.select("qid", "positive").distinct()
    known = pairs.join(queries.select("qid").distinct(), "qid", "left_semi")
    return known.agg(F.count("*").alias("n_pairs"), F.countDistinct("qid").alias("n_queries"))
