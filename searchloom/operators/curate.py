"""Question cleaning, and what is new in a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from searchloom.functions import text


def first_of(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by an order, by partial aggregation (no window sort)."""
    others = [c for c in rows.columns if c not in key]
    best = F.min_by(F.struct(*others), F.struct(*order)).alias("_row")
    return rows.groupBy(*key).agg(best).select(*key, "_row.*").select(*rows.columns)


def last_of(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    others = [c for c in rows.columns if c not in key]
    best = F.max_by(F.struct(*others), F.struct(*order)).alias("_row")
    return rows.groupBy(*key).agg(best).select(*key, "_row.*").select(*rows.columns)


def clean_questions(
    questions: DataFrame, order: list[str], seeds: DataFrame | None = None, strip_site_suffix: bool = False
) -> DataFrame:
    """Questions without marks, repeats, short, foreign or other sites' ones.

    Of questions that differ in accents or case only, the last by (question,
    order) stays. seeds: ``pattern``; questions that are one of them go.
    """
    rows = questions.withColumn("question", text.without_opening_marks(F.col("question")))
    lowered = F.lower("question")
    # Rules look at the question alone, so they come before anything is shuffled.
    rows = rows.where(text.has_three_words(F.col("question")) & ~text.is_unwanted(lowered))
    rows = first_of(rows, ["question"], order)
    rows = rows.withColumn("_key", text.unaccent(lowered)).withColumn("_lower", lowered)
    if strip_site_suffix:
        rows = first_of(rows.withColumn("question", text.without_site(F.col("question"))), ["question"], order)
    rows = last_of(rows, ["_key"], ["question", *order])
    if seeds is not None:
        rows = rows.join(seeds.select(F.trim("pattern").alias("_lower")), "_lower", "left_anti")
    return rows.drop("_key", "_lower").select(*questions.columns)


def with_search_url(questions: DataFrame) -> DataFrame:
    return questions.withColumn("url", text.search_url(F.col("question"), F.col("country")))


def unseen(batch: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys aren't known yet."""
    return batch.join(known.select(*keys), keys, "left_anti")


def to_fetch(queries: DataFrame, pages: DataFrame, key: str = "id", content: str = "html") -> DataFrame:
    """Queries without a page that has content."""
    return queries.join(pages.where(F.col(content).isNotNull()).select(key), key, "left_anti")


def outdated(rows: DataFrame, version: str, current: int, empty: list[str]) -> DataFrame:
    """Rows of an earlier version (or none) with none of the results."""
    wanted = F.col(version).isNull() | (F.col(version) < current)
    for name in empty:
        wanted = wanted & F.col(name).isNull()
    return rows.where(wanted)


def matchable(extractions: DataFrame, version: int) -> DataFrame:
    """Answers of the encyclopedia, of a type that can be matched, not matched yet."""
    kinds = ("feat_snip", "rich_list", "rich_set", "rich_snip", "knowledge", "descript")
    rows = extractions.where(F.col("answer").isNotNull() & F.contains("answer_url", F.lit("es.wikipedia.org")))
    rows = rows.where(F.col("answer_type").isin(*kinds) & F.col("corpus_docid").isNull())
    return rows.where(F.col("match_v").isNull() | (F.col("match_v") < version))


def matched(rows: DataFrame, score: str, least: float) -> DataFrame:
    """Rows with a document whose score is above a bound."""
    return rows.where(F.col(score) > least)
