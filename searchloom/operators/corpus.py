"""Passages of articles, and dense ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from searchloom.functions import text
from searchloom.functions.python_functions import html_unescape
from searchloom.plans.ordering import running_totals


def passages(articles: DataFrame, unescape: bool = True, least_words: int = 4) -> DataFrame:
    """``docid, title, text``: the cleaned paragraphs of at least so many words,
    numbered within their article. No shuffle: a row's paragraphs are one array."""
    parts = F.transform(F.split(F.col("text"), "\n"), lambda p: text.clean_passage(p))
    kept = F.filter(parts, lambda p: F.size(text.words(p)) >= least_words)
    title = html_unescape("title") if unescape else F.col("title")
    rows = articles.select("id", text.spaced_namespace(title).alias("title"), F.posexplode(kept).alias("ix", "text"))
    return rows.select(F.concat_ws("#", "id", "ix").alias("docid"), "title", "text")


def dense_ids(rows: DataFrame, order: list[str], name: str = "id", start: int = 0) -> DataFrame:
    """Numbers without gaps in an order."""
    return running_totals(rows.withColumn("_one", F.lit(1)), order, "_one", name, start - 1).drop("_one")


def group_numbers(rows: DataFrame, key: str, name: str = "id", start: int = 0) -> DataFrame:
    """One number for each value of a key, in its order, from a start on."""
    return rows.join(dense_ids(rows.select(key).distinct(), [key], name, start), key)


def factorised(rows: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """Codes of a key's values in order of first appearance."""
    first = rows.groupBy(key).agg(F.min(F.struct(*order)).alias("_first"))
    return rows.join(dense_ids(first, ["_first", key], name).drop("_first"), key)


def embed_batches(rows: DataFrame, encode, schema: str = "id string, embedding array<float>") -> DataFrame:
    """Vectors from any batch encoder: ``encode(list of texts) -> matrix``. Each task makes its own."""

    def over(batches):
        import pyarrow as pa

        for batch in batches:
            vectors = encode(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([list(map(float, v)) for v in vectors], pa.list_(pa.float32()))], ["id", "embedding"]
            )

    return rows.select("id", "text").mapInArrow(over, schema)


def not_encoded(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """Distinct rows whose id has no vector yet."""
    return rows.dropDuplicates(["id"]).join(stored.select("id"), "id", "left_anti")
