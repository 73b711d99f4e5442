"""Tables of reports: statistics of subsets, display names, ordered summaries,
null counts, sweeps; and the arithmetic of contrastive batches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from searchloom.functions.vectors import cosine, dot


def named(value: Column, names: dict[str, str], default: Column | None = None) -> Column:
    """The display name of a value; itself (or a default) where it has none."""
    found = F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), value)
    return F.coalesce(found, value if default is None else default)


def subset_stats(dataset: DataFrame, splits: list[str], names: dict[str, str], whole: str = "full") -> DataFrame:
    """A row a subset (the whole, then each country) with queries, documents and
    articles of every split: one aggregation, then a pivot over the splits. Long
    form first: ``subset, split, metric``; the header is ``split_metric``."""
    rows = dataset.select("split", "qid", "docid", F.substring_index(F.col("docid").cast("string"), "#", 1).alias("article"), F.explode(F.array(F.lit(whole), F.col("country"))).alias("subset"))
    counts = [F.count_distinct("qid").alias("queries"), F.count_distinct("docid").alias("documents"), F.count_distinct("article").alias("articles")]
    wide = rows.groupBy("subset").pivot("split", splits).agg(*counts)
    columns = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in wide.columns if c != "subset"]
    return wide.select(named(F.col("subset"), names).alias("subset"), *columns)


def whole_and_parts(rows: DataFrame, column: str, whole: str) -> tuple[DataFrame, DataFrame]:
    """Rows of the whole, and those of its parts."""
    return rows.where(F.col(column) == whole), rows.where(F.col(column) != whole)


def null_counts(rows: DataFrame) -> DataFrame:
    """``column, n_null, n`` of every column, in one pass."""
    counts = rows.agg(F.count("*").alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in rows.columns])
    return counts.unpivot(["_n"], rows.columns, "column", "n_null").select("column", "n_null", F.col("_n").alias("n"))


def overall_rates(votes: DataFrame, flags) -> DataFrame:
    """Percent of items that the majority flags."""
    return votes.agg(*[F.round(100 * F.avg(c), 6).alias(c) for c in flags])


def sweep(parameters: list, make: Callable, name: str = "parameter") -> DataFrame:
    """The union of ``make(parameter)`` with the parameter as a column."""
    out = None
    for value in parameters:
        part = make(value).withColumn(name, F.lit(value))
        out = part if out is None else out.unionByName(part)
    return out


def reassigned(rows: DataFrame, topics: DataFrame, outlier: int = -1, least: float = 0.0) -> DataFrame:
    """Rows ``id, topic, embedding`` with outliers moved to the topic of the most
    similar vector (``topic, centre``), if it is as similar as ``least``; ties to the lowest topic."""
    # One row that holds the topics' vectors; there are as many as topics.
    known = topics.where(F.col("topic") != outlier).agg(F.array_sort(F.collect_list(F.struct("topic", "centre"))).alias("_topics"))
    near = F.transform(
        "_topics", lambda t: F.struct((-F.round(cosine(F.col("embedding"), t["centre"]), 9)).alias("s"), t["topic"].alias("topic"))
    )
    best = F.array_min(F.filter(near, lambda x: x["s"] <= -least))
    rows = rows.crossJoin(known).withColumn("_to", F.when(F.col("topic") == outlier, best["topic"]))
    return rows.withColumn("topic", F.coalesce("_to", "topic")).drop("_to", "_topics")


def batch_scores(queries: Column, passages: Column, temperature: float = 1.0) -> Column:
    """Inner products of every query of a batch with every passage of it, by temperature: a matrix as arrays."""
    return F.transform(queries, lambda q: F.transform(passages, lambda p: dot(q, p) / temperature))


def contrastive_loss(scores: Column, per_query: int) -> Column:
    """Mean cross entropy of a batch, where the passage of query ``i`` is ``i * per_query``."""

    def one(row: Column, i: Column) -> Column:
        top = F.array_max(row)
        total = F.aggregate(row, F.lit(0.0), lambda s, x: s + F.exp(x - top))
        return F.log(total) + top - F.element_at(row, i * per_query + 1)

    losses = F.transform(scores, one)
    return F.aggregate(losses, F.lit(0.0), lambda s, x: s + x) / F.size(scores)


def batch_metrics(scores: Column, per_query: int) -> dict[str, Column]:
    """Mean reciprocal rank and accuracy at 1 and 3 of a batch; passages that score as high stand before."""
    label = lambda i: (i * per_query) % F.size(F.element_at(scores, 1)) + 1
    ranks = F.transform(scores, lambda row, i: F.size(F.filter(row, lambda x: x >= F.element_at(row, label(i)))))
    mean = lambda f: F.aggregate(F.transform(ranks, f), F.lit(0.0), lambda s, x: s + x) / F.size(ranks)
    return {
        "mrr": mean(lambda r: 1.0 / r),
        "acc1": mean(lambda r: (r <= 1).cast("double")),
        "acc3": mean(lambda r: (r <= 3).cast("double")),
    }


def running_average(values: Column) -> Column:
    """The averages of the first 1, 2 ... values of an array."""
    sums = F.transform(F.sequence(F.lit(1), F.size(values)), lambda n: F.aggregate(F.slice(values, F.lit(1), n), F.lit(0.0), lambda s, x: s + x) / n)
    return F.when(F.size(values) > 0, sums).otherwise(F.expr("cast(array() as array<double>)"))
