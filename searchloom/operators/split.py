"""Splits that leak nothing between train and test."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from searchloom.plans.checkpoints import written
from searchloom.plans.ordering import running_totals


def leakage_closure(edges: DataFrame, initial: DataFrame) -> DataFrame:
    """Articles that must be in train: all that share a component of the
    (query, article) graph with one of ``initial(article)``. Rounds of semi
    joins until nothing new is reached; each round is a written table."""
    edges = written(edges.select("query", "article").distinct(), "edges")
    reached = written(edges.join(initial.select("article").distinct(), "article", "left_semi").select("article").distinct(), "reached")
    fresh, size = reached, reached.count()
    while size:
        queries = edges.join(fresh, "article", "left_semi").select("query").distinct()
        near = edges.join(queries, "query", "left_semi").select("article").distinct()
        fresh = written(near.join(reached, "article", "left_anti"), "fresh")
        size = fresh.count()
        if size:
            reached = written(reached.union(fresh), "reached")
    return reached


def split_by_closure(rows: DataFrame, initial: DataFrame) -> DataFrame:
    """``rows(query, article)`` with ``split``."""
    reached = leakage_closure(rows, initial).withColumn("_in", F.lit(True))
    named = rows.join(reached, "article", "left")
    return named.withColumn("split", F.when(F.col("_in"), "train").otherwise("test")).drop("_in")


def hashed_fraction(rows: DataFrame, key: str, fraction: float, seed: int = 33) -> DataFrame:
    """Rows whose key falls in a fraction of all keys."""
    return rows.where(F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1_000_000)) < int(fraction * 1_000_000))


def score_cut(rows: DataFrame, n_test: int, article: str = "article", tie: str = "tie") -> DataFrame:
    """Articles in test: in order of mean score (falling), mean expansion and
    tie, those that begin within the first ``n_test`` rows. Only articles are
    ordered, not rows; an article's rows stand together."""
    per = rows.groupBy(article).agg(
        F.count("*").alias("n"), F.avg("score").alias("s"), F.avg("expanded").alias("x"), F.min(tie).alias("t")
    )
    per = per.withColumn("s", F.round("s", 6)).withColumn("x", F.round("x", 6))
    sums = running_totals(per, [F.desc("s"), "x", "t", article], "n", "through")
    before = F.col("through") - F.col("n")
    return sums.select(article, "n", before.alias("rows_before"), F.when(before + 1 <= n_test, "test").otherwise("train").alias("split"))


def pooled_queries(rows: DataFrame, key: list[str], order: list[str], group: str, name: str, start: int) -> DataFrame:
    """One row of each key, the first by order, with a dense number for each group value."""
    from searchloom.operators.corpus import group_numbers
    from searchloom.operators.curate import first_of

    return group_numbers(first_of(rows, key, order), group, name, start)
