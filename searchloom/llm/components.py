"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from searchloom.llm.common import dropped, stage


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")
    ).first()
    return row["n"], row["s"]


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(u, v)`` of longs to ``(u, v)``: each linked node that isn't the
    smallest of its component, with that smallest node.

    Every round is two joins on the node; no node's neighbours are ever
    gathered in one row, and the driver sees only a count and a checksum.
    Each round is a table in the shared folder, which replaces the one before.
    """
    edges = (
        edges.where("u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    edges = stage(edges, "edges")
    seen = _signature(edges)
    while seen[0]:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        ).distinct()
        large = stage(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        before, edges = edges, stage(small, "small-star")
        dropped(before)
        dropped(large)
        now = _signature(edges)
        if now == seen:
            break
        seen = now
    return edges
