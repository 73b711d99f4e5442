"""Samples by a hash of the key, the same for any partitioning, and reshaping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def order_key(key: str | Column, seed: int) -> Column:
    """A random-like order that other engines can follow."""
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))


def sample(rows: DataFrame, key: str, n: int, seed: int = 33) -> DataFrame:
    return rows.orderBy(order_key(key, seed), key).limit(n)


def stratified(rows: DataFrame, group: str, key: str, n: int | None = None, seed: int = 33) -> DataFrame:
    """n rows of each group; as many as the smallest group has, if none is given."""
    if n is None:
        n = rows.groupBy(group).agg(F.count("*").alias("n")).agg(F.min("n")).first()[0] or 0
    place = F.row_number().over(W.partitionBy(group).orderBy(order_key(key, seed), key))
    return rows.withColumn("place", place).where(F.col("place") <= n)


def disjoint(rows: DataFrame, key: str, common: int, parts: int, each: int, seed: int = 33) -> DataFrame:
    """A common sample and one for each part, without overlap, in one hashed order."""
    first = sample(rows, key, common + parts * each, seed)
    place = F.row_number().over(W.orderBy(order_key(key, seed), key))
    numbered = first.withColumn("place", place)
    part = F.when(F.col("place") <= common, 0).otherwise(F.floor((F.col("place") - common - 1) / each) + 1)
    return numbered.withColumn("part", part.cast("int"))


def melted(rows: DataFrame, ids: list[str], values: list[str], name: str = "metric", value: str = "value") -> DataFrame:
    return rows.unpivot(ids, values, name, value)


def pivoted(rows: DataFrame, ids: list[str], name: str, names: list[str], value: str) -> DataFrame:
    return rows.groupBy(*ids).pivot(name, names).agg(F.first(value))


def custom_order(column: Column, first: list[str]) -> list[Column]:
    """Sort keys: some values first, in their order, then the rest by alphabet."""
    place = F.array_position(F.array(*[F.lit(x) for x in first]), column)
    return [F.when(place > 0, place).otherwise(len(first) + 1), column]


def unpacked(rows: DataFrame, ids: list[str], arrays: list[str]) -> DataFrame:
    """Parallel arrays to rows with their place from 1."""
    zipped = F.posexplode(F.arrays_zip(*arrays)).alias("ix", "x")
    return rows.select(*ids, zipped).select(*ids, (F.col("ix") + 1).alias("rank"), *[F.col(f"x.{a}").alias(a) for a in arrays])


def tagged_union(parts: dict[str, DataFrame], name: str = "dataset") -> DataFrame:
    """UNION ALL by name with a tag; missing columns are null."""
    out = None
    for tag, part in parts.items():
        part = part.withColumn(name, F.lit(tag))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out
