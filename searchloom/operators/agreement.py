"""Agreement of raters."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FLAGS = ("correct", "unambiguous", "relevant")


def valid_ratings(rows: DataFrame, flags=FLAGS) -> DataFrame:
    """Rows whose flags are all 0 or 1; anything else (also text) drops them."""
    typed = rows.select(*[F.expr(f"try_cast({c} AS int)").alias(c) if c in flags else F.col(c) for c in rows.columns])
    for c in flags:
        typed = typed.where(F.col(c).isin(0, 1))
    return typed


def flat_annotations(records: DataFrame, variables: list[str]) -> DataFrame:
    """Nested answers ``sí`` and ``no`` to ``id, user, variable`` columns of 1 and 0; any other answer is an error."""
    parts = F.array(*[F.struct(F.lit(v).alias("variable"), F.element_at("responses", v).alias("rs")) for v in variables])
    rows = records.select("id", F.explode(parts).alias("p")).select("id", "p.variable", F.explode("p.rs").alias("r"))
    value = (
        F.when(F.col("r.value") == "sí", 1)
        .when(F.col("r.value") == "no", 0)
        .otherwise(F.raise_error(F.concat(F.lit("unknown answer: "), F.col("r.value"))).cast("int"))
    )
    rows = rows.select("id", F.col("r.user_id").alias("user"), "variable", value.alias("value"))
    return rows.groupBy("id", "user").pivot("variable", variables).agg(F.first("value"))


def per_rater(rows: DataFrame, flags=FLAGS) -> DataFrame:
    return rows.groupBy("rater").agg(F.count("*").alias("n"), *[F.round(100 * F.avg(c), 6).alias(c) for c in flags])


def majority(rows: DataFrame, flags) -> DataFrame:
    """Votes of each item: the mean rounded to even, so a tie is 0."""
    return rows.groupBy("item").agg(*[F.bround(F.avg(c)).cast("int").alias(c) for c in flags])


def unanimity(rows: DataFrame, flags) -> DataFrame:
    """Share of items that every rater flags."""
    items = rows.groupBy("item").agg(*[(F.min(c) == 1).cast("int").alias(c) for c in flags])
    return items.agg(*[F.round(F.avg(c), 6).alias(c) for c in flags])


def agreement_distribution(rows: DataFrame, flag: str) -> DataFrame:
    """Items by how many raters flag them, with all-agree and most-agree shares."""
    items = rows.groupBy("item").agg(F.sum(flag).alias("n_yes"), F.count("*").alias("n_raters"))
    return items.groupBy("n_yes", "n_raters").agg(F.count("*").alias("n_items"))


def pairwise(rows: DataFrame) -> DataFrame:
    """Cohen's kappa and F1 of each pair of raters, from ``item, rater, value``:
    the confusion counts of a pair give both in closed form; null where chance
    alone agrees always, or nothing is flagged."""
    a = rows.select("item", F.col("rater").alias("rater_a"), F.col("value").alias("a"))
    b = rows.select("item", F.col("rater").alias("rater_b"), F.col("value").alias("b"))
    pairs = a.join(b, "item").where("rater_a < rater_b")
    count = lambda cond: F.sum(F.when(F.expr(cond), 1.0).otherwise(0.0))
    t = pairs.groupBy("rater_a", "rater_b").agg(
        F.count("*").alias("n"), count("a = b").alias("same"), count("a = 1").alias("a1"), count("b = 1").alias("b1"),
        count("a = 1 AND b = 1").alias("both"),
    )
    chance = (F.col("a1") * F.col("b1") + (F.col("n") - F.col("a1")) * (F.col("n") - F.col("b1"))) / (F.col("n") * F.col("n"))
    seen = F.col("same") / F.col("n")
    return t.select(
        "rater_a", "rater_b", "n", F.round(F.try_divide(seen - chance, 1 - chance), 9).alias("kappa"),
        F.round(F.try_divide(2 * F.col("both"), F.col("a1") + F.col("b1")), 9).alias("f1"),
    )


def fleiss_kappa(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Fleiss' kappa of ``item, value`` with a fixed number of raters an item, for each group of ``by``."""
    by = by or []
    cells = rows.groupBy(*by, "item", "value").agg(F.count("*").alias("c"))
    items = cells.groupBy(*by, "item").agg(F.sum("c").alias("r"), F.sum(F.col("c") * F.col("c")).alias("s"))
    p_item = F.try_divide(F.col("s") - F.col("r"), F.col("r") * (F.col("r") - 1))
    seen = items.groupBy(*by).agg(F.avg(p_item).alias("seen"), F.sum("r").alias("total"))
    values = cells.groupBy(*by, "value").agg(F.sum("c").alias("c"))
    if by:
        shares = values.join(seen.select(*by, "total"), by)
    else:
        shares = values.join(F.broadcast(seen.select("total")))
    chance = shares.groupBy(*by).agg(F.sum((F.col("c") / F.col("total")) * (F.col("c") / F.col("total"))).alias("e"))
    rows = seen.join(chance, by) if by else seen.join(F.broadcast(chance))
    return rows.select(*by, F.round(F.try_divide(F.col("seen") - F.col("e"), 1 - F.col("e")), 9).alias("kappa"))


def _normal(*keys: Column) -> Column:
    """A standard normal number of the keys (Box and Muller, from the digits of an MD5): the same in any partitioning."""
    digest = F.md5(F.concat_ws(":", *keys).cast("binary"))
    u, v = ((F.conv(F.substring(digest, at, 7), 16, 10).cast("double") + 0.5) / (1 << 28) for at in (1, 8))
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * v)


def simulated_raters(spark: SparkSession, correlations: list[float], rates: list[float], trials: int, items: int, raters: int, seed: int = 33) -> DataFrame:
    """Correlated binary ratings: a share of each rater's normal draw is the
    item's own (Gaussian copula). ``rho, p, trial, item, value``."""
    from statistics import NormalDist

    cells = [(i, r, p, NormalDist().inv_cdf(1 - p)) for i, (r, p) in enumerate((r, p) for r in correlations for p in rates)]
    rows = spark.createDataFrame(cells, "cell int, rho double, p double, bound double")
    rows = rows.withColumn("trial", F.explode(F.sequence(F.lit(1), F.lit(trials))))
    rows = rows.withColumn("item", F.explode(F.sequence(F.lit(1), F.lit(items))))
    rows = rows.withColumn("rater", F.explode(F.sequence(F.lit(1), F.lit(raters))))
    own, shared = [F.lit(seed), *map(F.col, ("cell", "trial", "item", "rater"))], [F.lit(seed), *map(F.col, ("cell", "trial", "item"))]
    z = F.sqrt("rho") * _normal(*shared) + F.sqrt(1 - F.col("rho")) * _normal(*own)
    return rows.select("rho", "p", "trial", "item", (z > F.col("bound")).cast("int").alias("value"))


def simulation(ratings: DataFrame) -> DataFrame:
    """Mean and deviation over trials of kappa and of the share of items where all agree."""
    keys = ["rho", "p", "trial"]
    kappa = fleiss_kappa(ratings, keys)
    same = ratings.groupBy(*keys, "item").agg((F.min("value") == F.max("value")).cast("int").alias("same"))
    same = same.groupBy(*keys).agg(F.avg("same").alias("agree"))
    return kappa.join(same, keys).groupBy("rho", "p").agg(
        F.round(F.avg("kappa"), 6).alias("kappa"), F.round(F.stddev_samp("kappa"), 6).alias("kappa_sd"), F.round(F.avg("agree"), 6).alias("agree")
    )
