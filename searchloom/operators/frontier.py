"""Expansion of search prefixes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from searchloom.functions.seeds import SEEDS
from searchloom.functions.text import ACCENTED


def seeds(spark: SparkSession, patterns=SEEDS) -> DataFrame:
    return spark.createDataFrame([(p,) for p in patterns], "pattern string")


def accented(patterns: DataFrame) -> DataFrame:
    """Each pattern, and it with each accented spelling put in alone; once."""
    forms = [F.col("pattern")] + [F.replace("pattern", F.lit(a), F.lit(b)) for a, b in ACCENTED.items()]
    return patterns.select(F.explode(F.array(*forms)).alias("pattern")).distinct()


def searches(prefixes: DataFrame) -> DataFrame:
    """Each prefix alone and followed by each letter."""
    letters = F.array(*[F.lit(x) for x in ["", *map(chr, range(97, 123)), "ñ"]])
    rows = prefixes.select("prefix", F.explode(letters).alias("letter"))
    return rows.select(F.trim(F.concat("prefix", "letter")).alias("search"))


def longest_seed(results: DataFrame, patterns: DataFrame) -> DataFrame:
    """``result`` with the longest pattern that it starts with (an opening mark
    aside), or null. Patterns meet results on their own words: each beginning
    of a result of 1 to ``n`` words is looked up, where ``n`` is the most words
    of a pattern."""
    longest = patterns.agg(F.max(F.size(F.split(F.trim("pattern"), " ")))).first()[0] or 1
    parts = F.split(F.regexp_replace("result", "^¿", ""), " ")
    rows = results.select("result", F.explode(F.sequence(F.lit(1), F.lit(longest))).alias("n"), parts.alias("p"))
    rows = rows.where(F.size("p") > F.col("n"))
    heads = rows.select("result", F.concat_ws(" ", F.slice("p", F.lit(1), F.col("n"))).alias("pattern"))
    found = heads.join(patterns.select(F.trim("pattern").alias("pattern")).distinct(), "pattern")
    best = found.groupBy("result").agg(F.max_by("pattern", F.length("pattern")).alias("seed"))
    return results.join(best, "result", "left")


def prefixes_of(results: DataFrame, patterns: DataFrame, n: int) -> DataFrame:
    """The longest seed and n more words of each result with how many share
    it; a result without a seed, or too short, is its own prefix."""
    rows = longest_seed(results, patterns)
    parts = F.filter(F.split("result", r"\s+"), lambda w: w != "")
    size = F.size(F.split("seed", " ")) + n
    longer = F.concat(F.concat_ws(" ", F.slice(parts, F.lit(1), size)), F.lit(" "))
    rows = rows.withColumn("prefix", F.when(F.col("seed").isNotNull() & (F.size(parts) >= size), longer).otherwise(F.col("result")))
    counts = rows.groupBy("prefix").agg(F.count("*").alias("n_results"))
    return rows.join(counts, "prefix").select("result", "seed", "prefix", "n_results")


def next_frontier(results: DataFrame, patterns: DataFrame, asked: DataFrame, n: int) -> DataFrame:
    """New prefixes by falling frequency: those with a seed and n more words, not asked before."""
    rows = prefixes_of(results, patterns, n).where(F.col("seed").isNotNull() & F.endswith("prefix", F.lit(" ")))
    rows = rows.select("prefix", "n_results").distinct().join(asked.select("prefix"), "prefix", "left_anti")
    return rows.orderBy(F.desc("n_results"), "prefix")


def local_suggestions(suggestions: DataFrame, control: str, least: int = 15) -> DataFrame:
    """Long suggestions of prefixes whose set differs from the control country's; none for a prefix without any."""
    sets = suggestions.groupBy("prefix", "country").agg(F.array_sort(F.collect_set("suggestion")).alias("found"))
    base = sets.where(F.col("country") == control).select("prefix", F.col("found").alias("base"))
    differs = sets.join(base, "prefix", "left").where(F.col("base").isNull() | (F.col("found") != F.col("base")))
    rows = suggestions.join(differs.select("prefix", "country"), ["prefix", "country"], "left_semi")
    return rows.where(F.length("suggestion") >= least)


def crawl(start: DataFrame, suggestions: DataFrame, patterns: DataFrame, words_to_add: list[int], most: int | None = None) -> DataFrame:
    """Rounds of asking a table of suggestions: results of a round give the prefixes of the next."""
    answers = suggestions.select(F.trim("prefix").alias("search"), F.col("suggestion").alias("result"))
    asked = start.select("prefix")
    found = searches(asked).join(answers, "search").select("result").distinct()
    for n in words_to_add:
        if most is not None and found.count() >= most:
            break
        new = next_frontier(found, patterns, asked, n).select("prefix")
        found = found.union(searches(new).join(answers, "search").select("result")).distinct()
        asked = asked.union(new).distinct()
    return found
