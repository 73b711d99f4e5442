"""Statistics of queries, documents and vocabularies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from searchloom.functions import text


def shares(rows: DataFrame, group: str, category: str) -> DataFrame:
    """Rows of each category, and their share of the group."""
    counts = rows.groupBy(group, category).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(group)))


def entropy(rows: DataFrame, group: str, category: str) -> DataFrame:
    """Shannon entropy (natural), Gini impurity and number of categories of each group."""
    p = F.col("share")
    return shares(rows, group, category).groupBy(group).agg(
        F.round(-F.sum(p * F.log(p)), 6).alias("entropy"), F.round(F.sum(p * (1 - p)), 6).alias("gini"),
        F.count("*").alias("n_categories"),
    )


def prefix_entropy(rows: DataFrame, group: str, column: str, lengths: range) -> DataFrame:
    """Entropy of the first n words, for each n, in one pass over the rows."""
    prefixes = F.array(*[F.struct(F.lit(n).alias("n"), text.first_words(F.col(column), n).alias("p")) for n in lengths])
    long = rows.select(group, F.explode(prefixes).alias("x")).select(group, F.col("x.n").alias("n_words"), F.col("x.p").alias("p"))
    counts = long.groupBy(group, "n_words", "p").agg(F.count("*").alias("n"))
    p = F.col("n") / F.sum("n").over(W.partitionBy(group, "n_words"))
    p_col = counts.withColumn("q", p)
    return p_col.groupBy(group, "n_words").agg(
        F.round(-F.sum(F.col("q") * F.log("q")), 6).alias("entropy"),
        F.round(F.sum(F.col("q") * (1 - F.col("q"))), 6).alias("gini"), F.count("*").alias("n_prefixes"),
    )


def top_per_group(counts: DataFrame, group: str, k: int, value: str, tie: str) -> DataFrame:
    """The k highest of each group with their place."""
    order = W.partitionBy(group).orderBy(F.desc(value), tie)
    return counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def five_numbers(rows: DataFrame, group: str, value: Column) -> DataFrame:
    """Quartiles (linear), mean and sample deviation."""
    quartiles = F.percentile("v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    stats = rows.select(group, value.cast("double").alias("v")).groupBy(group).agg(
        quartiles.alias("q"), F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_samp("v"), 6).alias("sd")
    )
    return stats.select(group, *[F.col("q")[i].alias(n) for i, n in enumerate(("q25", "q50", "q75"))], "mean", "sd")


def starts_with_any(column: Column, prefixes: list[str]) -> Column:
    """Whether a text starts with one of some prefixes: its beginning of each of their lengths is looked up."""
    by_length: dict[int, list[str]] = {}
    for p in prefixes:
        by_length.setdefault(len(p), []).append(p)
    found = F.lit(False)
    for n, some in sorted(by_length.items()):
        found = found | F.substring(column, 1, n).isin(*some)
    return found


def rate(rows: DataFrame, group: str, flag: Column) -> DataFrame:
    value = flag.cast("int")
    return rows.groupBy(group).agg(F.sum(value).alias("n"), F.round(F.avg(value), 6).alias("share"))


def judgments(rows: DataFrame, group: str, query: str, doc: str) -> DataFrame:
    """Judgments, distinct queries and documents, and judgments for each query."""
    stats = rows.groupBy(group).agg(
        F.count("*").alias("n_judgments"), F.countDistinct(query).alias("n_queries"), F.countDistinct(doc).alias("n_docs")
    )
    return stats.withColumn("per_query", F.round(F.col("n_judgments") / F.col("n_queries"), 6))


def lengths(rows: DataFrame, group: str, columns: dict[str, str]) -> DataFrame:
    """Mean word counts, over rows."""
    return rows.groupBy(group).agg(*[F.round(F.avg(text.word_count(F.col(c))), 6).alias(n) for n, c in columns.items()])


def proportions(rows: DataFrame, group: str, side: str, sides: list[str], key: str) -> DataFrame:
    """Distinct keys of each side, as shares of the group."""
    wide = rows.groupBy(group).pivot(side, sides).agg(F.countDistinct(key))
    total = sum((F.coalesce(F.col(s), F.lit(0)) for s in sides), F.lit(0))
    return wide.select(group, *[F.round(F.try_divide(F.coalesce(F.col(s), F.lit(0)), total), 6).alias(s) for s in sides])


def word_tokens(rows: DataFrame, group: str, column: str) -> DataFrame:
    normal = F.split(F.regexp_replace(text.normal_word(F.col(column)), r"\s+", " "), " ")
    return rows.select(group, F.explode(normal).alias("word")).where("word <> ''")


def log_odds(rows: DataFrame, group: str, column: str, smooth: float = 0.1) -> DataFrame:
    """Log-odds ratio of every word in each group against all rows, with
    additive smoothing over the whole vocabulary; words and counts are
    aggregated once by (group, word) and again by word."""
    counts = word_tokens(rows, group, column).groupBy(group, "word").agg(F.count("*").alias("c"))
    whole = counts.groupBy("word").agg(F.sum("c").alias("f"))
    sums = whole.agg(F.count("*").alias("v"), F.sum("f").alias("f_sum"))
    per = counts.groupBy(group).agg(F.sum("c").alias("c_sum"))
    rows = counts.join(whole, "word").join(per, group).join(F.broadcast(sums))
    c, f = F.col("c") + smooth, F.col("f") + smooth
    s, t = F.col("c_sum") + smooth * F.col("v"), F.col("f_sum") + smooth * F.col("v")
    return rows.select(group, "word", "c", F.round(F.log(F.try_divide(c, s - c)) - F.log(F.try_divide(f, t - f)), 6).alias("lor"))


def multiplicities(rows: DataFrame, key: str) -> DataFrame:
    """How many keys have each number of rows."""
    return rows.groupBy(key).agg(F.count("*").alias("n_rows")).groupBy("n_rows").agg(F.count("*").alias("n_keys"))


def monthly_shares(rows: DataFrame, month: Column, category: str, value: str, categories: list[str]) -> DataFrame:
    """Mean over months of each category's share; months without it count 0."""
    sums = rows.select(month.alias("month"), category, value).groupBy("month").pivot(category, categories).agg(F.sum(value)).na.fill(0)
    total = sum((F.col(c) for c in categories), F.lit(0.0))
    wide = sums.agg(*[F.round(F.avg(F.try_divide(F.col(c), total)), 6).alias(c) for c in categories])
    return wide.unpivot([], categories, category, "share")


def months(spark, first: str, last: str) -> DataFrame:
    return spark.sql(
        f"SELECT date_format(m, 'yyyy-MM') AS month FROM (SELECT explode(sequence(DATE'{first}', DATE'{last}', INTERVAL 1 MONTH)) AS m)"
    )


def progress(rows: DataFrame, ok: Column) -> DataFrame:
    """Done, failed, and the percentage done."""
    return rows.agg(
        F.count_if(ok).alias("n_done"), F.count_if(~ok).alias("n_failed"), F.round(100 * F.avg(ok.cast("int")), 1).alias("percent")
    )


def vocabulary_samples(rows: DataFrame, words: DataFrame, group: str, column: str, most: int = 30) -> DataFrame:
    """For each (group, word), the first text (by id) that holds the word, shortened."""
    met = rows.join(words.select(group, "word"), group).where(F.contains(F.lower(column), F.lower("word")))
    first = met.groupBy(group, "word").agg(F.min_by(column, "id").alias("sample"), F.min("id").alias("id"))
    return first.withColumn("sample", text.shortened(F.col("sample"), most))
