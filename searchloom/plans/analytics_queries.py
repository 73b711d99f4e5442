"""Corpus, query and topic statistics, and agreement of raters.

Roles: ``documents`` with a language as data set and a source as country or
topic; ``labels`` as two raters; ``events`` as monthly counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from searchloom.functions import text
from searchloom.operators import agreement, analytics, retrieve, sampling, topics
from searchloom.plans.registry import query
from searchloom.sources.readers import table

_FROM = text.MARKED + "ñÑ"
_TO = text.PLAIN + "nN"


def _first(n: int) -> str:
    return f"trim(array_to_string(string_split(text, ' ')[1:{n}], ' '))"


@query(f"""WITH c AS (SELECT lang, {_first(2)} AS prefix, count(*) AS n FROM documents GROUP BY ALL)
SELECT lang, prefix, n, round(share, 6) AS share, place FROM (SELECT *, n / sum(n) OVER (PARTITION BY lang) AS share,
  CAST(row_number() OVER (PARTITION BY lang ORDER BY n DESC, prefix) AS INT) AS place FROM c) WHERE place <= 10""")
def prefix_topk_per_group(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").select("lang", text.first_words(F.col("text"), 2).alias("prefix"))
    counts = analytics.shares(rows, "lang", "prefix")
    top = analytics.top_per_group(counts, "lang", 10, "n", "prefix")
    return top.select("lang", "prefix", "n", F.round("share", 6).alias("share"), "place")


@query(" UNION ALL ".join(f"""SELECT lang, {n} AS n_words, round(-sum(q * ln(q)), 6) AS entropy, round(sum(q * (1 - q)), 6) AS gini, count(*) AS n_prefixes
FROM (SELECT lang, p, count(*) / sum(count(*)) OVER (PARTITION BY lang) AS q FROM (SELECT lang, {_first(n)} AS p FROM documents) GROUP BY lang, p) GROUP BY lang""" for n in range(1, 7)))
def prefix_entropy(spark: SparkSession, folder: str) -> DataFrame:
    return analytics.prefix_entropy(table(spark, folder, "documents"), "lang", "text", range(1, 7))


_COUNT = "(length(text) - length(replace(text, ' ', '')) + 1)"


@query(f"""SELECT lang, quantile_cont({_COUNT}, 0.25) AS q25, quantile_cont({_COUNT}, 0.5) AS q50, quantile_cont({_COUNT}, 0.75) AS q75,
  round(avg({_COUNT}), 6) AS mean, round(stddev_samp({_COUNT}), 6) AS sd FROM documents GROUP BY lang""")
def query_length_stats(spark: SparkSession, folder: str) -> DataFrame:
    return analytics.five_numbers(table(spark, folder, "documents"), "lang", text.word_count(F.col("text")))


_STARTS = ["The ", "Of ", "In ", "En ", "Le ", "La ", "Du ", "Die ", "Der ", "El ", "De "]


@query(f"""SELECT lang, sum(f) AS n, round(avg(f), 6) AS share FROM (SELECT lang, CASE WHEN {' OR '.join(f"starts_with(text, '{s}')" for s in _STARTS)} THEN 1 ELSE 0 END AS f FROM documents) GROUP BY lang""")
def startswith_rate(spark: SparkSession, folder: str) -> DataFrame:
    return analytics.rate(table(spark, folder, "documents"), "lang", analytics.starts_with_any(F.col("text"), _STARTS))


@query("""SELECT l_returnflag, count(*) AS n_judgments, count(DISTINCT l_orderkey) AS n_queries, count(DISTINCT l_partkey) AS n_docs,
  round(count(*) / count(DISTINCT l_orderkey), 6) AS per_query FROM lineitem GROUP BY l_returnflag""")
def dataset_stats(spark: SparkSession, folder: str) -> DataFrame:
    return analytics.judgments(table(spark, folder, "lineitem"), "l_returnflag", "l_orderkey", "l_partkey")


@query("""WITH c AS (SELECT l_returnflag, count(DISTINCT CASE WHEN l_linestatus = 'O' THEN l_orderkey END) AS o, count(DISTINCT CASE WHEN l_linestatus = 'F' THEN l_orderkey END) AS f FROM lineitem GROUP BY 1)
SELECT l_returnflag, round(o / (o + f), 6) AS "O", round(f / (o + f), 6) AS "F" FROM c""")
def split_proportions(spark: SparkSession, folder: str) -> DataFrame:
    return analytics.proportions(table(spark, folder, "lineitem"), "l_returnflag", "l_linestatus", ["O", "F"], "l_orderkey")


@query(f"SELECT source, round(avg({_COUNT}), 6) AS words FROM documents GROUP BY source")
def length_means(spark: SparkSession, folder: str) -> DataFrame:
    return analytics.lengths(table(spark, folder, "documents"), "source", {"words": "text"})


_LOR = f"""t AS (SELECT source, unnest(string_split(regexp_replace(translate(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g'), '{_FROM}', '{_TO}'), '\\s+', ' ', 'g'), ' ')) AS word FROM documents),
c AS (SELECT source, word, count(*) AS c FROM t WHERE word <> '' GROUP BY ALL),
f AS (SELECT word, sum(c) AS f FROM c GROUP BY word), v AS (SELECT count(*) AS v, sum(f) AS t FROM f),
s AS (SELECT source, sum(c) AS s FROM c GROUP BY source),
lor AS (SELECT source, word, c, round(ln((c + 0.1) / (s + 0.1 * v - c - 0.1)) - ln((f + 0.1) / (t + 0.1 * v - f - 0.1)), 6) AS lor FROM c JOIN f USING (word) JOIN s USING (source) CROSS JOIN v)"""


@query(f"""WITH {_LOR} SELECT source, word, c, lor, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY source ORDER BY lor DESC, word) AS INT) AS place FROM lor WHERE c >= 5) WHERE place <= 10""")
def log_odds_by_group(spark: SparkSession, folder: str) -> DataFrame:
    rows = analytics.log_odds(table(spark, folder, "documents"), "source", "text").where("c >= 5")
    return analytics.top_per_group(rows, "source", 10, "lor", "word")


@query(f"""WITH {_LOR}, w AS (SELECT source, word FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY lor DESC, word) AS place FROM lor WHERE c >= 5) WHERE place <= 3),
m AS (SELECT source, word, min_by(text, doc_id) AS sample, min(doc_id) AS id FROM documents JOIN w USING (source) WHERE contains(lower(text), word) GROUP BY ALL)
SELECT source, word, id, CASE WHEN len(regexp_split_to_array(sample, '\\s+')) > 30 THEN array_to_string(regexp_split_to_array(sample, '\\s+')[1:30], ' ') || ' [...]' ELSE sample END AS sample FROM m""")
def vocab_contains_sample(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    odds = analytics.log_odds(docs, "source", "text").where("c >= 5")
    words = analytics.top_per_group(odds, "source", 3, "lor", "word")
    rows = docs.select(F.col("doc_id").alias("id"), "source", "text")
    return analytics.vocabulary_samples(rows, words, "source", "text").select("source", "word", "id", "sample")


@query("SELECT n_rows, count(*) AS n_keys FROM (SELECT count(*) AS n_rows FROM orders GROUP BY o_custkey) GROUP BY n_rows")
def multiplicity_hist(spark: SparkSession, folder: str) -> DataFrame:
    return analytics.multiplicities(table(spark, folder, "orders"), "o_custkey")


_TYPES = ["click", "error", "purchase", "signup", "view"]


@query(f"""WITH m AS (SELECT strftime(ts, '%Y-%m-%d') AS month, event_type, sum(value) AS s FROM events WHERE event_type IN ({', '.join(f"'{t}'" for t in _TYPES)}) GROUP BY ALL),
g AS (SELECT month, t.event_type, coalesce(s, 0) AS s FROM (SELECT DISTINCT month FROM m) CROSS JOIN (SELECT unnest({_TYPES}) AS event_type) t LEFT JOIN m USING (month, event_type))
SELECT event_type, round(avg(s / total), 6) AS share FROM (SELECT *, sum(s) OVER (PARTITION BY month) AS total FROM g) GROUP BY event_type""")
def monthly_share_pivot(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events")
    return analytics.monthly_shares(rows, F.date_format("ts", "yyyy-MM-dd"), "event_type", "value", _TYPES)


@query("SELECT strftime(m, '%Y-%m') AS month FROM (SELECT unnest(generate_series(DATE '2018-01-01', DATE '2024-12-01', INTERVAL 1 MONTH)) AS m)")
def month_sequence(spark: SparkSession, folder: str) -> DataFrame:
    return analytics.months(spark, "2018-01-01", "2024-12-01")


@query("SELECT doc_id, 'quality' AS metric, quality AS value FROM labels UNION ALL SELECT doc_id, 'toxic', toxic FROM labels")
def melt_results(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.melted(table(spark, folder, "labels"), ["doc_id"], ["quality", "toxic"])


@query("SELECT count(*) FILTER (o_orderstatus = 'F') AS n_done, count(*) FILTER (o_orderstatus <> 'F') AS n_failed, round(100 * avg(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END), 1) AS percent FROM orders")
def progress_counts(spark: SparkSession, folder: str) -> DataFrame:
    return analytics.progress(table(spark, folder, "orders"), F.col("o_orderstatus") == "F")


_RATINGS = "r AS (SELECT source AS item, doc_id AS rater, quality, toxic FROM labels JOIN documents USING (doc_id))"


def _ratings(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of a source as raters of it."""
    docs = table(spark, folder, "documents").select("doc_id", F.col("source").alias("item"))
    return table(spark, folder, "labels").join(docs, "doc_id").withColumnRenamed("doc_id", "rater")


@query(f"WITH {_RATINGS} SELECT item, CAST(round_even(avg(quality), 0) AS INT) AS quality, CAST(round_even(avg(toxic), 0) AS INT) AS toxic FROM r GROUP BY item")
def majority_vote(spark: SparkSession, folder: str) -> DataFrame:
    return agreement.majority(_ratings(spark, folder), ["quality", "toxic"])


@query(f"WITH {_RATINGS} SELECT round(avg(q), 6) AS quality, round(avg(t), 6) AS toxic FROM (SELECT CAST(min(quality) = 1 AS INT) AS q, CAST(min(toxic) = 1 AS INT) AS t FROM r GROUP BY item)")
def unanimity(spark: SparkSession, folder: str) -> DataFrame:
    return agreement.unanimity(_ratings(spark, folder), ["quality", "toxic"])


@query(f"WITH {_RATINGS} SELECT n_yes, n_raters, count(*) AS n_items FROM (SELECT sum(quality) AS n_yes, count(*) AS n_raters FROM r GROUP BY item) GROUP BY ALL")
def agreement_distribution(spark: SparkSession, folder: str) -> DataFrame:
    return agreement.agreement_distribution(_ratings(spark, folder), "quality")


@query(f"WITH {_RATINGS} SELECT item AS rater, count(*) AS n, round(100 * avg(quality), 6) AS quality, round(100 * avg(toxic), 6) AS toxic FROM r GROUP BY item")
def rater_rates(spark: SparkSession, folder: str) -> DataFrame:
    rows = _ratings(spark, folder).drop("rater").withColumnRenamed("item", "rater")
    return agreement.per_rater(rows, ["quality", "toxic"])


def _long(spark: SparkSession, folder: str) -> DataFrame:
    rows = sampling.melted(table(spark, folder, "labels").withColumnRenamed("doc_id", "item"), ["item"], ["quality", "toxic"], "rater")
    return rows


@query("""WITH c AS (SELECT count(*) AS n, sum(CASE WHEN quality = toxic THEN 1.0 ELSE 0.0 END)::DOUBLE AS same, sum(quality)::DOUBLE AS a1, sum(toxic)::DOUBLE AS b1, sum(quality * toxic)::DOUBLE AS n_both FROM labels),
d AS (SELECT *, (a1 * b1 + (n - a1) * (n - b1)) / (n * n) AS chance FROM c)
SELECT 'quality' AS rater_a, 'toxic' AS rater_b, n, round((same / n - chance) / (1 - chance), 9) AS kappa, round(2 * n_both / (a1 + b1), 9) AS f1 FROM d""")
def cohen_f1(spark: SparkSession, folder: str) -> DataFrame:
    return agreement.pairwise(_long(spark, folder))


@query("""WITH l AS (SELECT doc_id AS item, quality AS value FROM labels UNION ALL SELECT doc_id, toxic FROM labels),
c AS (SELECT item, value, count(*) AS c FROM l GROUP BY ALL), i AS (SELECT sum(c) AS r, sum(c * c) AS s FROM c GROUP BY item),
p AS (SELECT avg((s - r) / (r * (r - 1))) AS p, sum(r) AS t FROM i), e AS (SELECT sum((c / t) * (c / t)) AS e FROM (SELECT value, sum(c) AS c FROM c GROUP BY value) CROSS JOIN p)
SELECT round((p - e) / (1 - e), 9) AS kappa FROM p CROSS JOIN e""")
def fleiss_kappa(spark: SparkSession, folder: str) -> DataFrame:
    return agreement.fleiss_kappa(_long(spark, folder))


_DRAW = "sqrt(-2 * ln(({0} + 0.5) / 268435456.0)) * cos(2 * pi() * (({1} + 0.5) / 268435456.0))"
_HEX = "CAST('0x' || substr({0}, {1}, 7) AS BIGINT)"


def _draw(digest: str) -> str:
    return _DRAW.format(_HEX.format(digest, 1), _HEX.format(digest, 8))


@query(f"""WITH cells AS (SELECT * FROM (VALUES (0, 0.0::DOUBLE, 0.5::DOUBLE, 0.0::DOUBLE), (1, 0.0, 0.9, -1.2815515655446008), (2, 0.5, 0.5, 0.0), (3, 0.5, 0.9, -1.2815515655446008)) t(cell, rho, p, bound)),
d AS (SELECT *, md5('33:' || cell || ':' || trial || ':' || item) AS a, md5('33:' || cell || ':' || trial || ':' || item || ':' || rater) AS b
  FROM cells, (SELECT unnest(range(1, 21)) AS trial), (SELECT unnest(range(1, 101)) AS item), (SELECT unnest(range(1, 4)) AS rater)),
v AS (SELECT rho, p, trial, item, CASE WHEN sqrt(rho) * ({_draw("a")}) + sqrt(1 - rho) * ({_draw("b")}) > bound THEN 1 ELSE 0 END AS value FROM d),
items AS (SELECT rho, p, trial, item, sum(value) AS y, count(*) AS r FROM v GROUP BY ALL),
t AS (SELECT rho, p, trial, avg((y * y + (r - y) * (r - y) - r) / (r * (r - 1.0))) AS seen, sum(y) / sum(r) AS q, avg(CASE WHEN y IN (0, r) THEN 1.0 ELSE 0.0 END) AS agree FROM items GROUP BY ALL),
k AS (SELECT *, round(CASE WHEN q * q + (1 - q) * (1 - q) = 1 THEN NULL ELSE (seen - q * q - (1 - q) * (1 - q)) / (1 - q * q - (1 - q) * (1 - q)) END, 9) AS kappa FROM t)
SELECT rho, p, round(avg(kappa), 6) AS kappa, round(stddev_samp(kappa), 6) AS kappa_sd, round(avg(agree), 6) AS agree FROM k GROUP BY rho, p""")
def rater_simulation(spark: SparkSession, folder: str) -> DataFrame:
    return agreement.simulation(agreement.simulated_raters(spark, [0.0, 0.5], [0.5, 0.9], 20, 100, 3))


@query("SELECT CAST(doc_id AS VARCHAR) AS id, 'u' AS user, quality, toxic FROM labels")
def annotation_flatten(spark: SparkSession, folder: str) -> DataFrame:
    """Labels as nested annotation records, and flat again."""
    said = lambda c: F.array(F.struct(F.lit("u").alias("user_id"), F.when(F.col(c) == 1, "sí").otherwise("no").alias("value")))
    rows = table(spark, folder, "labels")
    records = rows.select(F.col("doc_id").cast("string").alias("id"), F.create_map(F.lit("quality"), said("quality"), F.lit("toxic"), said("toxic")).alias("responses"))
    return agreement.flat_annotations(records, ["quality", "toxic"])


_TOPIC_TERMS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')"
_CTFIDF = f"""c AS (SELECT source, term, count(*) AS c FROM (SELECT source, unnest({_TOPIC_TERMS}) AS term FROM documents) GROUP BY ALL),
p AS (SELECT source, sum(c) AS size FROM c GROUP BY source), f AS (SELECT term, sum(c) AS f FROM c GROUP BY term), a AS (SELECT avg(size) AS a FROM p),
w AS (SELECT source, term, c, round(sqrt(c / size) * ln(1 + a / f), 6) AS weight FROM c JOIN p USING (source) JOIN f USING (term) CROSS JOIN a)"""


def _weights(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, folder, "documents")
    terms = docs.select("source", "doc_id", F.explode(retrieve.terms(F.col("text"))).alias("term"))
    return terms, topics.ctfidf(terms, "source")


@query(f"WITH {_CTFIDF} SELECT source, term, c, weight, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY source ORDER BY weight DESC, term) AS INT) AS place FROM w) WHERE place <= 10")
def ctfidf_topics(spark: SparkSession, folder: str) -> DataFrame:
    return topics.top_terms(_weights(spark, folder)[1], "source", 10)


_STOP = ", ".join(f"'{w}'" for w in retrieve.SPANISH_STOP_WORDS)
_KEPT_TERMS = f"""list_filter(list_transform({_TOPIC_TERMS}, lambda t: translate(t, '{text.MARKED}ñÑ', '{text.PLAIN}nN')), lambda t: NOT list_contains([{_STOP}], t))"""


@query(f"WITH {_CTFIDF.replace(_TOPIC_TERMS, _KEPT_TERMS)} SELECT source, term, c, weight, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY source ORDER BY weight DESC, term) AS INT) AS place FROM w) WHERE place <= 10")
def ctfidf_es_topics(spark: SparkSession, folder: str) -> DataFrame:
    """Topic terms without accents and Spanish stop words."""
    stop = F.array(*map(F.lit, retrieve.SPANISH_STOP_WORDS))
    plain = F.transform(retrieve.terms(F.col("text")), lambda t: text.unaccent(t))
    kept = F.filter(plain, lambda t: ~F.array_contains(stop, t))
    terms = table(spark, folder, "documents").select("source", F.explode(kept).alias("term"))
    return topics.top_terms(topics.ctfidf(terms, "source"), "source", 10)


@query(f"""WITH {_CTFIDF}, d AS (SELECT source, doc_id, term, count(*) AS tf FROM (SELECT source, doc_id, unnest({_TOPIC_TERMS}) AS term FROM documents) GROUP BY ALL),
s AS (SELECT source, doc_id, sum(tf * weight) AS dot FROM d JOIN w USING (source, term) GROUP BY ALL),
n AS (SELECT source, doc_id, sqrt(sum(tf * tf)) AS d FROM d GROUP BY ALL), t AS (SELECT source, sqrt(sum(weight * weight)) AS t FROM w GROUP BY source),
r AS (SELECT source, doc_id, round(dot / (d * t), 6) AS cosine FROM s JOIN n USING (source, doc_id) JOIN t USING (source))
SELECT source, doc_id, cosine, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY source ORDER BY cosine DESC, doc_id) AS INT) AS place FROM r) WHERE place <= 3""")
def representative_docs(spark: SparkSession, folder: str) -> DataFrame:
    terms, weights = _weights(spark, folder)
    docs = terms.groupBy("source", F.col("doc_id").alias("docid"), "term").agg(F.count("*").alias("tf"))
    return topics.representative(docs, weights, "source", 3).withColumnRenamed("docid", "doc_id")


@query("""WITH c AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL), s AS (SELECT *, round(n / sum(n) OVER (PARTITION BY lang), 6) AS share FROM c)
SELECT lang, source, n, share, CAST(row_number() OVER (PARTITION BY lang ORDER BY share DESC, source) AS INT) AS rank FROM s""")
def topic_ranks(spark: SparkSession, folder: str) -> DataFrame:
    return topics.topic_ranks(table(spark, folder, "documents"), "source", "lang")


@query()
def kmeans_topics(spark: SparkSession, folder: str) -> DataFrame:
    rows = topics.clusters(table(spark, folder, "embeddings"), "embedding", 10)
    return rows.groupBy("topic", "label").agg(F.count("*").alias("n"))


@query()
def pca(spark: SparkSession, folder: str) -> DataFrame:
    rows = topics.reduced(table(spark, folder, "embeddings"), "embedding", 8)
    return rows.select("vec_id", "reduced")
