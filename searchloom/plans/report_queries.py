"""Queries of the report tables and of contrastive batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from searchloom.operators import agreement, frontier, report, topics
from searchloom.plans.registry import query
from searchloom.sources.readers import table

_NAMES = {"full": "all orders", "A": "segment A"}


@query("""WITH d AS (SELECT o_orderstatus AS split, l_returnflag AS country, o_custkey AS qid, l_partkey || '#' || l_linenumber AS docid, CAST(l_partkey AS VARCHAR) AS article
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey), e AS (SELECT *, unnest(['full', country]) AS subset FROM d)
SELECT CASE subset WHEN 'full' THEN 'all orders' WHEN 'A' THEN 'segment A' ELSE subset END AS subset,
  count(DISTINCT qid) FILTER (split = 'F') AS "F_queries", count(DISTINCT docid) FILTER (split = 'F') AS "F_documents", count(DISTINCT article) FILTER (split = 'F') AS "F_articles",
  count(DISTINCT qid) FILTER (split = 'O') AS "O_queries", count(DISTINCT docid) FILTER (split = 'O') AS "O_documents", count(DISTINCT article) FILTER (split = 'O') AS "O_articles"
FROM e GROUP BY subset""")
def subset_stats(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").join(table(spark, folder, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    rows = rows.select(F.col("o_orderstatus").alias("split"), F.col("l_returnflag").alias("country"), F.col("o_custkey").alias("qid"), F.concat_ws("#", "l_partkey", "l_linenumber").alias("docid"))
    return report.subset_stats(rows, ["F", "O"], _NAMES)


@query("""SELECT trim(p_type) AS seed, CAST(row_number() OVER (ORDER BY trim(p_type)) AS INT) AS place FROM (SELECT DISTINCT p_type FROM part)""")
def sorted_seeds(spark: SparkSession, folder: str) -> DataFrame:
    """Seeds in their order; a few hundred, so one window numbers them."""
    from pyspark.sql.window import Window as W

    kinds = table(spark, folder, "part").select("p_type").distinct()
    rows = frontier.accented(kinds.select(F.col("p_type").alias("pattern"))).select(F.trim("pattern").alias("seed")).distinct()
    return rows.withColumn("place", F.row_number().over(W.orderBy("seed")).cast("int"))


@query("""WITH s AS (SELECT coalesce(c_mktsegment, 'full') AS subset, round(avg(c_acctbal), 6) AS mean, count(*) AS n FROM customer GROUP BY ROLLUP (c_mktsegment))
SELECT 'whole' AS part, subset, mean, n, CAST(1 AS INT) AS place FROM s WHERE subset = 'full'
UNION ALL SELECT 'part', CASE subset WHEN 'BUILDING' THEN 'houses' ELSE 'other' END, mean, n, CAST(row_number() OVER (ORDER BY mean DESC, subset) AS INT) FROM s WHERE subset <> 'full'""")
def ordered_summary(spark: SparkSession, folder: str) -> DataFrame:
    """The whole and its parts by falling mean, with translated names (others have a default)."""
    from pyspark.sql.window import Window as W

    rows = table(spark, folder, "customer").rollup("c_mktsegment").agg(F.round(F.avg("c_acctbal"), 6).alias("mean"), F.count("*").alias("n"))
    rows = rows.select(F.coalesce("c_mktsegment", F.lit("full")).alias("subset"), "mean", "n")
    whole, parts = report.whole_and_parts(rows, "subset", "full")
    parts = parts.withColumn("place", F.row_number().over(W.orderBy(F.desc("mean"), "subset")).cast("int"))  # a row a segment
    name = report.named(F.col("subset"), {"BUILDING": "houses"}, F.lit("other"))
    parts = parts.select(F.lit("part").alias("part"), name.alias("subset"), "mean", "n", "place")
    return whole.select(F.lit("whole").alias("part"), "subset", "mean", "n", F.lit(1).alias("place")).union(parts)


@query("""SELECT 'doc_id' AS "column", count(*) - count(doc_id) AS n_null, count(*) AS n FROM documents UNION ALL SELECT 'text', count(*) - count(text), count(*) FROM documents
UNION ALL SELECT 'lang', count(*) - count(lang), count(*) FROM documents UNION ALL SELECT 'source', count(*) - count(source), count(*) FROM documents
UNION ALL SELECT 'long', count(*) FILTER (NOT (n_chars > 1000)), count(*) FROM documents""")
def null_counts(spark: SparkSession, folder: str) -> DataFrame:
    long = F.when(F.col("n_chars") > 1000, F.col("n_chars")).cast("string").alias("long")
    rows = table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text", "lang", "source", long)
    return report.null_counts(rows)


@query("""WITH r AS (SELECT l_partkey AS item, l_linenumber AS rater, CASE WHEN l_discount > 0.04 THEN 1 ELSE 0 END AS a, CASE WHEN l_tax > 0.03 THEN 1 ELSE 0 END AS b FROM lineitem),
v AS (SELECT item, CAST(round_even(avg(a), 0) AS INT) AS a, CAST(round_even(avg(b), 0) AS INT) AS b FROM r GROUP BY item)
SELECT round(100 * avg(a), 6) AS a, round(100 * avg(b), 6) AS b FROM v""")
def overall_rates(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").selectExpr("l_partkey AS item", "l_linenumber AS rater", "int(l_discount > 0.04) AS a", "int(l_tax > 0.03) AS b")
    return report.overall_rates(agreement.majority(rows, ("a", "b")), ("a", "b"))


@query("""SELECT parameter, label, n FROM (SELECT unnest([2, 3, 5]) AS parameter), (SELECT label, count(*) AS n FROM embeddings GROUP BY label)""")
def topic_sweep(spark: SparkSession, folder: str) -> DataFrame:
    """Topic models of several sizes; every vector is in one topic of each."""
    rows = table(spark, folder, "embeddings")

    def made(k: int) -> DataFrame:
        found = topics.clusters(rows, "embedding", k).where((F.col("topic") >= 0) & (F.col("topic") < k))
        return found.groupBy("label").agg(F.count("*").alias("n"))

    return report.sweep([2, 3, 5], made)


_MEAN = """centres AS (SELECT label AS topic, list(m ORDER BY i) AS centre FROM (SELECT label, i, avg(e) AS m FROM
  (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS e, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY label, i) GROUP BY label)"""


@query(f"""WITH {_MEAN}, o AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label = 0),
s AS (SELECT vec_id, topic, round(list_dot_product(e, centre) / greatest(sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(centre, centre)), 1e-12), 9) AS s FROM o, centres WHERE topic <> 0)
SELECT vec_id AS id, arg_min(topic, (-s, topic)) AS topic FROM s GROUP BY vec_id UNION ALL SELECT vec_id, label FROM embeddings WHERE label <> 0""")
def outlier_reduction(spark: SparkSession, folder: str) -> DataFrame:
    """Label 0 stands for the outliers: each goes to the topic whose mean vector is nearest."""
    rows = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("topic"), "embedding")
    values = rows.select("topic", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "e"))
    means = values.groupBy("topic", "i").agg(F.avg("e").alias("m")).groupBy("topic")
    centres = means.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("centre"))
    return report.reassigned(rows, centres, outlier=0, least=-1.0).select("id", "topic")


_BATCH = """b AS (SELECT vec_id // 8 AS batch, list(CAST(embedding AS DOUBLE[]) ORDER BY vec_id) FILTER (vec_id % 2 = 0) AS qs, list(CAST(embedding AS DOUBLE[]) ORDER BY vec_id) FILTER (vec_id % 2 = 1) AS ps
  FROM embeddings GROUP BY batch HAVING count(*) = 8),
s AS (SELECT batch, list_transform(qs, lambda q: list_transform(ps, lambda p: list_dot_product(q, p) / 0.5)) AS m FROM b)"""


@query(f"""WITH {_BATCH}, r AS (SELECT batch, unnest(m) AS row, unnest(range(1, 5)) AS i FROM s),
x AS (SELECT batch, i, ln(list_sum(list_transform(row, lambda v: exp(v - list_max(row))))) + list_max(row) - row[i] AS loss, len(list_filter(row, lambda v: v >= row[i])) AS rank FROM r)
SELECT batch, round(avg(loss), 6) AS loss, round(avg(1 / rank), 6) AS mrr, round(avg(CASE WHEN rank <= 1 THEN 1 ELSE 0 END), 6) AS acc1, round(avg(CASE WHEN rank <= 3 THEN 1 ELSE 0 END), 6) AS acc3,
  round(max(CASE WHEN i = 1 THEN loss END) + 0, 6) AS first FROM x GROUP BY batch""")
def contrastive_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Loss and metrics of batches of four queries with a passage each."""
    rows = table(spark, folder, "embeddings").select(F.floor(F.col("vec_id") / 8).alias("batch"), "vec_id", "embedding")
    side = lambda odd: F.transform(F.array_sort(F.collect_list(F.when(F.col("vec_id") % 2 == odd, F.struct("vec_id", "embedding")))), lambda x: x["embedding"])
    rows = rows.groupBy("batch").agg(side(0).alias("qs"), side(1).alias("ps"), F.count("*").alias("n")).where("n = 8")
    rows = rows.select("batch", report.batch_scores(F.col("qs"), F.col("ps"), 0.5).alias("scores"))
    metrics = {n: F.round(c, 6) for n, c in report.batch_metrics(F.col("scores"), 1).items()}
    loss = report.contrastive_loss(F.col("scores"), 1)
    first = report.running_average(F.array(report.contrastive_loss(F.slice("scores", 1, 1), 1)))[0]
    return rows.select("batch", F.round(loss, 6).alias("loss"), *[c.alias(n) for n, c in metrics.items()], F.round(first, 6).alias("first"))
