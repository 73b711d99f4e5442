"""Retrieval, evaluation and training-data queries.

Roles: ``embeddings`` are encoded queries and passages (relevant: of the same
label); ``documents`` and ``benchmark`` a corpus and questions; ``lineitem``
judged and retrieved documents (parts) of queries (orders).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from searchloom.functions import text, vectors
from searchloom.operators import dataset, evaluate, match, mining, retrieve
from searchloom.operators.corpus import passages
from searchloom.plans.registry import query
from searchloom.sources import writers
from searchloom.sources.readers import table

_DOTS = """scores AS (SELECT q.vec_id AS qid, d.vec_id AS docid, q.label AS ql, d.label AS dl,
    round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(d.embedding AS DOUBLE[])), 9) AS score
  FROM embeddings q CROSS JOIN embeddings d)"""


def _top(spark: SparkSession, folder: str, k: int) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    return retrieve.dense_topk(
        rows.select(F.col("vec_id").alias("qid"), "embedding"), rows.select(F.col("vec_id").alias("docid"), "embedding"), k
    )


@query(f"""WITH {_DOTS} SELECT qid, docid, rank, score FROM
  (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, docid) AS INT) AS rank FROM scores) WHERE rank <= 20""")
def dense_topk(spark: SparkSession, folder: str) -> DataFrame:
    return _top(spark, folder, 20).select("qid", "docid", "rank", "score")


@query(f"""WITH {_DOTS},
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, docid) AS rank FROM scores WHERE qid <> docid),
sizes AS (SELECT label, count(*) - 1 AS n FROM embeddings GROUP BY label),
per AS (SELECT qid, any_value(ql) AS label, sum(CASE WHEN ql = dl AND rank <= 10 THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg,
    count(*) FILTER (ql = dl) AS hits, min(rank) FILTER (ql = dl AND rank <= 10) AS first FROM ranked WHERE rank <= 100 GROUP BY qid),
ideal AS (SELECT label, n, (SELECT sum(1 / log2(i + 1)) FROM range(1, 11) t(i) WHERE i <= n) AS idcg FROM sizes)
SELECT round(avg(dcg / idcg), 6) AS ndcg_10, round(avg(hits / n), 6) AS recall_100, round(100 * avg(coalesce(1 / first, 0)), 4) AS mrr_10
FROM per JOIN ideal USING (label)""")
def ndcg_recall_mrr_at_k(spark: SparkSession, folder: str) -> DataFrame:
    """Labels decide what is relevant, so pairs of a label are never listed: its size is enough."""
    labels = table(spark, folder, "embeddings").select("vec_id", "label")
    run = _top(spark, folder, 101).where("qid <> docid")
    run = run.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy("rank"))).where("rank <= 100")
    return evaluate.label_summary(run, labels.toDF("id", "label"), 10, 100, 10)


_RUN = """judged AS (SELECT l_orderkey AS qid, l_partkey AS docid, max(l_extendedprice) AS score,
    CAST(max(CAST(l_quantity AS INT) % 4) AS INT) AS rel FROM lineitem GROUP BY ALL),
run AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, docid DESC) AS rank FROM judged)"""


def _judged(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """A run (by price) and labels (from quantity) of parts for orders."""
    rows = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("qid"), F.col("l_partkey").alias("docid")).agg(
        F.max("l_extendedprice").alias("score"), F.max(F.col("l_quantity").cast("int") % 4).alias("rel")
    )
    return evaluate.by_score(rows.drop("rel")), rows.select("qid", "docid", "rel")


def _summary_sql(k: int) -> str:
    return f"""SELECT {k} AS k, round(avg(coalesce(dcg / idcg, 0)), 5) AS ndcg, round(avg(coalesce(ap / n_rel, 0)), 5) AS ap,
  round(avg(coalesce(n_hit / n_rel, 0)), 5) AS recall FROM (SELECT DISTINCT qid FROM judged)
  LEFT JOIN (SELECT qid, count(*) AS n_rel, sum(CASE WHEN r <= {k} THEN rel / log2(r + 1) ELSE 0 END) AS idcg FROM
    (SELECT qid, rel, row_number() OVER (PARTITION BY qid ORDER BY rel DESC, docid) AS r FROM judged WHERE rel > 0) GROUP BY qid) USING (qid)
  LEFT JOIN (SELECT qid, sum(rel / log2(rank + 1)) AS dcg, count(*) AS n_hit, sum(nth / rank) AS ap FROM
    (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank) AS nth FROM run WHERE rank <= {k} AND rel > 0) GROUP BY qid) USING (qid)"""


@query(f"WITH {_RUN} {_summary_sql(1)} UNION ALL {_summary_sql(3)} UNION ALL {_summary_sql(10)}")
def trec_summary(spark: SparkSession, folder: str) -> DataFrame:
    run, qrels = _judged(spark, folder)
    return evaluate.summary(run, qrels, [1, 3, 10])


@query(f"""WITH {_RUN}, least AS (SELECT CASE WHEN max(rel) >= 3 THEN 2 ELSE 1 END AS l FROM judged)
SELECT round(100 * avg(coalesce(1 / first, 0)), 4) AS mrr FROM (SELECT qid, min(rank) FILTER (rank <= 10 AND rel >= (SELECT l FROM least)) AS first FROM run GROUP BY qid)""")
def mrr_graded(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.mrr(*_judged(spark, folder))


@query(f"""WITH {_RUN}, firsts AS (SELECT qid, min(rank) FILTER (rel = 3) AS first_hit FROM run GROUP BY qid)
SELECT qid, first_hit FROM firsts WHERE first_hit IS NULL OR first_hit > 3""")
def error_analysis_min_hit_rank(spark: SparkSession, folder: str) -> DataFrame:
    """Queries whose first document of the highest label is beyond the third, or absent."""
    run, qrels = _judged(spark, folder)
    strict = qrels.withColumn("rel", (F.col("rel") == 3).cast("int"))
    return evaluate.misses(evaluate.judged_run(run, strict), 3).select("qid", F.col("first_hit").cast("long").alias("first_hit"))


_TERMS = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+')"


def _bm25_sql(terms: str) -> str:
    return f"""WITH wanted AS (SELECT DISTINCT item_id AS qid, unnest({terms}) AS term FROM benchmark),
docs AS (SELECT doc_id AS docid, {terms} AS ts FROM documents),
stats AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM docs),
found AS (SELECT docid, term, dl, count(*) AS tf FROM (SELECT docid, len(ts) AS dl, unnest(ts) AS term FROM docs)
  WHERE term IN (SELECT term FROM wanted) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM found GROUP BY term),
scored AS (SELECT qid, docid, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 0.9 * (1 - 0.4 + 0.4 * dl / avgdl))), 6) AS score
  FROM found JOIN dfs USING (term) JOIN wanted USING (term) CROSS JOIN stats GROUP BY ALL)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, docid) AS INT) AS rank FROM scored) WHERE rank <= 10"""


_FOLDED = f"list_transform({_TERMS.format('text')}, lambda t: translate(t, '{text.MARKED}ñÑ', '{text.PLAIN}nN'))"
_STOP = ", ".join(f"'{w}'" for w in retrieve.SPANISH_STOP_WORDS)
_SPANISH = f"""list_transform(list_filter({_FOLDED}, lambda t: NOT list_contains([{_STOP}], t)), lambda t: CASE WHEN length(t) < 5 THEN t
  WHEN regexp_matches(t, '[oae]$') THEN t[:length(t) - 1] WHEN t LIKE '%eses' THEN t[:length(t) - 2] WHEN t LIKE '%ces' THEN t[:length(t) - 3] || 'z'
  WHEN regexp_matches(t, '[oae]s$') THEN t[:length(t) - 2] ELSE t END)"""


@query(_bm25_sql(_SPANISH))
def bm25_es_topk(spark: SparkSession, folder: str) -> DataFrame:
    """With the Spanish analyzer: no stop words, no accents, light stems."""
    queries = table(spark, folder, "benchmark").select(F.col("item_id").alias("qid"), "text")
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("docid"), "text")
    return retrieve.bm25_topk(queries, docs, 10, language="es")


@query(f"SELECT docid, dl, term, count(*) AS tf FROM (SELECT docid, len(ts) AS dl, unnest(ts) AS term FROM (SELECT doc_id AS docid, {_SPANISH} AS ts FROM documents)) GROUP BY ALL")
def index_postings(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("docid"), "text")
    return retrieve.postings(docs, "es")


@query(_bm25_sql(_TERMS.format("text")))
def bm25_topk(spark: SparkSession, folder: str) -> DataFrame:
    queries = table(spark, folder, "benchmark").select(F.col("item_id").alias("qid"), "text")
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("docid"), "text")
    return retrieve.bm25_topk(queries, docs, 10)


@query(f"""WITH {_RUN}, most AS (SELECT max(c) AS c FROM (SELECT count(*) AS c FROM judged WHERE rel > 0 GROUP BY qid))
SELECT qid, docid, round(1 / rank, 6) AS score, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY rank, docid) AS INT) AS place
  FROM run WHERE rel = 0 AND rank <= (SELECT c FROM most) + 3) WHERE place <= 3""")
def hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    run, qrels = _judged(spark, folder)
    return mining.hard_negatives(run, qrels, 3)


_STEP = "(SELECT min(s) FROM (SELECT unnest(range(greatest(1, n * 5 // 8), 2 * n + 2)) AS s) WHERE gcd(s, n) = 1)"


@query(f"""WITH {_RUN}, most AS (SELECT max(c) AS c FROM (SELECT count(*) AS c FROM judged WHERE rel > 0 GROUP BY qid)),
pos AS (SELECT qid, list_sort(list(DISTINCT docid)) AS pos FROM judged WHERE rel > 0 GROUP BY qid),
mined AS (SELECT qid, list({{'docid': docid, 'score': round(1 / rank, 6)}} ORDER BY place) AS mined, list(docid) AS ids FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank, docid) AS place
  FROM run WHERE rel = 0 AND rank <= (SELECT c FROM most) + 5) WHERE place <= 5 GROUP BY qid),
size AS (SELECT count(*) AS n FROM part), steps AS (SELECT n, {_STEP} AS step FROM size),
q AS (SELECT qid, pos, coalesce(mined, []) AS mined, list_concat(pos, coalesce(ids, [])) AS taken FROM pos LEFT JOIN mined USING (qid)),
f AS (SELECT q.*, list_filter(list_transform(range(0, least(len(taken) + 5, n)), lambda i: (CAST('0x' || substr(md5('33:' || qid), 1, 7) AS BIGINT) + i * step) % n), lambda d: NOT list_contains(taken, d)) AS draws FROM q, steps),
c AS (SELECT qid, pos, list_concat(mined, list_transform(draws, lambda d: {{'docid': d, 'score': -1.0::DOUBLE}}))[:5] AS neg FROM f),
x AS (SELECT qid, unnest(neg) AS x FROM c), n AS (SELECT qid, list(x.docid ORDER BY md5('33:' || qid || ':' || x.docid)) AS ids, list(x.score ORDER BY md5('33:' || qid || ':' || x.docid)) AS scores FROM x GROUP BY qid)
SELECT c.qid AS query_id, o_orderpriority AS query, array_to_string(pos, ',') AS positives, array_to_string(ids, ',') AS negatives, list_sum(scores) AS negative_scores
FROM c JOIN n USING (qid) JOIN orders ON o_orderkey = c.qid""")
def training_samples(spark: SparkSession, folder: str) -> DataFrame:
    run, qrels = _judged(spark, folder)
    queries = table(spark, folder, "orders").select(F.col("o_orderkey").alias("qid"), F.col("o_orderpriority").alias("query"))
    n_docs = table(spark, folder, "part").count()
    rows = mining.training_samples(queries, run, qrels, 5, n_docs)
    joined = lambda c: F.concat_ws(",", F.transform(c, lambda x: x.cast("string")))
    scores = F.aggregate("negatives.score", F.lit(0.0), lambda a, b: a + b)
    return rows.select(
        "query_id", "query", joined("positives.doc_id").alias("positives"), joined("negatives.doc_id").alias("negatives"),
        scores.alias("negative_scores"),
    )


@query(f"""WITH {_RUN}, sides AS (SELECT qid, list(docid ORDER BY docid) FILTER (rel > 0) AS pos, list(docid ORDER BY docid) FILTER (rel = 0) AS neg FROM judged GROUP BY qid)
SELECT qid, pos[(qid % 5) % len(pos) + 1] AS positive, neg[(qid % 5 * 2) % len(neg) + 1] AS negative_1, neg[(qid % 5 * 2 + 1) % len(neg) + 1] AS negative_2
FROM sides WHERE len(pos) > 0 AND len(neg) > 0""")
def sliced_training_groups(spark: SparkSession, folder: str) -> DataFrame:
    _, qrels = _judged(spark, folder)
    sides = qrels.groupBy("qid").agg(
        F.array_sort(F.collect_list(F.when(F.col("rel") > 0, F.col("docid")))).alias("pos"),
        F.array_sort(F.collect_list(F.when(F.col("rel") == 0, F.col("docid")))).alias("neg"),
    ).where("size(pos) > 0 AND size(neg) > 0")
    ids = mining.grouped_ids(F.col("pos"), F.col("neg"), F.col("qid") % 5, 2)
    names = ("positive", "negative_1", "negative_2")
    return sides.select("qid", ids.alias("ids")).select("qid", *[F.col("ids")[i].alias(n) for i, n in enumerate(names)])


@query(f"""WITH {_RUN}, head AS (SELECT qid, docid, rel * 1.0 - rank AS score FROM run WHERE rank <= 2),
tail AS (SELECT run.qid, run.docid, l.last - (run.rank - 2) AS score FROM run JOIN (SELECT qid, min(score) AS last FROM head GROUP BY qid) l USING (qid) WHERE rank > 2)
SELECT qid, docid, CAST(score AS DOUBLE) AS score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, docid) AS INT) AS rank
FROM (SELECT * FROM head UNION ALL SELECT * FROM tail)""")
def rerank_merge(spark: SparkSession, folder: str) -> DataFrame:
    run, qrels = _judged(spark, folder)
    head = run.where("rank <= 2").join(qrels, ["qid", "docid"]).select("qid", "docid", (F.col("rel") - F.col("rank")).cast("double").alias("score"))
    return mining.rerank_merge(head, run, 2)


@query(f"WITH {_RUN} SELECT qid, CAST(rank AS INT) AS rank, qid || ' Q0 ' || docid || ' ' || rank || ' ' || CAST(CAST(score AS DECIMAL(18, 6)) AS VARCHAR) || ' FV' AS line FROM run")
def trec_run_format(spark: SparkSession, folder: str) -> DataFrame:
    return writers.trec_run_lines(_judged(spark, folder)[0])


@query("SELECT DISTINCT l_linestatus AS split, l_returnflag AS country, l_orderkey AS qid, 'Q0' AS q0, l_partkey AS docid, 1 AS rel FROM lineitem")
def topics_qrels(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem")
    return writers.trec_qrels(
        rows.select(F.col("l_linestatus").alias("split"), F.col("l_returnflag").alias("country"), F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("docid"))
    )


@query("SELECT l_orderkey AS qid, l_partkey AS pid, round(1 / l_linenumber, 4) AS score FROM lineitem")
def prediction_scores(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem")
    score = F.coalesce(F.lit(None).cast("double"), F.round(1 / F.col("l_linenumber"), 4)).alias("score")
    return rows.select(F.col("l_orderkey").alias("qid"), F.col("l_partkey").alias("pid"), score)


@query("""SELECT vec_id, round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS norm,
  round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 6) AS self FROM embeddings""")
def embedding_norms(spark: SparkSession, folder: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, folder, "embeddings").select("vec_id", F.round(vectors.norm(e), 6).alias("norm"), F.round(vectors.dot(e, e), 6).alias("self"))


_CLEAN = "regexp_replace(regexp_replace(strip_accents(lower({})), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g')"
_LINES = """lines AS (SELECT doc_id, rid, line, row_number() OVER (PARTITION BY rid ORDER BY p) - 1 AS ix FROM
  (SELECT doc_id, rid, trim(regexp_replace(replace(unnest(ls), '#REDIRECCIÓN', ' '), '\\s+', ' ', 'g')) AS line, unnest(range(len(ls))) AS p
   FROM (SELECT doc_id, row_number() OVER () AS rid, string_split(text, chr(10)) AS ls FROM documents))
  WHERE len(list_filter(string_split(line, ' '), lambda w: w <> '')) >= 4)"""


@query(f"WITH {_LINES} SELECT doc_id || '#' || ix AS docid, line AS text FROM lines")
def passage_explode(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return passages(docs.select(F.col("doc_id").alias("id"), F.col("source").alias("title"), "text")).select("docid", "text")


@query(f"""WITH {_LINES},
answers AS (SELECT item_id AS answer_id, text, {_CLEAN.format('text')} AS a FROM benchmark),
pairs AS (SELECT answer_id, a, doc_id || '#' || ix AS docid, CAST(ix AS BIGINT) AS ix, {_CLEAN.format('line')} AS p
  FROM answers JOIN lines ON array_to_string(string_split(answers.text, ' ')[1:2], ' ') = array_to_string(string_split(line, ' ')[1:2], ' ') WHERE length(a) > 0),
held AS (SELECT answer_id, min_by(docid, (ix, docid)) AS docid, 1.0 AS score FROM pairs WHERE contains(p, a) GROUP BY answer_id),
rest AS (SELECT * FROM pairs WHERE answer_id NOT IN (SELECT answer_id FROM held)),
lcs AS (SELECT answer_id, docid, ix, length(a) AS n, list_max(list_transform(range(1, length(a) + 1), lambda i:
    list_max(list_transform(range(length(a) - i + 2), lambda k: CASE WHEN contains(p, substr(a, i, k)) THEN k ELSE 0 END)))) AS l FROM rest)
SELECT answer_id, docid, CAST(score AS DOUBLE) AS score FROM held UNION ALL
SELECT answer_id, (arg_min(docid, (-(l / n), ix, docid))) AS docid, max(round(l / n, 9)) AS score FROM lcs GROUP BY answer_id""")
def passage_match(spark: SparkSession, folder: str) -> DataFrame:
    """Items against passages that begin with the same two words (their title)."""
    from searchloom.functions.text import first_words

    items = table(spark, folder, "benchmark")
    answers = items.select(F.col("item_id").alias("answer_id"), first_words(F.col("text"), 2).alias("title"), F.col("text").alias("answer"))
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("title"), "text")
    found = passages(docs).select("docid", first_words(F.col("text"), 2).alias("title"), "text")
    found = found.withColumn("passage_ix", F.substring_index("docid", "#", -1).cast("long"))
    return match.match(answers, found).withColumn("score", F.round("score", 9))


@query("""SELECT CASE WHEN o_orderstatus = 'P' THEN 'no_country' ELSE o_orderstatus END AS country, o_orderkey AS id, o_orderpriority AS query, CAST(o_custkey AS VARCHAR) AS docid,
  c_name AS docid_text, CAST(o_orderdate AS DATE) AS query_date, CAST(o_orderdate AS DATE) AS answer_date, CAST(round_even(o_totalprice / 500000, 4) AS FLOAT) AS match_score,
  o_orderstatus = 'F' AS expanded_search, o_orderpriority AS answer_type FROM orders LEFT JOIN customer ON c_custkey = o_custkey WHERE o_totalprice / 500000 > 0.5""")
def judged_dataset(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as queries, pages and matched answers; customers as passages."""
    rows = table(spark, folder, "orders")
    queries = rows.selectExpr("o_orderkey AS id", "o_orderpriority AS question", "replace(o_orderstatus, 'P', 'general') AS country", "CAST(o_orderdate AS DATE) AS date")
    found = rows.selectExpr(
        "o_orderkey AS id", "CAST(o_custkey AS STRING) AS corpus_docid", "o_totalprice / 500000 AS match_score",
        "o_orderstatus = 'F' AS expanded_search", "o_orderpriority AS answer_type",
    )
    texts = table(spark, folder, "customer").selectExpr("CAST(c_custkey AS STRING) AS docid", "c_name AS text")
    return dataset.judged_dataset(queries, queries.select("id", "date"), found, texts)


@query("SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS qid, 'Q0' AS q0, CAST(l_partkey AS VARCHAR) AS docid, 1 AS rel FROM lineitem WHERE l_quantity > 25")
def canonical_judgments(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").withColumn("rel", (F.col("l_quantity") > 25).cast("int"))
    return dataset.canonical_qrels(rows, "l_orderkey", "l_partkey", "rel")
