"""Curation, joins, snapshots, splits and text queries.

Roles: ``documents`` are questions or articles, ``orders`` and ``customer``
queries and their incremental batches, ``pages`` result pages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from searchloom.functions import text
from searchloom.operators import corpus, curate, frontier, html_extract, sampling, split
from searchloom.plans.registry import query
from searchloom.sources import readers, writers
from searchloom.sources.readers import table

_FROM = text.MARKED + "ñÑ"
_TO = text.PLAIN + "nN"
_PATTERNS = "|".join(p for p in text.NEGATIVE_PATTERNS if "(?<" not in p).replace("'", "''")
_W = r"\p{L}\p{N}_"


@query(f"""WITH q AS (SELECT doc_id, translate(text, '¿', '') AS question, source, lang FROM documents WHERE text IS NOT NULL),
d AS (SELECT min(doc_id) AS doc_id, question FROM q GROUP BY question),
k AS (SELECT doc_id, question, translate(lower(question), '{_FROM}', '{_TO}') AS key FROM d
  WHERE length(question) - length(replace(question, ' ', '')) > 1 AND NOT regexp_matches(lower(question), '{_PATTERNS}')
    AND NOT contains(replace(lower(question), 'barça', ''), 'ç') AND NOT regexp_matches(lower(question), '^([{_W}]+ ){{0,3}}wikipedia$'))
SELECT max_by(doc_id, (question, doc_id)) AS doc_id, max(question) AS question FROM k GROUP BY key""")
def question_cleaning(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", F.col("text").alias("question"))
    return curate.clean_questions(rows, ["doc_id"], frontier.accented(frontier.seeds(spark)))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_totalprice > 200000)")
def anti_join_incremental(spark: SparkSession, folder: str) -> DataFrame:
    known = table(spark, folder, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return curate.unseen(table(spark, folder, "customer").select("c_custkey", "c_name"), known, ["c_custkey"])


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def to_fetch(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), F.when(F.col("l_returnflag") == "R", F.lit("page")).alias("html")
    )
    return curate.to_fetch(table(spark, folder, "orders").select("o_orderkey", "o_orderdate"), pages, "o_orderkey")


def _orders(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    late = rows.where("o_orderstatus <> 'F'")
    moved = late.withColumn("o_totalprice", F.col("o_totalprice") * 2)
    new = late.withColumn("o_orderkey", F.col("o_orderkey") + 1_000_000_000)
    return rows, moved.union(new)


_BATCH = """batch AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice * 2 AS o_totalprice FROM orders WHERE o_orderstatus <> 'F'
  UNION ALL SELECT o_orderkey + 1000000000, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus <> 'F')"""
_ORDER_COLUMNS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice"


@query(f"""WITH {_BATCH} SELECT coalesce(b.o_orderkey, o.o_orderkey) AS o_orderkey, coalesce(o.o_custkey, b.o_custkey) AS o_custkey,
  coalesce(b.o_orderstatus, o.o_orderstatus) AS o_orderstatus, coalesce(b.o_totalprice, o.o_totalprice) AS o_totalprice
FROM orders o FULL JOIN batch b USING (o_orderkey)""")
def upsert_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    return writers.upsert(*_orders(spark, folder), "o_orderkey", ["o_orderstatus", "o_totalprice"])


@query(f"WITH {_BATCH} SELECT {_ORDER_COLUMNS} FROM orders UNION ALL SELECT {_ORDER_COLUMNS} FROM batch WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders)")
def insert_ignore(spark: SparkSession, folder: str) -> DataFrame:
    return writers.insert_ignore(*_orders(spark, folder), "o_orderkey", ["o_totalprice"])


@query(f"WITH {_BATCH} SELECT o_orderkey, o.o_custkey, o.o_orderstatus, coalesce(b.o_totalprice, o.o_totalprice) AS o_totalprice FROM orders o LEFT JOIN batch b USING (o_orderkey)")
def update_from(spark: SparkSession, folder: str) -> DataFrame:
    return writers.update_from(*_orders(spark, folder), "o_orderkey", ["o_totalprice"])


@query("""SELECT o_orderkey, c_name, p_name, l_linenumber, l_discount FROM lineitem JOIN orders ON o_orderkey = l_orderkey
JOIN customer ON c_custkey = o_custkey JOIN part ON p_partkey = l_partkey WHERE l_discount > 0.05""")
def star_join_matched(spark: SparkSession, folder: str) -> DataFrame:
    """Judged lines above a score with their query, country and document. The
    filter and the columns reach the scans; sides are broadcast by size."""
    lines = curate.matched(table(spark, folder, "lineitem"), "l_discount", 0.05)
    rows = lines.join(table(spark, folder, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    rows = rows.join(table(spark, folder, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    rows = rows.join(table(spark, folder, "part"), F.col("p_partkey") == F.col("l_partkey"))
    return rows.select("o_orderkey", "c_name", "p_name", "l_linenumber", "l_discount")


_EDGES = "e AS (SELECT DISTINCT o_custkey || o_orderstatus AS query, o_custkey || o_orderpriority AS article FROM orders)"


@query(f"""WITH RECURSIVE {_EDGES}, r(article) AS (SELECT DISTINCT article FROM e WHERE article LIKE '%1-URGENT'
  UNION SELECT e2.article FROM r JOIN e e1 ON e1.article = r.article JOIN e e2 ON e2.query = e1.query)
SELECT query, article, CASE WHEN article IN (SELECT article FROM r) THEN 'train' ELSE 'test' END AS split FROM e""")
def leakage_free_split(spark: SparkSession, folder: str) -> DataFrame:
    """Queries (customer and status) and articles (customer and priority): what is linked to an urgent order is train."""
    rows = table(spark, folder, "orders")
    key = F.col("o_custkey").cast("string")
    edges = rows.select(F.concat(key, "o_orderstatus").alias("query"), F.concat(key, "o_orderpriority").alias("article")).distinct()
    initial = edges.where(F.endswith("article", F.lit("1-URGENT"))).select("article")
    return split.split_by_closure(edges, initial).select("query", "article", "split")


_CUT = """per AS (SELECT o_custkey AS article, count(*) AS n, round(avg(o_totalprice), 6) AS s,
    round(avg(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END), 6) AS x, min(o_orderkey) AS t FROM orders GROUP BY o_custkey),
sums AS (SELECT article, n, coalesce(sum(n) OVER (ORDER BY s DESC, x, t, article ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM per)"""


@query(f"""WITH {_CUT} SELECT article, n, CAST(before AS BIGINT) AS rows_before,
  CASE WHEN before + 1 <= (SELECT count(*) * 2 // 5 FROM orders) THEN 'test' ELSE 'train' END AS split FROM sums""")
def score_cut_split(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("article"), F.col("o_totalprice").alias("score"),
        (F.col("o_orderstatus") == "P").cast("int").alias("expanded"), F.col("o_orderkey").alias("tie"),
    )
    return split.score_cut(rows, rows.count() * 2 // 5)


@query("""WITH f AS (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL)
SELECT o_orderkey, o_custkey, o_orderpriority, dense_rank() OVER (ORDER BY o_custkey) + 99 AS id FROM f""")
def full_set_dense_ids(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return split.pooled_queries(rows, ["o_custkey", "o_orderpriority"], ["o_orderkey"], "o_custkey", "id", 100)


@query("""WITH f AS (SELECT p_brand, min(p_partkey) AS k FROM part GROUP BY p_brand)
SELECT p_partkey, p_brand, CAST(c AS BIGINT) AS code FROM part JOIN (SELECT p_brand, row_number() OVER (ORDER BY k) - 1 AS c FROM f) USING (p_brand)""")
def factorised_codes(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "part").select("p_partkey", "p_brand")
    return corpus.factorised(rows, "p_brand", ["p_partkey"], "code").select("p_partkey", "p_brand", "code")


@query("SELECT page_id, replace(url_decode(split_part(url, '#', 1)), '_', ' ') AS title FROM pages")
def url_title(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select("page_id", text.article_title(F.col("url")).alias("title"))


@query("""SELECT c_custkey, 'http://www.google.com.mx/search?q=' || replace(url_encode(c_name || ' wikipedia'), '%20', '+') || '&gl=mx&hl=es' AS url FROM customer""")
def search_urls(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "customer").select("c_custkey", F.col("c_name").alias("question"), F.lit("mx").alias("country"))
    return curate.with_search_url(rows).select("c_custkey", "url")


@query("""SELECT page_id, CASE WHEN NOT regexp_matches(html, '<h2|answered-question|kp-header|data-attrid') THEN 'no_answer' END AS answer_type, NULL::VARCHAR AS short_answer,
  NULL::VARCHAR AS answer, NULL::VARCHAR[] AS items, NULL::VARCHAR AS answer_url, contains(lower(html), 'se incluyen resultados de') AS expanded_search FROM pages""")
def html_extract_answers(spark: SparkSession, folder: str) -> DataFrame:
    """The raw pages; none has a heading or a mark (``page_rules`` has pages of every kind)."""
    pages = table(spark, folder, "pages").select("page_id", html_extract.extract_answer("html").alias("a"))
    return pages.select("page_id", "a.*")


@query("""SELECT k, count(*) AS n FROM (SELECT unnest(regexp_extract_all(props, '"k": (\\d+)', 1)) AS k FROM events) GROUP BY k""")
def log_mining(spark: SparkSession, folder: str) -> DataFrame:
    found = F.regexp_extract_all("props", F.lit(r'"k": (\d+)'), F.lit(1))
    return table(spark, folder, "events").select(F.explode(found).alias("k")).groupBy("k").agg(F.count("*").alias("n"))


_SEEDS = ("the", "of", "is the", "en", "le", "de", "de la", "la", "die", "der", "el", "un")


def _frontier_sql() -> str:
    seeds = ", ".join(f"('{s}')" for s in _SEEDS)
    return f"""WITH r AS (SELECT DISTINCT lower(text) AS result FROM documents WHERE text IS NOT NULL), s(p) AS (VALUES {seeds}),
m AS (SELECT result, max_by(p, length(p)) AS seed FROM r JOIN s ON starts_with(ltrim(result, '¿'), p || ' ') GROUP BY result),
w AS (SELECT result, seed, regexp_extract_all(result, '[^ \\t\\n\\x0B\\f\\r]+') AS ws FROM r LEFT JOIN m USING (result)),
p AS (SELECT md5(result) AS result, seed, CASE WHEN seed IS NOT NULL AND len(ws) >= len(string_split(seed, ' ')) + 1
    THEN array_to_string(ws[1:len(string_split(seed, ' ')) + 1], ' ') || ' ' ELSE result END AS prefix FROM w)
SELECT result, seed, md5(prefix) AS prefix, count(*) OVER (PARTITION BY prefix) AS n_results FROM p"""


@query(_frontier_sql())
def frontier_expand(spark: SparkSession, folder: str) -> DataFrame:
    results = table(spark, folder, "documents").where("text IS NOT NULL").select(F.lower("text").alias("result")).distinct()
    rows = frontier.prefixes_of(results, frontier.seeds(spark, _SEEDS), 1)
    return rows.select(F.md5("result").alias("result"), "seed", F.md5("prefix").alias("prefix"), "n_results")


@query("SELECT conv_id || '-' || turn AS id, role AS title, trim(text) AS context, trim(text) AS question, CAST(conv_id AS VARCHAR) AS answer, CAST(turn AS INT) AS answer_start FROM conversations")
def nested_flatten(spark: SparkSession, folder: str) -> DataFrame:
    """Turns as nested question documents, and flat again."""
    rows = table(spark, folder, "conversations")
    answers = F.array(F.struct(F.col("conv_id").cast("string").alias("text"), F.col("turn").cast("int").alias("answer_start")))
    qas = F.array(F.struct(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("text").alias("question"), answers.alias("answers")))
    paragraphs = F.array(F.struct(F.col("text").alias("context"), qas.alias("qas")))
    return readers.flatten_qa(rows.select(F.array(F.struct(F.col("role").alias("title"), paragraphs.alias("paragraphs"))).alias("data")))


@query("""SELECT 'customer' AS kind, c_custkey AS key, c_name AS name, c_mktsegment AS segment, NULL::DOUBLE AS balance FROM customer
UNION ALL SELECT 'supplier', s_suppkey, s_name, NULL, s_acctbal FROM supplier""")
def tagged_union(spark: SparkSession, folder: str) -> DataFrame:
    parts = {
        "customer": table(spark, folder, "customer").selectExpr("c_custkey AS key", "c_name AS name", "c_mktsegment AS segment"),
        "supplier": table(spark, folder, "supplier").selectExpr("s_suppkey AS key", "s_name AS name", "s_acctbal AS balance"),
    }
    return sampling.tagged_union(parts, "kind").select("kind", "key", "name", "segment", "balance")


@query("""SELECT 'both' AS part, count(*) AS n FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier)
UNION ALL SELECT 'first', count(*) FROM (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal < 0)
UNION ALL SELECT 'repeats', count(*) - count(DISTINCT o_custkey) FROM orders""")
def key_sets(spark: SparkSession, folder: str) -> DataFrame:
    customer, orders = table(spark, folder, "customer"), table(spark, folder, "orders")
    both = customer.select("c_nationkey").intersect(table(spark, folder, "supplier").select("s_nationkey"))
    first = orders.select("o_custkey").subtract(customer.where("c_acctbal < 0").select("c_custkey"))
    count = lambda name, rows: rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
    repeats = orders.agg((F.count("*") - F.countDistinct("o_custkey")).alias("n")).select(F.lit("repeats").alias("part"), "n")
    return count("both", both).union(count("first", first)).union(repeats)


def _hash(seed: int, key: str) -> str:
    return f"md5('{seed}:' || {key}), {key}"


@query(f"""WITH n AS (SELECT min(c) AS n FROM (SELECT count(*) AS c FROM documents GROUP BY lang))
SELECT doc_id, lang, place FROM (SELECT doc_id, lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY {_hash(33, 'doc_id')}) AS INT) AS place FROM documents)
WHERE place <= (SELECT n FROM n)""")
def stratified_sample(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.stratified(table(spark, folder, "documents").select("doc_id", "lang"), "lang", "doc_id")


@query(f"""SELECT doc_id, place, CASE WHEN place <= 50 THEN 0 ELSE CAST((place - 51) // 40 + 1 AS INT) END AS part FROM
(SELECT doc_id, CAST(row_number() OVER (ORDER BY {_hash(33, 'doc_id')}) AS INT) AS place FROM documents) WHERE place <= 170""")
def disjoint_samples(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.disjoint(table(spark, folder, "documents").select("doc_id"), "doc_id", 50, 3, 40)


@query("""SELECT doc_id, translate(regexp_replace(lower(text), '[^\\p{L}\\p{N}_\\s]', '', 'g'), '%s', '%s') AS keep_enie,
  trim(regexp_replace(translate(regexp_replace(lower(text), '[!-/:-@\\[-`{-~¿¡]', '', 'g'), '%s', '%s'), '\\s+', ' ', 'g')) AS plain FROM documents"""
    % (text.MARKED, text.PLAIN, _FROM, _TO))
def normal_forms(spark: SparkSession, folder: str) -> DataFrame:
    t = F.col("text")
    return table(spark, folder, "documents").select("doc_id", text.normal_keep_enie(t).alias("keep_enie"), text.normal_ascii(t).alias("plain"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN o_totalprice ELSE -1 END AS score, o_orderstatus || '. ' || o_orderpriority AS joined FROM orders")
def lookup_defaults(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "orders")
    scores = F.create_map(F.lit("P"), F.col("o_totalprice"))
    return rows.select(
        "o_orderkey", F.coalesce(F.element_at(scores, F.col("o_orderstatus")), F.lit(-1.0)).alias("score"),
        text.joined_fields(F.col("o_orderstatus"), F.col("o_orderpriority")).alias("joined"),
    )


@query("SELECT DISTINCT event_id, user_id, event_type FROM events")
def streaming_ingest(spark: SparkSession, folder: str) -> DataFrame:
    """Events ingested as a file stream, each id once."""
    from searchloom.plans.checkpoints import scratch_path
    from searchloom.streaming import incremental

    rows = table(spark, folder, "events")
    inbox, base = rows.select("event_id", "user_id", "event_type"), scratch_path(spark, "inbox")
    inbox.write.parquet(base)
    target = scratch_path(spark, "ingested")
    stream = incremental.file_stream(spark, base, inbox.schema)
    incremental.ingest(stream, f"{target}/out", "event_id", f"{target}/state").awaitTermination()
    return spark.read.schema(inbox.schema).parquet(f"{target}/out")
