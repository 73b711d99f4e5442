"""Files and formats: rows go out through a writer, come back through a reader,
and are compared with the tables they came from. And the text, array and page
rules, on rows whose answers SQL can build.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from searchloom.functions import python_functions, text
from searchloom.operators import agreement, corpus, dataset, frontier, html_extract, sampling
from searchloom.plans.checkpoints import named_files, scratch_path
from searchloom.plans.registry import query
from searchloom.sources import readers, writers
from searchloom.sources.readers import table

_DAY = "2024-04-01"


@query(f"""SELECT c_name || ' qué' AS question, DATE '{_DAY}' AS date, CAST(c_nationkey AS INT) AS relevance, CAST(c_custkey % 7 AS INT) AS relevance_rank,
  CASE WHEN c_custkey % 2 = 0 THEN 'mx' ELSE 'ar' END AS country FROM customer
UNION ALL SELECT s_name, NULL, NULL, NULL, 'general' FROM supplier""")
def question_files(spark: SparkSession, folder: str) -> DataFrame:
    """Appended question lines of two countries, and a file of short rows."""
    path = scratch_path(spark, "questions")
    rows = table(spark, folder, "customer").selectExpr("concat(c_name, ' qué') AS question", "c_nationkey AS relevance", "c_custkey % 7 AS relevance_rank", "c_custkey % 2 AS odd")
    for odd, country in ((0, "mx"), (1, "ar")):
        lines = writers.question_lines(rows.where(F.col("odd") == odd), F.lit(_DAY))
        writers.append_tsv(lines, f"{path}/country={country}")
    table(spark, folder, "supplier").select("s_name").write.text(f"{path}/country=general")
    named_files(spark, path, lambda country, i: f"{i}_questions_{country}.txt")
    return readers.questions(spark, f"{path}/*_questions_*.txt")


@query("""SELECT 'result' AS kind, s_name AS found FROM supplier UNION ALL SELECT 'query', s_name FROM supplier WHERE s_suppkey % 2 = 0
UNION ALL SELECT 'general', s_name FROM supplier WHERE s_suppkey % 2 = 1""")
def log_files(spark: SparkSession, folder: str) -> DataFrame:
    """Earlier results (first field, once) and what logs say of prefixes."""
    path = scratch_path(spark, "logs")
    rows = table(spark, folder, "supplier")
    rows.select(F.concat("s_name", F.lit("\t"), "s_suppkey")).union(rows.select("s_name")).write.text(f"{path}/results")
    said = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("INFO prefix='"), "s_name", F.lit("': searching it")))
    said = said.otherwise(F.concat(F.lit("** '"), "s_name", F.lit("': localization_works=False")))
    rows.select(said).union(rows.select(F.lit("another line"))).write.text(f"{path}/log")
    found = {
        "result": readers.previous_results(spark, f"{path}/results"),
        "query": readers.past_queries(spark, f"{path}/log"),
        "general": readers.past_general_prefixes(spark, f"{path}/log"),
    }
    parts = [rows.toDF("found").select(F.lit(kind).alias("kind"), "found") for kind, rows in found.items()]
    return reduce(DataFrame.union, parts)


@query(f"""SELECT s_suppkey AS id, CASE s_suppkey % 3 WHEN 0 THEN 'mx' WHEN 1 THEN 'us' ELSE '' END AS country, '<p>' || s_name || '</p>' AS html, DATE '{_DAY}' AS date
FROM supplier""")
def page_batch_files(spark: SparkSession, folder: str) -> DataFrame:
    """Gzip JSON arrays of pages with and without a country, and a corrupt file, which is skipped."""
    path = scratch_path(spark, "pages")
    page = F.struct(F.col("s_suppkey").alias("id"), F.lit(_DAY).alias("date"), F.concat(F.lit("<p>"), "s_name", F.lit("</p>")).alias("html"))
    rows = table(spark, folder, "supplier").groupBy((F.col("s_suppkey") % 3).alias("batch"), (F.col("s_suppkey") % 20).alias("file"))
    lines = rows.agg(F.to_json(F.collect_list(page)).alias("line")).select("line", "batch")
    lines.write.option("compression", "gzip").option("maxRecordsPerFile", 1).partitionBy("batch").text(path)
    names = {"0": "mx_htmls_", "1": "us_htmls_", "2": "htmls_"}
    named_files(spark, path, lambda batch, i: f"{names[batch]}{i}.json.gz")
    spark.createDataFrame([("not gzip at all",)], "line string").coalesce(1).write.text(f"{path}/bad")
    named_files(spark, f"{path}/bad", lambda _, i: f"mx_htmls_bad{i}.json.gz")
    return readers.page_batches(spark, f"{path}/*.json.gz,{path}/bad/*.json.gz".split(","))


@query("""SELECT 'passage' AS kind, CAST(p_partkey AS VARCHAR) AS id, p_brand AS title, p_name AS text FROM part
UNION ALL SELECT 'article', CAST(p_partkey AS VARCHAR), p_brand, p_name FROM part
UNION ALL SELECT 'renumbered', CAST(row_number() OVER (ORDER BY CAST(p_partkey AS VARCHAR)) - 1 AS VARCHAR), p_brand, p_name FROM part""")
def corpus_files(spark: SparkSession, folder: str) -> DataFrame:
    """Shards of passages and articles; passages under dense numbers by their id table."""
    path = scratch_path(spark, "corpus")
    rows = table(spark, folder, "part").select(F.col("p_partkey").cast("string").alias("docid"), F.col("p_brand").alias("title"), F.col("p_name").alias("text"))
    writers.jsonl_shards(rows, f"{path}/passages", 100)
    writers.jsonl_shards(rows.withColumnRenamed("docid", "id").withColumn("url", F.lit("u")), f"{path}/wiki")
    passages = readers.passages(spark, f"{path}/passages")
    articles = readers.articles(spark, f"{path}/wiki").select(F.lit("article").alias("kind"), "id", "title", "text")
    numbered, ids = dataset.training_passages(passages)
    ids.write.parquet(f"{path}/ids")
    ids = readers.id_map(spark, f"{path}/ids")
    known = passages.join(ids, passages["docid"] == ids["old_id"]).join(numbered.select(F.col("id").alias("new_id"), "contents"), "new_id")
    known = known.where("contents = text").select(F.lit("renumbered").alias("kind"), F.col("new_id").alias("id"), "title", "text")
    return passages.select(F.lit("passage").alias("kind"), F.col("docid").alias("id"), "title", "text").union(articles).union(known)


@query("""SELECT DISTINCT 'topic' AS kind, CAST(o_custkey AS VARCHAR) AS qid, 'c' || o_custkey AS value, 0 AS rank, 0.0::DOUBLE AS score FROM orders
UNION ALL SELECT DISTINCT 'qrel', CAST(o_custkey AS VARCHAR), CAST(o_orderkey AS VARCHAR), 1, 0.0 FROM orders
UNION ALL SELECT 'run', CAST(o_custkey AS VARCHAR), CAST(o_orderkey AS VARCHAR), CAST(o_orderkey % 100 AS INT), round(o_totalprice, 2) FROM orders""")
def trec_files(spark: SparkSession, folder: str) -> DataFrame:
    """Topics, judgments and a run as files, read again."""
    path = scratch_path(spark, "trec")
    rows = table(spark, folder, "orders").select(
        F.col("o_orderstatus").alias("split"), F.lit("mx").alias("country"), F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("docid"),
        F.concat(F.lit("c"), "o_custkey").alias("query"), "o_orderkey", F.round("o_totalprice", 2).alias("score"),
    )
    writers.write_topics_and_qrels(rows, path)
    writers.write_run(rows.select(F.col("id").alias("qid"), "docid", (F.col("o_orderkey") % 100).alias("rank"), "score"), f"{path}/run")
    topics = readers.topics(spark, f"{path}/topics/*/*").select(F.lit("topic").alias("kind"), "qid", F.col("query").alias("value"), F.lit(0).alias("rank"), F.lit(0.0).alias("score"))
    qrels = readers.qrels(spark, f"{path}/qrels/*/*").select(F.lit("qrel").alias("kind"), "qid", F.col("docid").alias("value"), F.col("rel").alias("rank"), F.lit(0.0).alias("score"))
    run = readers.run(spark, f"{path}/run").select(F.lit("run").alias("kind"), "qid", F.col("docid").alias("value"), "rank", "score")
    return topics.distinct().union(qrels.distinct()).union(run)


@query("""SELECT 'prediction' AS kind, CAST(l_orderkey AS VARCHAR) AS id, CAST(l_partkey AS VARCHAR) AS value,
  CASE WHEN l_linenumber % 2 = 0 THEN round(l_discount, 3) ELSE round(1 / l_linenumber, 4) END AS score FROM lineitem
UNION ALL SELECT 'answers', 'is "' || p_partkey || '" it', p_brand || '|' || p_type, 0 FROM part
UNION ALL SELECT 'sample', CAST(p_partkey AS VARCHAR), p_brand, p_size FROM part""")
def ranking_files(spark: SparkSession, folder: str) -> DataFrame:
    """Predictions with and without scores, questions with answers, training samples."""
    path = scratch_path(spark, "ranking")
    lines, parts = table(spark, folder, "lineitem"), table(spark, folder, "part")
    score = F.when(F.col("l_linenumber") % 2 == 0, F.round("l_discount", 3))
    lines.select("l_orderkey", "l_partkey", "l_linenumber", score).write.csv(f"{path}/predictions", sep="\t")
    asked = F.concat(F.lit('"is ""'), "p_partkey", F.lit('"" it"'))
    both = F.to_json(F.array("p_brand", "p_type"))
    parts.select(F.concat_ws("\t", asked, both)).write.text(f"{path}/answers")
    side = F.struct(F.array("p_brand").alias("doc_id"), F.array(F.col("p_size").cast("double")).alias("score"))
    samples = parts.select(F.col("p_partkey").cast("string").alias("query_id"), F.col("p_name").alias("query"), side.alias("positives"), side.alias("negatives"))
    for half in (0, 1):
        samples.where(F.col("query_id").cast("long") % 2 == half).write.json(f"{path}/samples{half}")
    predictions = readers.predictions(spark, f"{path}/predictions").select(F.lit("prediction").alias("kind"), F.col("qid").alias("id"), F.col("pid").alias("value"), "score")
    answers = readers.query_answers(spark, f"{path}/answers").select(F.lit("answers"), "question", F.concat_ws("|", "answers"), F.lit(0.0))
    read = readers.training_samples(spark, f"{path}/samples0,{path}/samples1")
    read = read.select(F.lit("sample"), "query_id", F.col("positives.doc_id")[0], F.col("negatives.score")[0])
    return predictions.union(answers).union(read)


@query("""SELECT vec_id AS id, round(CAST(e AS DOUBLE) / greatest(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 1e-12), 4) AS first
FROM (SELECT vec_id, embedding, embedding[1] AS e FROM embeddings)""")
def vector_store(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors are appended in batches; those that are stored are left out; read normalised."""
    path = scratch_path(spark, "vectors")
    rows = table(spark, folder, "embeddings").select(F.col("vec_id").cast("string").alias("id"), "embedding")
    half = rows.where(F.pmod(F.xxhash64("id"), F.lit(2)) == 0)
    writers.vectors(half, path)
    writers.vectors(rows.union(half), path)
    stored = readers.embeddings(spark, path, normalise=True)
    left = corpus.not_encoded(rows, stored)
    first = F.round(F.col("embedding")[0].cast("double"), 4)
    return stored.union(left).select(F.col("id").cast("long").alias("id"), first.alias("first"))


@query("""SELECT 'page' AS kind, n_name AS name, n_regionkey AS n FROM nation WHERE n_nationkey % 2 = 0
UNION ALL SELECT 'months', CAST(r_regionkey AS VARCHAR), 12 FROM region UNION ALL SELECT 'metric', replace(r_name, ' ', '_'), r_regionkey FROM region
UNION ALL SELECT 'sheet', 'ana', count(*) FROM nation UNION ALL SELECT 'files', 'txt', 2 UNION ALL SELECT 'urls', 'mx', count(*) FROM nation""")
def odd_files(spark: SparkSession, folder: str) -> DataFrame:
    """Remaining rows, monthly counts, evaluation text, annotation sheets, file lists, addresses by country."""
    path = scratch_path(spark, "odd")
    nation, region = table(spark, folder, "nation"), table(spark, folder, "region")
    left = writers.remaining(nation.withColumnRenamed("n_nationkey", "id"), nation.where("n_nationkey % 2 = 1").select(F.col("n_nationkey").alias("id")))
    parts = [left.select(F.lit("page").alias("kind"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("long").alias("n"))]
    months = F.explode(F.transform(F.sequence(F.lit(1), F.lit(12)), lambda m: F.format_string("2023-%02d", m)))
    counts = region.select(F.lit("es"), F.col("r_regionkey").cast("string"), F.lit("5 to 99"), F.lit(5), F.lit(99), months.alias("month"))
    counts.write.partitionBy("month").csv(f"{path}/geo", sep="\t")
    named_files(spark, f"{path}/geo", lambda month, i: f"geoeditors-monthly-{month}-{i}.tsv")
    read = readers.geoeditors(spark, f"{path}/geo/*.tsv").groupBy("country").agg(F.countDistinct("month").alias("n"))
    parts.append(read.select(F.lit("months"), "country", "n"))
    line = F.concat(F.lit("ndcg_"), F.replace("r_name", F.lit(" "), F.lit("_")), F.lit("\tall  "), F.col("r_regionkey").cast("string"))
    region.select(line).union(region.select(F.lit("map all 3"))).coalesce(1).write.text(f"{path}/eval")
    named_files(spark, f"{path}/eval", lambda _, i: f"model_{i}.txt")
    read = readers.evaluations(spark, f"{path}/eval/model_*.txt").where("model = 'model'")
    parts.append(read.select(F.lit("metric"), F.replace("metric", F.lit("ndcg_"), F.lit("")), F.col("value").cast("long")))
    sheet = nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("query"), F.lit(1).alias("correct"), F.lit(0).alias("unambiguous"), F.lit(1).alias("relevant"))
    sheet.coalesce(1).write.csv(f"{path}/sheets", header=True)
    named_files(spark, f"{path}/sheets", lambda _, i: "ana.csv")
    read = readers.annotation_sheets(spark, f"{path}/sheets/*.csv").groupBy("annotator").agg(F.count("*").alias("n"))
    parts.append(read.select(F.lit("sheet"), "annotator", "n"))
    region.select("r_name").coalesce(1).write.text(f"{path}/list/a")
    region.select("r_name").coalesce(1).write.text(f"{path}/list/b")
    read = readers.matching_files(spark, f"{path}/list", "*.txt").agg(F.count("*").alias("n"))
    parts.append(read.select(F.lit("files"), F.lit("txt"), "n"))
    writers.urls_by_country(nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("url"), F.lit("mx").alias("country")), f"{path}/urls")
    read = spark.read.schema("id long, url string, country string").csv(f"{path}/urls", sep="\t").groupBy("country").agg(F.count("url").alias("n"))
    parts.append(read.select(F.lit("urls"), "country", "n"))
    return reduce(DataFrame.union, parts)


@query("""SELECT c_custkey, '"' || c_name || '", said' || chr(10) || 'twice' AS quoted, c_acctbal FROM customer""")
def csv_files(spark: SparkSession, folder: str) -> DataFrame:
    """Values with quotes, commas and line breaks through comma-separated files."""
    path = scratch_path(spark, "csv")
    rows = table(spark, folder, "customer").select("c_custkey", F.concat(F.lit('"'), "c_name", F.lit('", said\ntwice')).alias("quoted"), "c_acctbal")
    rows.write.option("compression", "gzip").csv(path, header=True, escape='"')
    return readers.csv_table(spark, path, "c_custkey long, quoted string, c_acctbal double")


@query("""SELECT 'queries' AS name, 7 AS n_columns UNION ALL SELECT 'htmls', 4 UNION ALL SELECT 'extractions', 10""")
def warehouse_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Tables are made where they don't exist; a second time makes none."""
    from searchloom.sources import schemas

    before, name = spark.catalog.currentDatabase(), "searchloom_made"
    spark.sql(f"CREATE DATABASE {name} LOCATION '{scratch_path(spark, 'warehouse')}'")
    try:
        spark.catalog.setCurrentDatabase(name)
        made = writers.create_tables(spark)
        if made != [*schemas.TABLES] or writers.create_tables(spark):
            raise ValueError("tables were not made once")
        rows = [(t, len(spark.table(t).columns)) for t in made]
    finally:
        spark.catalog.setCurrentDatabase(before)
        spark.sql(f"DROP DATABASE {name} CASCADE")
    return spark.createDataFrame(rows, "name string, n_columns int")


@query("""SELECT p_partkey, replace(lower(p_name), 'a', 'A') AS entities, split_part(CAST(p_partkey AS VARCHAR) || '#' || p_size, '#', 1) AS article,
  replace(replace(p_brand || '_&%', '&', '\\&'), '%', '\\%') AS latex_rest, string_split(p_type, ' ')[1] AS first_word, p_brand AS unquoted,
  'http://www.google.com.mx/complete/search?client=chrome&q=' || p_partkey || '&gl=mx&hl=es' AS suggest, 'w, x n=' || printf('%d', p_size) || ' (' || printf('%.1f', p_size / 2.0) || '%)' AS label,
  CASE WHEN p_size > 20 THEN p_type END AS after, length(p_type) - length(replace(p_type, ' ', '')) + 1 AS n_words, starts_with(p_type, 'STANDARD') AS starts, ends_with(p_type, 'X') AS ends
FROM part""")
def text_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Entities, ids, LaTeX, splits, quotes, addresses, topic labels, delimiters, tests of case and ends."""
    marked = F.when(F.col("p_size") > 20, F.concat(F.lit("x = "), "p_type")).otherwise(F.col("p_type"))
    return table(spark, folder, "part").select(
        "p_partkey",
        python_functions.html_unescape(F.replace(F.lower("p_name"), F.lit("a"), F.lit("&#65;"))).alias("entities"),
        text.article_id(F.concat_ws("#", "p_partkey", "p_size")).alias("article"),
        F.replace(text.latex_safe(F.concat("p_brand", F.lit("_&%"))), F.lit("\\_"), F.lit("_")).alias("latex_rest"),
        text.first_words(F.col("p_type"), 1).alias("first_word"),
        python_functions.normalise_quotes(F.concat(F.lit('""'), "p_brand", F.lit('""'))).alias("unquoted"),
        text.suggest_url(F.col("p_partkey").cast("string"), F.lit("mx")).alias("suggest"),
        text.topic_label(F.lit("3_w_x"), F.col("p_size"), F.col("p_size") / 2).alias("label"),
        text.after_delimiter(marked, "x = ").alias("after"),
        text.word_count(F.col("p_type")).alias("n_words"),
        F.startswith("p_type", F.lit("STANDARD")).alias("starts"),
        F.endswith("p_type", F.lit("X")).alias("ends"),
    )


def _forms_sql() -> str:
    seeds = "('que es'), ('donde'), ('que que')"
    forms = " UNION ALL ".join(f"SELECT replace(p, '{a}', '{b}') FROM s" for a, b in text.ACCENTED.items())
    return f"WITH s(p) AS (VALUES {seeds}) SELECT DISTINCT pattern FROM (SELECT p AS pattern FROM s UNION ALL {forms})"


@query(_forms_sql())
def accented_forms(spark: SparkSession, folder: str) -> DataFrame:
    return frontier.accented(frontier.seeds(spark, ("que es", "donde", "que que")))


@query("""WITH s AS (SELECT 'p' || o_custkey % 50 AS prefix, CASE WHEN o_orderkey % 3 = 0 THEN 'us' ELSE 'mx' END AS country, 'suggestion ' || o_orderkey % 11 AS suggestion FROM orders),
sets AS (SELECT prefix, country, list_sort(list(DISTINCT suggestion)) AS found FROM s GROUP BY ALL),
d AS (SELECT a.prefix, a.country FROM sets a LEFT JOIN sets b ON b.prefix = a.prefix AND b.country = 'us' WHERE b.found IS NULL OR a.found <> b.found)
SELECT prefix, country, suggestion, count(*) AS n FROM s SEMI JOIN d USING (prefix, country) WHERE length(suggestion) >= 13 GROUP BY ALL""")
def local_suggestions(spark: SparkSession, folder: str) -> DataFrame:
    """Suggestions of prefixes where a country's set isn't that of the control country, of a least length."""
    rows = table(spark, folder, "orders").selectExpr(
        "concat('p', o_custkey % 50) AS prefix", "if(o_orderkey % 3 = 0, 'us', 'mx') AS country", "concat('suggestion ', o_orderkey % 11) AS suggestion"
    )
    return frontier.local_suggestions(rows, "us", 13).groupBy("prefix", "country", "suggestion").agg(F.count("*").alias("n"))


@query("""SELECT doc_id, quality, toxic FROM labels WHERE doc_id % 3 <> 0""")
def valid_ratings(spark: SparkSession, folder: str) -> DataFrame:
    """Rows with a flag that is no 0 or 1 (another number, text, nothing) go."""
    bad = F.when(F.col("doc_id") % 9 == 0, "2").when(F.col("doc_id") % 9 == 3, "yes")
    rows = table(spark, folder, "labels")
    rows = rows.withColumn("quality", F.when(F.col("doc_id") % 3 == 0, bad).otherwise(F.col("quality").cast("string")))
    return agreement.valid_ratings(rows, ("quality", "toxic"))


@query("""SELECT user_id, CAST(i AS INT) AS rank, a[i] AS event_id, s[i] AS score, CAST(len(a) + 1 AS BIGINT) // 2 AS n_chunks FROM
(SELECT user_id, list(event_id ORDER BY event_id) AS a, list(event_id * 2 ORDER BY event_id) AS s, unnest(range(1, count(*) + 1)) AS i FROM events GROUP BY user_id)""")
def parallel_arrays(spark: SparkSession, folder: str) -> DataFrame:
    """Parallel arrays to rows by place, and flat lists in parts of two."""
    pairs = F.array_sort(F.collect_list(F.struct("event_id", (F.col("event_id") * 2).alias("score"))))
    rows = table(spark, folder, "events").groupBy("user_id").agg(pairs.alias("p"))
    parts = F.size(text.chunks(F.col("p.event_id").cast("array<string>"), 2)).cast("long")
    rows = rows.select("user_id", parts.alias("n_chunks"), F.col("p.event_id").alias("event_id"), F.col("p.score").alias("score"))
    return sampling.unpacked(rows, ["user_id", "n_chunks"], ["event_id", "score"])


@query("""SELECT c_custkey, c_mktsegment, CAST(row_number() OVER (ORDER BY CASE c_mktsegment WHEN 'MACHINERY' THEN 0 WHEN 'BUILDING' THEN 1 ELSE 2 END, c_mktsegment, c_acctbal DESC, c_custkey) AS INT) AS place
FROM customer QUALIFY place <= 40""")
def ordered_head(spark: SparkSession, folder: str) -> DataFrame:
    """Some values first, then the alphabet, falling balances within: the first 40 (a top-k report)."""
    order = [*sampling.custom_order(F.col("c_mktsegment"), ["MACHINERY", "BUILDING"]), F.desc("c_acctbal"), F.col("c_custkey")]
    rows = table(spark, folder, "customer").orderBy(*order).limit(40).select("c_custkey", "c_mktsegment", "c_acctbal")
    from pyspark.sql.window import Window as W

    return rows.withColumn("place", F.row_number().over(W.orderBy(*order))).drop("c_acctbal")  # 40 rows


@query("""SELECT n_nationkey, length(n_name) > 0 AS some, CAST(7 AS INT) AS most FROM nation""")
def token_bounds(spark: SparkSession, folder: str) -> DataFrame:
    """A text that is cut at seven tokens has seven; a count with a bound stops there."""
    import public_tokenizers

    from searchloom.functions import tokens

    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = table(spark, folder, "nation").select("n_nationkey", F.concat_ws(" ", *["n_name"] * 9).alias("t"))
    rows = rows.withColumn("cut", tokens.truncated(path, 7)("t")).withColumn("most", tokens.token_length(path, 7)("t"))
    return rows.select("n_nationkey", (F.startswith("t", F.col("cut")) & (tokens.token_length(path)("cut") == 7)).alias("some"), "most")


#: Pages by the heading that they have, as a template of one name, and what is found:
#: type, short answer, answer, address (the name is ``{}``).
_PAGES = (
    ("<h2>Conversor de unidades</h2>", "unit_conv", "", None, None),
    ("<div><h2>Conversor de divisas</h2><select></select><input value='{}'><option selected='1'>Peso</option></div>", "curr_conv", "{} Peso", None, None),
    ("<div><h2>Translation Result</h2><pre id='tw-target-text'>{}</pre></div>", "tr_result", "{}", None, None),
    ("<div><h2>Hora local</h2><div class='vk_bk'> {} </div></div>", "localtime", "{}", None, None),
    ("<div><h2>Conversión de hora local</h2><div class='vk_bk'>{}</div></div>", "time_conv", "{}", None, None),
    ("<div><h2>Overview</h2><a href='/x'>{}</a></div>", "overview", "{}", None, None),
    ("<div><h2>Resultado de fechas</h2><div><div role='heading'><div><div>{}</div><div>b</div></div></div></div></div>", "date", "{}", "{} - b", None),
    ("<h2>Resultados locales</h2>", "local_rst", None, None, None),
    ("<h2>Resultado de pronóstico del clima</h2>", "weather", None, None, None),
    ("<h2>Cómo llegar</h2>", "direction", None, None, None),
    ("<h2>Resultados deportivos</h2>", "sports", None, None, None),
    ("<h2>Resultados de mapa</h2>", "map", None, None, None),
    ("<h2>Resultados de Twitter</h2>", "twitter", None, None, None),
    ("<h2>Resultados web</h2><p>{}</p>", "no_answer", None, None, None),
    ("<p>{}</p>", "no_answer", None, None, None),
    ("<h2>Another heading</h2>", None, None, None, None),
    ("<div><h2>Resultados adicionales</h2><div><a href='/s?p=medical_conditions'>{}</a></div></div>", "other_health", None, None, None),
    ("<div><h2>Resultados adicionales</h2><div><a href='/s'>{}</a></div></div>", "other", None, None, None),
    ("<div><h2>Fragmento destacado de la web</h2><div><b>{}</b><div role='heading'><span>long {}</span></div><a href='/{}'>l</a></div></div>", "feat_snip", "{}", "long {}", "/{}"),
    ("<div><h2>Fragmento destacado de la web</h2><div><b>{}</b><div role='heading'>a</div><div role='heading'>the {}</div><div class='g'><a href='/g{}'>l</a></div></div></div>", "feat_snip", "{}", "the {}", "/g{}"),
    ("<div><h2>Fragmento destacado de la web</h2><div><ol><li>{}</li><li>b</li></ol></div></div>", "rich_list", None, "{}\nb", None),
    ("<div><h2>Fragmento destacado de la web</h2><div><ul><li>{}</li></ul></div></div>", "rich_set", None, "{}", None),
    ("<div><h2>Fragmento destacado de la web</h2><div><b>{}</b></div></div>", "rich_snip", "{}", None, None),
    ("<div class='kp-header'><div class='gsrt'><div>{}</div><div>more {}</div></div></div><div><a href='/k{}'>x</a></div>", "knowledge", "{}", "more {}", "/k{}"),
    ("<div data-attrid='description'><h3>Descripción</h3><span>{}</span><a href='/d{}'>x</a></div>", "descript", None, "{}", "/d{}"),
    ("<div class='answered-question'><b>{}</b></div>", "rich_snip", "{}", None, None),
)


def _pages_sql() -> str:
    def value(s: str | None) -> str:
        if s is None:
            return "NULL"
        return " || n_name || ".join("'" + part.replace("\n", "' || chr(10) || '").replace("'' || ", "").replace(" || ''", "") + "'" for part in s.split("{}"))

    return " UNION ALL ".join(
        f"SELECT n_nationkey, {i} AS rule, {value(kind)} AS answer_type, {value(short)} AS short_answer, {value(long)} AS answer, {value(url)} AS answer_url, false AS expanded_search FROM nation"
        for i, (_, kind, short, long, url) in enumerate(_PAGES)
    )


@query(_pages_sql())
def page_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Every rule of the answer extraction on pages made for it."""
    pages = F.explode(F.array(*[F.struct(F.lit(i).alias("rule"), F.lit(page).alias("page")) for i, (page, *_) in enumerate(_PAGES)]))
    rows = table(spark, folder, "nation").select("n_nationkey", "n_name", pages.alias("p"))
    html = F.replace("p.page", F.lit("{}"), F.col("n_name"))
    rows = rows.select("n_nationkey", "p.rule", html_extract.extract_answer(html).alias("a"))
    return rows.select("n_nationkey", "rule", "a.answer_type", "a.short_answer", "a.answer", "a.answer_url", "a.expanded_search")


@query("""WITH s AS (SELECT 'a' || o_custkey % 20 AS prefix, 'a' || o_custkey % 20 || ' is ' || o_orderkey % 7 || ' now' AS suggestion FROM orders)
SELECT DISTINCT suggestion AS result FROM s WHERE prefix IN ('a1', 'a2')""")
def crawl_round(spark: SparkSession, folder: str) -> DataFrame:
    """A crawl over a table of suggestions, from two prefixes: no seed leads on."""
    rows = table(spark, folder, "orders").selectExpr("concat('a', o_custkey % 20) AS prefix", "concat('a', o_custkey % 20, ' is ', o_orderkey % 7, ' now') AS suggestion")
    start = spark.createDataFrame([("a1",), ("a2",)], "prefix string")
    return frontier.crawl(start, rows, frontier.seeds(spark, ("the",)), [1, 1])


