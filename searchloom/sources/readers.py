"""Readers: one function a source, each with a declared schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from searchloom.sources import schemas


def _file_part(pattern: str, group: int = 1):
    return F.regexp_extract(F.col("_metadata.file_name"), pattern, group)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def questions(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated question files ``questions_<cc>.txt``; short rows are filled
    with nulls and the country is taken from the name."""
    rows = spark.read.schema(schemas.QUESTIONS).csv(path, sep="\t", mode="PERMISSIVE", quote="")
    return rows.select("*", _file_part(r"questions_(\w+)\.").alias("country"))


def previous_results(spark: SparkSession, path: str) -> DataFrame:
    """First field of each line, once; no files give no rows."""
    lines = spark.read.option("ignoreMissingFiles", True).text(path)
    return lines.select(F.substring_index("value", "\t", 1).alias("question")).distinct()


def _mined(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    found = F.regexp_extract_all("value", F.lit(pattern), F.lit(1))
    return spark.read.text(path).select(F.explode(found).alias("prefix")).distinct()


def past_queries(spark: SparkSession, path: str) -> DataFrame:
    """Prefixes that a log says were searched."""
    return _mined(spark, path, r"prefix='(.+?)': searching")


def past_general_prefixes(spark: SparkSession, path: str) -> DataFrame:
    """Prefixes that a log says give the same everywhere."""
    return _mined(spark, path, r"\*\* '(.+?)': localization_works=False")


def page_batches(spark: SparkSession, path: str) -> DataFrame:
    """JSON arrays ``<cc>_htmls_*.json.gz``; corrupt files are skipped; files
    without a country have an empty one."""
    rows = (
        spark.read.schema("id bigint, date date, html string")
        .option("multiLine", True)
        .option("ignoreCorruptFiles", True)
        .option("mode", "DROPMALFORMED")
        .json(path)
    )
    return rows.select("id", _file_part(r"^(?:(\w+?)_)?htmls_").alias("country"), "html", "date")


def articles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.ARTICLES).json(path)


def passages(spark: SparkSession, path: str) -> DataFrame:
    """Passage shards. A gzip shard is one task, so rows are dealt out after it."""
    rows = spark.read.schema(schemas.PASSAGES).json(path)
    return rows.repartition(spark.sparkContext.defaultParallelism)


def topics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.TOPICS).csv(path, sep="\t", quote="")


def qrels(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(schemas.QRELS).csv(path, sep="\t")
    return rows.select("qid", "docid", "rel")


def run(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.RUN).csv(path, sep=" ")


def csv_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Comma-separated values with a header; quotes are doubled and may hold line breaks."""
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"')


def embeddings(spark: SparkSession, path: str, normalise: bool = False) -> DataFrame:
    from searchloom.functions.vectors import l2_normalised

    rows = spark.read.schema(schemas.EMBEDDINGS).parquet(path)
    return rows.withColumn("embedding", l2_normalised(F.col("embedding"))) if normalise else rows


def nested_qa(spark: SparkSession, path: str) -> DataFrame:
    """One row an answer of a nested question file."""
    return flatten_qa(spark.read.schema(schemas.NESTED_QA).option("multiLine", True).json(path))


def flatten_qa(nested: DataFrame) -> DataFrame:
    """``data[].paragraphs[].qas[].answers[]`` to rows, with trimmed texts."""
    rows = nested.select(F.explode("data").alias("d"))
    rows = rows.select(F.coalesce(F.trim("d.title"), F.lit("")).alias("title"), F.explode("d.paragraphs").alias("p"))
    rows = rows.select("title", F.trim("p.context").alias("context"), F.explode("p.qas").alias("q"))
    rows = rows.select(
        "title", "context", F.col("q.id").alias("id"), F.trim("q.question").alias("question"),
        F.explode_outer("q.answers").alias("a"),
    )
    return rows.select(
        "id", "title", "context", "question", F.trim("a.text").alias("answer"), F.col("a.answer_start").alias("answer_start")
    )


def annotation_sheets(spark: SparkSession, path: str) -> DataFrame:
    """One file an annotator, named after them."""
    rows = spark.read.schema(schemas.ANNOTATION_SHEET).csv(path, header=True)
    return rows.select(_file_part(r"^(.*?)\.").alias("annotator"), "*")


def geoeditors(spark: SparkSession, path: str) -> DataFrame:
    """Monthly files; months that are missing are skipped."""
    rows = spark.read.schema(schemas.GEOEDITORS).option("ignoreMissingFiles", True).csv(path, sep="\t")
    return rows.select("*", _file_part(r"(\d{4}-\d{2})").alias("month"))


def evaluations(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation text: lines that start with recall or ndcg; model and subset from the name."""
    field = F.split("value", r"\s+")
    rows = spark.read.text(path).where(F.col("value").rlike("^(recall|ndcg)"))
    return rows.select(
        _file_part(r"^(.+)_([^_.]+)\.", 1).alias("model"), _file_part(r"^(.+)_([^_.]+)\.", 2).alias("subset"),
        field[0].alias("metric"), field[2].cast("double").alias("value"),
    )


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """Ranked predictions; a missing score is ``round(1 / rank, 4)``."""
    rows = spark.read.schema(schemas.PREDICTIONS).csv(path, sep="\t", mode="PERMISSIVE")
    return rows.withColumn("score", F.coalesce("score", F.round(1 / F.col("rank"), 4)))


def query_answers(spark: SparkSession, path: str) -> DataFrame:
    """Questions with their answers as JSON arrays; of a repeated question, the first by answers stays."""
    from searchloom.functions.python_functions import normalise_quotes

    rows = spark.read.schema(schemas.QA_PAIRS).csv(path, sep="\t", quote="")
    rows = rows.select(normalise_quotes("question").alias("question"), "answers")
    rows = rows.groupBy("question").agg(F.min("answers").alias("answers"))
    return rows.select("question", F.from_json("answers", "array<string>").alias("answers"))


def training_samples(spark: SparkSession, paths: str, most: int | None = None) -> DataFrame:
    """A comma-separated list of files; most: the first rows only."""
    rows = spark.read.schema(schemas.TRAINING_SAMPLE).json(paths.split(","))
    return rows.limit(most) if most else rows


def id_map(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.ID_MAP).parquet(path)


def matching_files(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    """Paths and sizes of a folder's files that fit a pattern."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(folder)
    return rows.select("path", "length")


def jdbc(spark: SparkSession, url: str, table_name: str, low: int, high: int, parts: int) -> DataFrame:
    """A database table, read in ranges of its id."""
    return spark.read.jdbc(url, table_name, column="id", lowerBound=low, upperBound=high, numPartitions=parts)
