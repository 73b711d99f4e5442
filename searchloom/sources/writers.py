"""Writers: text formats, shards and snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from searchloom.sources import schemas

SHARD_ROWS = 500_000


def append_tsv(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").csv(path, sep="\t", quote="")


def question_lines(rows: DataFrame, today: Column) -> DataFrame:
    """``question, date, relevance, rank`` as they are appended."""
    return rows.select("question", today.cast("date").alias("date"), "relevance", "relevance_rank")


def urls_by_country(rows: DataFrame, path: str) -> None:
    """``id, url`` in a folder for each country."""
    rows.select("id", "url", "country").write.partitionBy("country").csv(path, sep="\t", quote="")


def jsonl_shards(rows: DataFrame, path: str, shard_rows: int = SHARD_ROWS) -> None:
    """Gzip JSON lines, at most ``shard_rows`` a file."""
    rows.write.option("maxRecordsPerFile", shard_rows).option("compression", "gzip").json(path)


def trec_topics(dataset: DataFrame) -> DataFrame:
    """Distinct queries of each split and country."""
    return dataset.select("split", "country", F.col("id").alias("qid"), "query").distinct()


def trec_qrels(dataset: DataFrame) -> DataFrame:
    return dataset.select(
        "split", "country", F.col("id").alias("qid"), F.lit("Q0").alias("q0"), "docid", F.lit(1).alias("rel")
    ).distinct()


def write_topics_and_qrels(dataset: DataFrame, path: str) -> None:
    """Topics and qrels of every split and country, each in one write."""
    for name, rows in (("topics", trec_topics(dataset)), ("qrels", trec_qrels(dataset))):
        rows.write.partitionBy("split", "country").csv(f"{path}/{name}", sep="\t", quote="")


def trec_run_lines(run: DataFrame, tag: str = "FV") -> DataFrame:
    """Lines of a run: query, Q0, document, rank, score, tag."""
    parts = ["qid", F.lit("Q0"), "docid", F.col("rank").cast("string"), F.col("score").cast("decimal(18,6)").cast("string"), F.lit(tag)]
    return run.select("qid", "rank", F.concat_ws(" ", *parts).alias("line"))


def write_run(run: DataFrame, path: str, tag: str = "FV") -> None:
    lines = trec_run_lines(run, tag).repartition("qid").sortWithinPartitions("qid", "rank")
    lines.select("line").write.text(path)


def prediction_lines(preds: DataFrame) -> DataFrame:
    """Predictions by rank with scores of three decimals."""
    from pyspark.sql.window import Window as W

    rank = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "pid"))
    return preds.select("qid", "pid", rank.alias("rank"), F.round("score", 3).alias("score"))


def readable_samples(samples: DataFrame, corpus: DataFrame, side: str, most: int = 5) -> DataFrame:
    """The first ids of a side of training samples with their texts, in order."""
    ids = F.arrays_zip(F.slice(f"{side}.doc_id", 1, most).alias("doc_id"), F.slice(f"{side}.score", 1, most).alias("score"))
    rows = samples.select("query_id", F.posexplode(ids).alias("place", "x"))
    rows = rows.select("query_id", "place", F.col("x.doc_id").alias("id"), F.col("x.score").alias("score"))
    rows = rows.join(corpus.select("id", "title", "contents"), "id", "left")
    kept = F.struct("place", F.col("id").alias("doc_id"), F.coalesce("title", F.lit("")).alias("title"), "contents", "score")
    return rows.groupBy("query_id").agg(F.array_sort(F.collect_list(kept)).alias(side))


def remaining(requested: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """Rows that are still to be done."""
    return requested.join(done.select(key), key, "left_anti")


def vectors(rows: DataFrame, path: str) -> None:
    """Appends vectors whose ids aren't stored yet; of an id's rows, one."""
    rows = rows.dropDuplicates(["id"])
    spark = rows.sparkSession
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        stored = spark.read.schema(schemas.EMBEDDINGS).parquet(path)
        rows = rows.join(stored.select("id"), "id", "left_anti")
    rows.write.mode("append").parquet(path)


def create_tables(spark: SparkSession) -> list[str]:
    """The warehouse tables that don't exist yet."""
    made = [name for name in schemas.TABLES if not spark.catalog.tableExists(name)]
    for name in made:
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schemas.TABLES[name]}) USING parquet")
    return made


def insert_ignore(target: DataFrame, batch: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``target`` and the rows of ``batch`` whose key isn't there; of a key's rows in the batch, the first by ``order``."""
    others = [c for c in target.columns if c != key]
    first = batch.groupBy(key).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("r")).select(key, "r.*")
    return target.unionByName(first.join(target.select(key), key, "left_anti").select(*target.columns))


def upsert(target: DataFrame, batch: DataFrame, key: str, columns: list[str], order: list[str] | None = None) -> DataFrame:
    """A new snapshot: rows of ``batch`` replace ``columns`` of their key, whose
    other columns stay; where the key is new, the whole row is added (columns
    that the batch lacks are null). order: of a key's rows in the batch the last
    by it counts; without it the batch has each key once."""
    if order:
        others = F.struct(*[c for c in batch.columns if c != key])
        batch = batch.groupBy(key).agg(F.max_by(others, F.struct(*order)).alias("_r")).select(key, "_r.*")
    new = batch.select(F.col(key), *[F.col(c).alias(f"_new_{c}") for c in batch.columns if c != key], F.lit(True).alias("_in"))
    joined = target.withColumn("_was", F.lit(True)).join(new, key, "full")

    def merged(c: str) -> Column:
        if c == key or c not in batch.columns:
            return F.col(c)
        taken = F.col("_in") if c in columns else F.col("_was").isNull()
        return F.when(taken, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c)

    return joined.select(*[merged(c) for c in target.columns])


def update_from(target: DataFrame, batch: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``columns`` of the target's rows that the batch names; no rows are added."""
    new = batch.select(F.col(key), *[F.col(c).alias(f"_new_{c}") for c in columns], F.lit(True).alias("_in"))
    joined = target.join(new, key, "left")
    return joined.select(
        *[F.when(F.col("_in"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in target.columns]
    )
