"""Token counts by a digest cache.

A text's key is the SHA-256 of its content (null as empty; no other
normalisation leaves every count as it is) and the digest of the vocabulary
file. Texts whose key is stored need no encoding; of the others each distinct
one is encoded once, its count is appended to the cache table, and all rows
join the counts on their digest.

Copies of a text are dropped before the shuffle (partial aggregation on the
digest), so a text that makes up a third of all rows is sent once a task.

Edge cases: null and empty texts have 0 bytes and 0 tokens; rows that repeat
or share an id each get a row; a null id stays null; an empty table gives an
empty result and appends nothing; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from searchloom.llm.common import pick, scratch_path, stage

LIMIT = 4096
CACHE = "digest binary, version string, n_tokens long"
_SLICE = 128

_processors: dict = {}


def _counter(path: str):
    if path not in _processors:
        if path.endswith(".model"):
            import sentencepiece

            library = sentencepiece.SentencePieceProcessor(model_file=path)
            _processors[path] = lambda texts: [len(x) for x in library.encode(texts, num_threads=1)]
        else:
            from tokenizers import Tokenizer

            library = Tokenizer.from_file(path)
            _processors[path] = lambda texts: [
                len(x.ids) for x in library.encode_batch(texts, add_special_tokens=False)
            ]
    return _processors[path]


def _encoder(path: str):
    def encode(batches):
        count = _counter(path)
        for batch in batches:
            counts: list[int] = []
            for at in range(0, batch.num_rows, _SLICE):
                counts += count(batch.column(1).slice(at, _SLICE).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    return encode


def version_of(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def count_tokens(docs: DataFrame, vocabulary: str, cache: str | None = None) -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` of each row of ``docs``. cache: the path of
    the table of counts, read and appended to; a new one if none is given."""
    spark = docs.sparkSession
    version = version_of(vocabulary)
    text = F.coalesce(F.col("text"), F.lit(""))
    texts = pick(docs, "doc_id", "text").select("doc_id", text.alias("text"))
    texts = texts.withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    rows = stage(texts.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest"), "digests")
    folder = cache or scratch_path(spark, "token-counts")
    spark.createDataFrame([], CACHE).write.mode("append").parquet(folder)

    def stored() -> DataFrame:
        known = spark.read.schema(CACHE).parquet(folder).where(F.col("version") == version)
        return known.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    if not rows.join(stored(), "digest", "left_anti").isEmpty():
        misses = texts.select("digest", "text").dropDuplicates(["digest"]).join(stored(), "digest", "left_anti")
        counts = misses.select("digest", "text").mapInArrow(_encoder(vocabulary), "digest binary, n_tokens long")
        counts.select("digest", F.lit(version).alias("version"), "n_tokens").write.mode("append").parquet(folder)
    # A table, so that nothing stands between the join and its shuffles and Spark can split a digest of many rows.
    known = stage(stored().join(rows.select("digest").distinct(), "digest", "left_semi"), "counts")
    return rows.join(known, "digest").select("doc_id", "n_bytes", "n_tokens")


def report(docs: DataFrame, vocabulary: str, cache: str | None = None) -> DataFrame:
    return count_tokens(docs, vocabulary, cache).withColumn("over_limit", F.col("n_tokens") > LIMIT)
