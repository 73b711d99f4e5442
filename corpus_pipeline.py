"""Corpus pipeline: quality rules, near-duplicates, decontamination, mixing, token files.

Each stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet
and read again as the documents of the next. All but the last return the
columns of ``documents``.

Edge cases: null and empty texts fail the quality rules; rows that share an id
or lack one are each judged by their text, and of a group of near duplicates
the row of the smallest id stays (nulls last); repeated rows are one group; an
empty table gives an empty result; extra columns are dropped, whatever their
names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from searchloom.llm import decontaminate, mixing, quality, simhash, token_files
from searchloom.llm.common import pick, stage
from searchloom.llm.queries import BYTE_BPE

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = quality.with_quality(pick(docs, *COLUMNS), name="_quality")
    return judged.where("_quality.kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(pick(docs, *COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.without_hits(pick(docs, *COLUMNS), benchmark)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixture(pick(docs, *COLUMNS))


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_files.report(docs, BYTE_BPE)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mix_sources),
    ("token output", token_output),
]

#: Fingerprints (XXH64) and BPE ids can't be expressed in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, function) in enumerate(STAGES):
        docs = function(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stage(docs, f"pipeline-{i}")
    return docs
