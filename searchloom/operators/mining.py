"""Hard negatives and training samples."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from searchloom.functions.text import modular_slice
from searchloom.operators.sampling import order_key


def hard_negatives(run: DataFrame, qrels: DataFrame, n: int) -> DataFrame:
    """``qid, docid, score, place``: retrieved documents that aren't positive, by
    rank, n at most. Only ranks that can matter are kept before the anti join
    (the most positives of a query and n)."""
    positive = qrels.where("rel > 0").select("qid", "docid").distinct()
    most = positive.groupBy("qid").agg(F.count("*").alias("c")).agg(F.coalesce(F.max("c"), F.lit(0)).alias("most"))
    near = run.join(F.broadcast(most)).where(F.col("rank") <= F.col("most") + n).drop("most")
    rows = near.join(qrels.select("qid").distinct(), "qid", "left_semi")
    rows = rows.join(positive, ["qid", "docid"], "left_anti")
    place = F.row_number().over(W.partitionBy("qid").orderBy("rank", "docid"))
    rows = rows.select("qid", "docid", F.round(1 / F.col("rank"), 6).alias("score"), place.alias("place"))
    return rows.where(F.col("place") <= n)


def random_fill(short: DataFrame, n_docs: int, taken: str, n: int, seed: int = 33) -> DataFrame:
    """``filled``: n ids below ``n_docs`` for each query, none of them in the array
    ``taken`` (all others, where there are fewer). Ids are gone through from a
    hashed start in hashed steps that meet every id once, so as many as are
    taken and n more hold enough."""
    start = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("qid").cast("string")).cast("binary")), 1, 7), 16, 10).cast("long")
    step = next(s for s in range(max(1, n_docs * 5 // 8), 2 * n_docs + 2) if math.gcd(s, n_docs) == 1)
    draws = F.transform(
        F.sequence(F.lit(0), F.least(F.size(taken) + n, F.lit(n_docs)) - 1),
        lambda i: F.pmod(start + i.cast("long") * step, F.lit(n_docs).cast("long")),
    )
    return short.withColumn("filled", F.slice(F.array_except(draws, F.col(taken)), 1, n))


def training_samples(queries: DataFrame, run: DataFrame, qrels: DataFrame, n: int, n_docs: int, seed: int = 33) -> DataFrame:
    """``query_id, query, positives, negatives``: documents and scores of each
    judged query, negatives filled up at random and in hashed order."""
    positive = qrels.where("rel > 0").groupBy("qid").agg(F.array_sort(F.collect_set("docid")).alias("pos"))
    mined = hard_negatives(run, qrels, n).groupBy("qid").agg(
        F.array_sort(F.collect_list(F.struct("place", "docid", "score"))).alias("mined")
    )
    rows = positive.join(mined, "qid", "left").join(queries, "qid")
    rows = rows.withColumn("mined", F.coalesce("mined", F.expr("cast(array() as array<struct<place:int,docid:bigint,score:double>>)")))
    rows = rows.withColumn("taken", F.concat("pos", "mined.docid"))
    rows = random_fill(rows, n_docs, "taken", n, seed)
    extra = F.transform("filled", lambda d: F.struct(F.lit(0).alias("place"), d.alias("docid"), F.lit(-1.0).alias("score")))
    chosen = F.slice(F.concat("mined", extra), 1, n)
    keyed = F.transform(chosen, lambda x: F.struct(order_key(F.concat_ws(":", "qid", x["docid"]), seed).alias("h"), x["docid"].alias("docid"), x["score"].alias("score")))
    rows = rows.withColumn("neg", F.array_sort(keyed))
    scores = F.transform("pos", lambda _: F.lit(-1.0))
    return rows.select(
        F.col("qid").alias("query_id"), "query",
        F.struct(F.col("pos").alias("doc_id"), scores.alias("score")).alias("positives"),
        F.struct(F.col("neg.docid").alias("doc_id"), F.col("neg.score").alias("score")).alias("negatives"),
    )


def grouped_ids(positives: Column, negatives: Column, epoch: Column, n: int) -> Column:
    """One positive and n negatives, moving on with the epoch, around the end."""
    return F.concat(modular_slice(positives, epoch, 1), modular_slice(negatives, epoch * n, n))


def strong_positives(ids: Column, scores: Column, negative_scores: Column) -> Column:
    """The first positive, those that score as high, and those above every negative."""
    rows = F.arrays_zip(ids.alias("d"), scores.alias("s"))
    best = F.element_at(scores, 1)
    kept = F.filter(rows, lambda x, i: (i == 0) | (x["s"] >= best) | (x["s"] > F.array_max(negative_scores)))
    return F.transform(kept, lambda x: x["d"])


def rerank_merge(reranked: DataFrame, original: DataFrame, depth: int) -> DataFrame:
    """Reranked documents by their score, then the original ones beyond ``depth``
    by rank, with scores below the last."""
    last = reranked.groupBy("qid").agg(F.min("score").alias("last"))
    tail = original.where(F.col("rank") > depth).join(last, "qid")
    tail = tail.select("qid", "docid", (F.col("last") - (F.col("rank") - depth)).alias("score"))
    rows = reranked.select("qid", "docid", "score").unionByName(tail)
    order = W.partitionBy("qid").orderBy(F.desc("score"), "docid")
    return rows.withColumn("rank", F.row_number().over(order))


def remapped(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """``column`` by a table of old and new ids; null where it isn't there."""
    names = [F.col("new_id").alias(column) if c == column else F.col(c) for c in rows.columns]
    return rows.join(ids, rows[column] == ids["old_id"], "left").select(*names)
