"""Mixing sources to target weights by weighted fair queueing.

Documents of a source stand in the order of the MD5 of their id. A copy's
virtual finish time is the words of its source up to its end, divided by the
source's target; a second round of the source follows the first. All copies
are range-sorted by finish time over all sources, and the queue is cut where
their running words reach the total budget.

Both orders (of a source's documents, of the copies) are range sorts of narrow
rows whose parts get running sums, so a hot source, or an id that many rows
share or lack, is many parts. Texts are read to count words and, for the mixed
documents, moved once to their copies and once to their place in the queue.

Edge cases: a null text has size 0 and is taken at no cost; null sources are
one source, the last; sources without words have target 0 and are not taken; a
null id is ordered as an empty one; rows that share an id are ordered by size
and a hash of the text; rows of the same id, text and source repeat each other,
and of them the mix holds as many copies as the queue takes, wherever they
stand; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from searchloom.llm.common import numbered, pick, running_totals, shuffle_partitions, stage, word_count

#: Weights of the sources in order of their names, repeating.
WEIGHTS = (3, 1, 2)
#: Share of all sizes that the mix holds, in percent, and the most often that a source may be taken.
PERCENT, MOST = 150, 2
#: Copies of a repeated row that one row gives at once.
_RUN = 4096


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def targets(sizes: DataFrame) -> DataFrame:
    """``source, source_size`` (one row a source) with its rank and target:
    by weight of the total, stopping at ``MOST`` times its size, the excess
    reshared. Sources in order of size by weight stop first, so the share of
    each is known from sums over that order."""
    n = len(WEIGHTS)
    # One row a source: these orders are over the sources, not the documents.
    ranked = sizes.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), F.col("rank") % n + 1)
    ranked = ranked.withColumn("weight", weight.cast("long")).withColumn("cap", MOST * F.col("source_size"))
    by_ratio = W.orderBy(F.col("cap") / F.col("weight"), "rank")
    everything = by_ratio.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(0, W.unboundedFollowing)
    total = F.sum("source_size").over(everything) * F.lit(PERCENT / 100)
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(onward)
    ranked = ranked.withColumn("level", level)
    # The first source that doesn't stop sets the level for all after it.
    ranked = ranked.withColumn("ratio", F.col("cap") / F.col("weight"))
    first = F.min_by(F.col("level"), F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("ratio", "rank")))
    ranked = ranked.withColumn("level", first.over(everything))
    target = F.least(F.col("level") * F.col("weight"), F.col("cap").cast("double"))
    return ranked.select("source", "source_size", "rank", F.coalesce(target, F.col("cap").cast("double")).alias("target"))


def _place(i: int) -> Column:
    """Where the copy of round ``i`` stands in the queue."""
    end = F.col("_end") + i * F.col("source_size")
    time = F.try_divide(end.cast("double"), F.col("target"))
    return F.struct(time.alias("t"), F.col("rank").alias("r"), end.cast("long").alias("e"))


def mix(docs: DataFrame) -> DataFrame:
    """``doc_id, size, source_size, target, copies`` and the finish times of the
    copies taken, a row for each of ``docs`` (with ``doc_id, text, source``), and
    ``row``, a hash of these three columns."""
    sized = pick(docs, "doc_id", "text", "source").withColumn("size", word_count(F.col("text")))
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    row = F.xxhash64("doc_id", "source", "text")
    sized = sized.select("doc_id", "source", "size", key.alias("_key"), row.alias("row"))
    sized = stage(sized.withColumn("_at", F.monotonically_increasing_id()), "sizes")
    shares = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    shares = stage(shares.withColumnRenamed("source", "_source"), "targets")
    rows = sized.join(shares, _same("source", "_source")).drop("_source")
    rows = running_totals(rows, ["rank", "_key", "doc_id", "size", "row", "_at"], "size", "_end", by="rank")
    rows = stage(rows.drop("_key", "_at"), "queued")

    budget = math.floor((shares.agg(F.sum("source_size")).first()[0] or 0) * (PERCENT / 100))
    copies = rows.where("size > 0").select("size", F.explode(F.array(*[_place(i) for i in range(MOST)])).alias("place"))
    queue = running_totals(copies, ["place"], "size", "words")
    last = queue.where(F.col("words") <= budget).agg(F.max("place")).first()[0]

    taken = F.lit(0)
    if last is not None:
        end = F.struct(F.lit(last["t"]).alias("t"), F.lit(last["r"]).alias("r"), F.lit(last["e"]).alias("e"))
        for i in range(MOST):
            fits = _place(i)["t"].isNotNull() & (_place(i) <= end)
            taken = taken + F.coalesce(fits, F.lit(False)).cast("int")
    times = F.slice(F.array(*[_place(i)["t"] for i in range(MOST)]), F.lit(1), taken)
    return rows.select("doc_id", "size", "source_size", "target", taken.alias("copies"), times.alias("finish_times"), "row")


def report(docs: DataFrame) -> DataFrame:
    """Words that the mix takes of each document."""
    taken = (F.col("size") * F.col("copies")).cast("long").alias("taken")
    return mix(docs).select("doc_id", "size", "source_size", "target", taken)


def mixture(docs: DataFrame) -> DataFrame:
    """The mixed documents in the order in which the queue serves them: a row of
    ``docs`` for each copy that is taken, range-sorted by finish time, so that
    any stretch has about the target mix."""
    found = mix(docs)
    repeats = found.groupBy("doc_id", "row").agg(
        F.count("*").alias("_n"),
        F.sum("copies").alias("_copies"),
        *[F.min(F.get("finish_times", F.lit(i))).alias(f"_time{i}") for i in range(MOST)],
    )
    repeats = stage(repeats.where("_copies > 0").withColumnsRenamed({"doc_id": "_id", "row": "_row"}), "copies")
    flat = numbered(docs)
    at = {name: F.col(f"_{docs.columns.index(name)}") for name in ("doc_id", "source", "text")}
    rows = flat.withColumn("_hash", F.xxhash64(at["doc_id"], at["source"], at["text"]))
    met = at["doc_id"].eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_row"))
    times = [F.coalesce(F.col(f"_time{i}"), F.col("_time0")) for i in range(MOST)]
    each = F.floor(F.col("_copies") / F.col("_n")).cast("int")  # MOST at most
    mixed = rows.join(repeats, met).withColumn("_time", F.explode(F.slice(F.array(*times), F.lit(1), each)))
    mixed = mixed.select(*flat.columns, "_time")
    # Of rows that repeat, the queue may take some once more: where it ends inside them, at most once a source and round.
    uneven = repeats.where("_copies % _n > 0")
    if not uneven.isEmpty():
        one = rows.join(uneven, met).groupBy("_id", "_row")
        one = one.agg(F.first(F.struct(*flat.columns)).alias("_doc"), F.first(F.col("_copies") % F.col("_n")).alias("_more"), F.first("_time0").alias("_time"))
        runs = F.explode(F.sequence(F.lit(0), F.col("_more") - 1, F.lit(_RUN)))
        one = one.withColumn("_run", runs).repartition(shuffle_partitions(docs.sparkSession))
        one = one.withColumn("_copy", F.explode(F.sequence(F.col("_run"), F.least(F.col("_run") + _RUN, F.col("_more")) - 1)))
        mixed = mixed.unionByName(one.select(*[F.col(f"_doc.{c}").alias(c) for c in flat.columns], "_time"))
    mixed = mixed.withColumn("_tie", F.monotonically_increasing_id())
    ordered = mixed.repartitionByRange(shuffle_partitions(docs.sparkSession), "_time", "_tie")
    return ordered.sortWithinPartitions("_time", "_tie").select(*flat.columns).toDF(*docs.columns)


ORACLE_SQL = f"""
WITH sized AS (SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM sources),
weighed AS (SELECT *, {MOST} * source_size AS cap, [{', '.join(map(str, WEIGHTS))}][1 + rank % {len(WEIGHTS)}] AS weight FROM ranked),
levels AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * {PERCENT / 100}
      - CAST(coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
      / CAST(sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM weighed),
shared AS (SELECT source, source_size, rank, least((SELECT level FROM levels WHERE level * weight <= cap ORDER BY cap / weight, rank LIMIT 1) * weight,
    CAST(cap AS DOUBLE)) AS target FROM levels),
queued AS (SELECT doc_id, size, s.source_size, s.target, s.rank, row_number() OVER () AS rid,
    CAST(sum(size) OVER (PARTITION BY s.rank ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS e
  FROM sized JOIN shared s ON sized.source IS NOT DISTINCT FROM s.source),
copies AS (SELECT rid, size, rank, e + k * source_size AS e, (e + k * source_size) / target AS t FROM queued CROSS JOIN (SELECT unnest(range({MOST})) AS k) WHERE size > 0),
taken AS (SELECT rid, sum(size) AS taken FROM (SELECT *, sum(size) OVER (ORDER BY t, rank, e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS words FROM copies)
  WHERE words <= floor((SELECT sum(size) FROM sized) * {PERCENT / 100}) GROUP BY rid)
SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM queued LEFT JOIN taken USING (rid)
"""
