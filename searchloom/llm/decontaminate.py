"""Benchmark decontamination by a prefix-filtered set join.

Every item gives windows of ``WINDOW`` consecutive words (one, if it is
shorter). A window's shingles of ``SHINGLE`` words are ordered by their rarity
over the whole corpus; exact containment needs all of them, so its prefix is the
single rarest one, and a window of which one is nowhere is left out. Items are
tables throughout: what goes to every task is a bit for each hash of a shingle,
``FILTER_BITS`` at most whatever the benchmark's size. The shingles of documents
that pass it meet the windows in a join on the prefix; the place of the shingle
in the window and the lengths bound the rest (``0 <= start`` and
``start + length <= n_words``), and the words around it, which a candidate
carries, are compared whole, so no hash can mislead. Two scans of the corpus;
only candidates are shuffled.

Edge cases: a null or empty text has no words and no hits; an item without
words gives no window; an item of a null id is skipped; repeated rows (of
either table) each count alike; a document or item table without rows gives no
hits; other columns are ignored or, by :func:`with_hits`, kept.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from searchloom.llm.common import ALNUM_TABLE, numbered, pick, stage, word_blocks

WINDOW, SHINGLE = 10, 3
#: Bits of a filter for each hash in it, and the most bits of a filter (64 MB), as powers of two.
BITS_A_HASH, FILTER_BITS, LEAST_BITS = 64, 29, 16
#: Bits of one row of a filter while it is put together.
_CHUNK = 1 << 16
#: Rows of candidates or windows that a task gives at once.
_ROWS = 1 << 14
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def words_of(data: bytes | None) -> list[bytes]:
    return (data or b"").translate(ALNUM_TABLE).split()


def _codes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.uint64, len(words))


def shingle_hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each place on; the number of words plays a part."""
    size = max(0, len(codes) - n + 1)
    out = np.full(size, n, np.uint64)
    for i in range(n):
        out = (out ^ codes[i : i + size]) * _MULTIPLIER
        out ^= out >> np.uint64(31)
    return out * _MULTIPLIER


_WINDOWS = "item string, w string, k int, hashes array<long>"


def _windows(batches):
    """Windows of items, with the hashes of their shingles."""
    for batch in batches:
        for item, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = words_of(data)
            k = min(WINDOW, len(words))
            if not k:
                continue
            n = min(SHINGLE, k)
            hashes = shingle_hashes(_codes(words), n).view(np.int64)
            for first in range(0, len(words) - k + 1, _ROWS):
                places = range(first, min(first + _ROWS, len(words) - k + 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([item] * len(places), pa.string()),
                        pa.array([b" ".join(words[i : i + k]).decode() for i in places], pa.string()),
                        pa.array([k] * len(places), pa.int32()),
                        pa.array([hashes[i : i + k - n + 1] for i in places], pa.list_(pa.int64())),
                    ],
                    ["item", "w", "k", "hashes"],
                )


class Filter:
    """A bit for each hash, by its highest bits; none that was put in is missed."""

    def __init__(self, bits: int, data: np.ndarray):
        self.shift, self.data = np.uint64(64 - bits), data

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        at = (hashes >> self.shift).astype(np.int64)
        return (self.data[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def _chunks(batches):
    """One row a chunk of bits; all rows of a chunk are in one task."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        chunk, bit = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        for c in np.unique(chunk).tolist():
            held.setdefault(c, np.zeros(_CHUNK, bool))[bit[chunk == c]] = True
    for c, bits in held.items():
        packed = np.packbits(bits, bitorder="little").tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([c], pa.int64()), pa.array([packed], pa.binary())], ["chunk", "bits"])


def build_filter(hashes: DataFrame, most: int = FILTER_BITS) -> Filter:
    """A filter of ``hashes(h)``. The driver gathers its bits, never the hashes."""
    n = hashes.count()
    bits = min(most, max(LEAST_BITS, int(n * BITS_A_HASH).bit_length()))
    place = F.call_function("shiftrightunsigned", F.col("h"), F.lit(64 - bits))
    where = hashes.select(F.floor(place / _CHUNK).alias("chunk"), (place % _CHUNK).cast("int").alias("bit")).distinct()
    data = np.zeros(1 << (bits - 3), np.uint8)
    for row in where.repartition("chunk").mapInArrow(_chunks, "chunk long, bits binary").toLocalIterator():
        at = row["chunk"] * (_CHUNK // 8)
        data[at : at + _CHUNK // 8] = np.frombuffer(row["bits"], np.uint8)[: len(data) - at]
    return Filter(bits, data)


def _text_codes(data: bytes | None):
    """Words and codes of a text."""
    words: list[bytes] = []
    for part in word_blocks((data or b"").translate(ALNUM_TABLE)):
        words += part
    return words, _codes(words)


def _counter(shared, lengths: list[int]):
    """How often each shingle that passes the filter is in the texts of a task."""

    def count(batches):
        passes = shared.value
        counts: dict[int, int] = {}
        found: list[np.ndarray] = []
        size = 0

        def add() -> None:
            for h, n in zip(*(x.tolist() for x in np.unique(np.concatenate(found), return_counts=True)), strict=True):
                counts[h] = counts.get(h, 0) + n

        def rows():
            hashes = np.fromiter(counts.keys(), np.uint64, len(counts)).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(list(counts.values()), pa.int64())], ["h", "n"])

        for batch in batches:
            for data in batch.column(0).cast(pa.binary()).to_pylist():
                codes = _text_codes(data)[1]
                for n in lengths:
                    hashes = shingle_hashes(codes, n)
                    found.append(hashes[passes(hashes)])
                    size += len(found[-1])
                if size > 1 << 18:
                    add()
                    found, size = [], 0
                if len(counts) > 1 << 19:  # partial counts are added up anyway
                    yield rows()
                    counts = {}
        if found:
            add()
        yield rows()

    return count


_FOUND = "n_words long, pos long, h long, first long, around string"


def _candidates(shared, lengths: list[int]):
    """For each text a row of its number of words (with all columns but the text),
    and one for each shingle that passes the filter, with the words around it."""

    def search(batches):
        passes = shared.value
        for batch in batches:
            own = batch.drop_columns(["text"])
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            sizes: list[int] = []
            rows: list[tuple] = []

            def given(rows=rows, own=own) -> pa.RecordBatch:
                at = pa.array([r[0] for r in rows], pa.int64())
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
                columns = [pa.array([r[i + 1] for r in rows], kind) for i, kind in enumerate(kinds)]
                rows.clear()
                return pa.RecordBatch.from_arrays([*own.take(at).columns, *columns], [*own.schema.names, *_NAMES])

            for row, data in enumerate(texts):
                words, codes = _text_codes(data)
                sizes.append(len(words))
                for n in lengths:
                    hashes = shingle_hashes(codes, n)
                    at = np.flatnonzero(passes(hashes))
                    for pos, h in zip(at.tolist(), hashes[at].view(np.int64).tolist(), strict=True):
                        first = max(0, pos - WINDOW + n)
                        rows.append((row, len(words), pos, h, first, b" ".join(words[first : pos + WINDOW]).decode()))
                        if len(rows) >= _ROWS:
                            yield given()
            yield given()
            rows += [(row, n, None, None, None, None) for row, n in enumerate(sizes)]
            yield given()

    return search


_NAMES = [x.split()[0] for x in _FOUND.split(", ")]


def _prefixes(docs: DataFrame, windows: DataFrame, lengths: list[int], bits: int) -> DataFrame:
    """``w, k, h, place`` of every window that may be somewhere: its rarest shingle."""
    spark = docs.sparkSession
    distinct = windows.dropDuplicates(["w"]).select("w", "k", F.posexplode("hashes").alias("place", "h"))
    known = stage(distinct, "shingles")
    passes = spark.sparkContext.broadcast(build_filter(known.select("h").distinct(), bits))
    counts = docs.select("text").mapInArrow(_counter(passes, lengths), "h long, n long")
    counts = counts.groupBy("h").agg(F.sum("n").alias("n"))
    met = known.join(counts, "h", "left")
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "h", "place"))
    prefixes = met.groupBy("w", "k").agg(rarest.alias("p")).where("p.n > 0")
    return stage(prefixes.select("w", "k", F.col("p.h").alias("h"), F.col("p.place").alias("place")), "prefixes")


def _search(docs: DataFrame, benchmark: DataFrame, bits: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of ``docs`` (``rid``, ``text`` and more): ``n_words`` and all but the text of
    every row; ``rid, start, end`` of the windows in it; ``rid, item``, distinct."""
    spark = docs.sparkSession
    items = pick(benchmark, "item_id", "text").toDF("item", "text").where("item is not null and text is not null")
    items = items.select(F.col("item").cast("string").alias("item"), F.col("text").cast("binary").alias("text"))
    windows = stage(items.repartition(F.xxhash64("item", "text")).mapInArrow(_windows, _WINDOWS), "windows")
    lengths = sorted(min(SHINGLE, r["k"]) for r in windows.select(F.least("k", F.lit(SHINGLE)).alias("k")).distinct().collect())
    prefixes = _prefixes(docs, windows, lengths, bits)
    passes = spark.sparkContext.broadcast(build_filter(prefixes.select("h").distinct(), bits))
    own = [c for c in docs.columns if c != "text"]
    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in own]
    found = docs.mapInArrow(_candidates(passes, lengths), ", ".join([*kinds, _FOUND]))
    found = stage(found, "candidates")
    start = (F.col("pos") - F.col("place")).alias("start")
    met = found.where("h is not null").join(prefixes, "h").select("rid", "n_words", "first", "around", "w", "k", start)
    met = met.where("start >= 0 and start + k <= n_words")
    inside = F.array_join(F.slice(F.split("around", " "), (F.col("start") - F.col("first") + 1).cast("int"), F.col("k")), " ")
    met = met.where(inside == F.col("w"))
    met = stage(met.select("rid", "start", (F.col("start") + F.col("k")).alias("end"), "w"), "met-windows")
    of_items = met.select("rid", "w").distinct().join(windows.select("w", "item").distinct(), "w").select("rid", "item").distinct()
    return found.where("h is null").select(*own, "n_words"), met.select("rid", "start", "end").distinct(), of_items


def _merged(spans: DataFrame) -> DataFrame:
    """Spans of a row that overlap or touch, as one."""
    order = W.partitionBy("rid").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    begins = F.coalesce(F.col("start") > before, F.lit(True)).cast("int")
    spans = spans.withColumn("begins", begins).withColumn("n", F.sum("begins").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return spans.groupBy("rid", "n").agg(F.min("start").alias("start"), F.max("end").alias("end"))


HITS = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("starts", T.ArrayType(T.LongType())),
        T.StructField("ends", T.ArrayType(T.LongType())),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


def with_hits(docs: DataFrame, benchmark: DataFrame, name: str = "hits", bits: int = FILTER_BITS) -> DataFrame:
    """``docs`` (with a ``text``) with a struct ``n_words, starts, ends, items``:
    merged spans of hit words (end exclusive) and the ids of items met."""
    # A table, so that a row keeps its number.
    rows = stage(numbered(docs).withColumn("rid", F.monotonically_increasing_id()), "decontaminate")
    words, spans, items = _search(rows.select("rid", F.col(f"_{docs.columns.index('text')}").alias("text")), benchmark, bits)
    place: Column = F.array_sort(F.collect_list(F.struct("start", "end")))
    spans = _merged(spans).groupBy("rid").agg(place.alias("s"))
    items = items.groupBy("rid").agg(F.array_sort(F.collect_set("item")).alias("items"))
    hits = words.join(spans, "rid", "left").join(items, "rid", "left")
    none = F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")
    hits = hits.withColumn("s", F.coalesce("s", none)).withColumn("items", F.coalesce("items", F.expr("cast(array() as array<string>)")))
    hits = hits.select(F.col("rid").alias("_rid"), F.struct("n_words", F.col("s.start").alias("starts"), F.col("s.end").alias("ends"), "items").alias("_hits"))
    return rows.join(hits, F.col("rid") == F.col("_rid")).drop("rid", "_rid").toDF(*docs.columns, name)


def without_hits(docs: DataFrame, benchmark: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """The rows of ``docs`` that hold no window of an item. Equal texts have the
    same hits, so a digest of the text tells the rows apart."""
    rows, at = numbered(docs), F.col(f"_{docs.columns.index('text')}")
    digest = F.md5(F.coalesce(at, F.lit("")).cast("binary"))
    spans = _search(rows.select(digest.alias("rid"), at.alias("text")), benchmark, bits)[1]
    hit = stage(spans.select("rid").distinct(), "hit-texts")
    return rows.join(hit, digest == F.col("rid"), "left_anti").toDF(*docs.columns)


def report(docs: DataFrame, benchmark: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """Counts of hit words and items for each document."""
    rows = pick(docs, "doc_id", "text").withColumn("rid", F.monotonically_increasing_id())
    words, spans, items = _search(rows, benchmark, bits)
    spans = _merged(spans).groupBy("rid").agg(F.sum(F.col("end") - F.col("start")).alias("n_hit"))
    items = items.groupBy("rid").agg(F.array_sort(F.collect_set("item")).alias("items"))
    found = words.join(spans, "rid", "left").join(items, "rid", "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.concat_ws(",", "items"), F.lit("")), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS ws FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS ws FROM benchmark WHERE item_id IS NOT NULL),
windows AS (SELECT DISTINCT item, least({WINDOW}, len(ws)) AS k, unnest(list_transform(range(1, len(ws) - least({WINDOW}, len(ws)) + 2),
    lambda i: array_to_string(ws[i:i + least({WINDOW}, len(ws)) - 1], ' '))) AS w FROM items WHERE len(ws) > 0),
spans AS (SELECT rid, i, k, array_to_string(ws[i:i + k - 1], ' ') AS w
  FROM (SELECT rid, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM docs CROSS JOIN (SELECT DISTINCT k FROM windows) WHERE len(ws) >= k)),
met AS (SELECT rid, i, spans.k, item FROM spans JOIN windows USING (k, w)),
hit AS (SELECT rid, count(*) AS n_hit FROM (SELECT DISTINCT rid, i + unnest(range(k)) AS p FROM met) GROUP BY rid),
of_items AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT rid, item FROM met) GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (rid) LEFT JOIN of_items USING (rid)
"""
