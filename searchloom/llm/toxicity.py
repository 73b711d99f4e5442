"""Toxicity by the nearest labelled examples, in exact TF-IDF cosine.

Terms are words and word beginnings of 4 to 6 bytes: all that ``LEAST_DOCS``
toxic examples hold and that are ``LEAST_RATIO`` times more frequent among toxic
examples than among others. (Over all words the nearest examples say much less;
README has the figures.) IDF is their document frequency over the whole corpus.
The inverted index of the examples is in blocks of ``BLOCK`` examples, each with
the highest weight of each term in it; a text's blocks are scored from the
highest bound down, until no bound reaches the K-th best, so the nearest are
exact. It is built once, from the examples' counts of terms; their texts stay in
tables.

Votes weigh by cosine, and by how many labelled rows an example stands for
(each label has its own bound of about ``MOST_EXAMPLES`` examples, of any length,
by a hash of the id; near copies, which share their least shingle hash, are
one), with ``PRIOR_VOTES`` votes for the share of toxic rows among those that
hold none of the terms. A text without any of the terms (an empty one too)
gets that share. Evidence: the nearest examples with cosine and label.

Edge cases: a null text is an empty one; a null id is not held out and has no
label; labels that repeat or differ for an id count as the highest; null labels
count as none; without toxic or without other examples every score is the share
of toxic examples (0 without examples); examples of the same cosine are taken in
an order of their terms and texts, not of ids; repeated rows are scored alike;
other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from searchloom.llm.common import ALNUM_TABLE, pick, stage, word_blocks

FOLDS = 5
#: Examples of each label, about: it bounds what the driver gathers (counts of terms) and sends.
MOST_EXAMPLES = 3000
#: A term is in this many toxic examples at least, and so many times more often than elsewhere.
LEAST_DOCS, LEAST_RATIO = 5, 3.0
STEMS = (4, 5, 6)
K, BLOCK, PRIOR_VOTES = 15, 64, 2.0

RESULT = T.StructType(
    [
        T.StructField("score", T.DoubleType()),
        T.StructField("doc_ids", T.ArrayType(T.LongType())),
        T.StructField("cosines", T.ArrayType(T.DoubleType())),
        T.StructField("labels", T.ArrayType(T.IntegerType())),
    ]
)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def word_counts(data: bytes | None) -> Counter:
    counts: Counter = Counter()
    for words in word_blocks((data or b"").translate(ALNUM_TABLE)):
        counts.update(words)
    return counts


def terms_of(word: bytes) -> list[bytes]:
    return [word, *(word[:n] + b"*" for n in STEMS if len(word) > n)]


class Terms:
    """Counts of the chosen terms in a text; remembers which words hold any."""

    def __init__(self, terms: list[bytes]):
        self.at = {t: i for i, t in enumerate(terms)}
        self.known: dict[bytes, tuple[int, ...]] = {}

    def counts(self, data: bytes | None) -> dict[int, int]:
        out: dict[int, int] = {}
        known, at = self.known, self.at
        for word, n in word_counts(data).items():
            found = known.get(word)
            if found is None:
                found = tuple(at[t] for t in terms_of(word) if t in at)
                if len(known) > 500_000:
                    known.clear()
                known[word] = found
            for i in found:
                out[i] = out.get(i, 0) + n
        return out


def least_shingle(data: bytes) -> int:
    """The least hash of the 3-word shingles of a text: near copies share it, mostly."""
    least, carry = 1 << 32, []
    for words in word_blocks(data.translate(ALNUM_TABLE)):
        words = carry + words
        carry = words[-2:]
        least = min(least, min((zlib.crc32(b" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2))), default=least))
    return least


def choose_terms(counts, sizes: list[int]) -> list[bytes]:
    """All terms that enough toxic examples hold, and far more often than the
    others, by divergence. counts: term, and examples of label 0 and 1 with it;
    sizes: examples of each label."""
    scored = []
    for term, others, n in counts:
        if n < LEAST_DOCS:
            continue
        p, q = (n + 0.5) / (sizes[1] + 1), (others + 0.5) / (sizes[0] + 1)
        if p >= LEAST_RATIO * q:
            scored.append(((p - q) * math.log(p / q), term))
    return [t for _, t in sorted(scored, reverse=True)]


class BlockMaxIndex:
    """examples: id, counts of terms, label, digest of the text; weights: labelled rows for each example, by label."""

    def __init__(self, terms: list[bytes], idf: np.ndarray, examples: list[tuple[int, dict, int, str]], weights: list[float]):
        self.terms, self.idf = terms, idf
        self.counter = Terms(terms)
        rows = []
        empty = [0.0, 0.0]
        for doc_id, counts, label, digest in examples:
            vector = self.vector(counts)
            if vector is None:
                empty[label] += weights[label]
            else:
                rows.append((doc_id, label, *vector, digest))
        self.base = (empty[1] + sum(weights) * 1e-6) / (sum(empty) + 1) if sum(empty) else 0.0
        # Examples alike in their strongest term share blocks, which tightens the bounds. Ids play no part in the order.
        rows.sort(key=lambda r: (int(r[2][np.argmax(r[3])]), r[4]))
        self.ids = np.array([r[0] for r in rows], np.int64)
        self.labels = np.array([r[1] for r in rows], np.int64)
        self.votes = np.array([weights[r[1]] for r in rows])
        n_blocks = -(-len(rows) // BLOCK)
        self.bounds = np.zeros((len(terms), n_blocks))
        postings: list[dict[int, list[tuple[int, float]]]] = [{} for _ in terms]
        for at, (_, _, where, values, _) in enumerate(rows):
            for t, v in zip(where.tolist(), values.tolist(), strict=True):
                postings[t].setdefault(at // BLOCK, []).append((at, v))
                self.bounds[t, at // BLOCK] = max(self.bounds[t, at // BLOCK], v)
        self.postings = [
            {at: (np.array([p[0] for p in b], np.int64), np.array([p[1] for p in b])) for at, b in blocks.items()}
            for blocks in postings
        ]

    def vector(self, counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray] | None:
        if not counts:
            return None
        where = np.array(sorted(counts), np.int64)
        values = (1 + np.log([counts[i] for i in where.tolist()])) * self.idf[where]
        return where, values / np.sqrt((values * values).sum())

    def nearest(self, where: np.ndarray, values: np.ndarray, k: int = K) -> list[tuple[float, int]]:
        """The k examples of highest cosine, as ``(cosine, example)``; ties by their order."""
        bounds = values @ self.bounds[where]
        best: list[tuple[float, int]] = []  # a heap of (cosine, -example)
        for block in np.argsort(-bounds, kind="stable").tolist():
            if bounds[block] <= 0 or len(best) == k and bounds[block] < best[0][0] - 1e-12:
                break
            scores = np.zeros(BLOCK)
            for t, v in zip(where.tolist(), values.tolist(), strict=True):
                part = self.postings[t].get(block)
                if part is not None:
                    scores[part[0] - block * BLOCK] += v * part[1]
            for j in np.flatnonzero(scores > 0).tolist():
                at = block * BLOCK + j
                entry = (round(float(scores[j]), 12), -at)
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
        return [(c, -at) for c, at in sorted(best, reverse=True)]

    def score(self, data: bytes | None) -> tuple[float, list[int], list[float], list[int]]:
        vector = self.vector(self.counter.counts(data))
        near = self.nearest(*vector) if vector else []
        if not near:
            return float(self.base), [], [], []
        at = [i for _, i in near]
        cosine = np.array([c for c, _ in near])
        votes = cosine * self.votes[at]
        scale = PRIOR_VOTES * self.votes[at].mean()
        score = ((votes * self.labels[at]).sum() + scale * self.base) / (votes.sum() + scale)
        return float(min(1.0, score)), self.ids[at].tolist(), cosine.tolist(), self.labels[at].tolist()


_loaded: dict[str, object] = {}


def _once(key: str, make):
    """A worker's own copy of what a broadcast holds; one at a time."""
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = make()
    return _loaded[key]


def _frequencies(key: str, terms: list[bytes]):
    def count(batches):
        counter = _once(key, lambda: Terms(terms))
        found = np.zeros(len(terms) + 1, np.int64)
        for batch in batches:
            for data in batch.column(0).cast(pa.binary()).to_pylist():
                found[list(counter.counts(data))] += 1
                found[-1] += 1
        yield pa.RecordBatch.from_arrays([pa.array(range(len(found)), pa.int64()), pa.array(found)], ["term", "n"])

    return count


def _shingled(batches):
    for batch in batches:
        least = [least_shingle(data) for data in batch.column("text").cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least, pa.int64())], [*batch.schema.names, "least"])


def _term_labels(batches):
    """In how many of a task's examples of each label a term is."""
    found: tuple[Counter, Counter] = (Counter(), Counter())
    for batch in batches:
        for data, label in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("label").to_pylist(), strict=True):
            found[label].update({t for w in word_counts(data) for t in terms_of(w)})
    terms = [*found[0].keys() | found[1].keys()]
    columns = [pa.array(terms, pa.binary()), *[pa.array([f[t] for t in terms], pa.int64()) for f in found]]
    yield pa.RecordBatch.from_arrays(columns, ["term", "n0", "n1"])


_COUNTED = "doc_id long, label int, digest string, terms array<int>, counts array<int>"


def _counted(terms: list[bytes]):
    """Examples as counts of terms."""

    def count(batches):
        counter = Terms(terms)
        names = [x.split()[0] for x in _COUNTED.split(", ")]
        ints = pa.list_(pa.int32())
        for batch in batches:
            found = [counter.counts(data) for data in batch.column("text").cast(pa.binary()).to_pylist()]
            own = [batch.column(n) for n in ("doc_id", "label", "digest")]
            yield pa.RecordBatch.from_arrays(
                [*own, pa.array([[*f] for f in found], ints), pa.array([[*f.values()] for f in found], ints)], names
            )

    return count


def _scorer(key: str, shared):
    @F.arrow_udf(RESULT)
    def score(texts: pa.Array) -> pa.Array:
        index = _once(key, lambda: shared.value)
        out = [index.score(data) for data in texts.cast(pa.binary()).to_pylist()]
        kinds = [pa.float64(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.int32())]
        return pa.StructArray.from_arrays(
            [pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds)], RESULT.names
        )

    return score.asNondeterministic()


_serial = 0


def score(docs: DataFrame, labels: DataFrame, most: int = MOST_EXAMPLES) -> DataFrame:
    """``doc_id, held_out, score, predicted`` and the evidence of every row."""
    global _serial
    spark = docs.sparkSession
    texts = pick(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    known = pick(labels, "doc_id", "toxic").where("toxic is not null").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("label"))
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    key = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    share = {c: min(1.0, most / n) for c, n in sizes.items() if n}
    limit = F.lit(0)
    for c, s in share.items():
        limit = F.when(F.col("label") == c, int(s * (1 << 30))).otherwise(limit)
    chosen = stage(known.where(key < limit).select("doc_id", "label"), "toxicity-chosen")
    # As many rows as MOST_EXAMPLES allows, of each label.
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.max("label").alias("label"))
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "label")
    rows = rows.mapInArrow(_shingled, "doc_id long, text string, label int, least long")
    rows = rows.groupBy("least", "label").agg(F.min(F.struct("doc_id", "text")).alias("r"))
    examples = stage(rows.select("r.doc_id", "r.text", "label", F.sha2("r.text", 256).alias("digest")), "toxicity-examples")
    counts = {r["label"]: r["n"] for r in examples.groupBy("label").agg(F.count("*").alias("n")).collect()}
    weights = [sizes.get(c, 0) / counts[c] if counts.get(c) else 0.0 for c in (0, 1)]
    _serial += 1
    name = f"{spark.sparkContext.applicationId}-{_serial}"
    terms: list[bytes] = []
    if counts.get(0) and counts.get(1):
        found = examples.mapInArrow(_term_labels, "term binary, n0 long, n1 long").groupBy("term")
        found = found.agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).where(F.col("n1") >= LEAST_DOCS)
        terms = choose_terms(((bytes(r["term"]), r["n0"], r["n1"]) for r in found.collect()), [counts[0], counts[1]])
    idf = np.ones(len(terms))
    if terms:
        found = texts.select("text").mapInArrow(_frequencies(f"terms-{name}", terms), "term long, n long")
        df = {r["term"]: r["n"] for r in found.groupBy("term").agg(F.sum("n").alias("n")).collect()}
        idf = np.array([math.log(1 + df.get(len(terms), 0) / (1 + df.get(i, 0))) for i in range(len(terms))])
    vectors = [
        (r["doc_id"], dict(zip(r["terms"], r["counts"], strict=True)), r["label"], r["digest"])
        for r in examples.mapInArrow(_counted(terms), _COUNTED).collect()
    ]
    shared = spark.sparkContext.broadcast(BlockMaxIndex(terms, idf, vectors, weights))
    out = texts.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), _scorer(f"index-{name}", shared)("text").alias("r"))
    evidence = F.arrays_zip(
        F.col("r.doc_ids").alias("doc_id"), F.col("r.cosines").alias("cosine"), F.col("r.labels").alias("label")
    )
    return out.select(
        "doc_id", "held_out", F.col("r.score").alias("score"), (F.col("r.score") >= 0.5).cast("int").alias("predicted"),
        evidence.alias("evidence"),
    )
