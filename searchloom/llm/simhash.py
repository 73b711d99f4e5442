"""SimHash near-duplicate classes with pigeonring candidate filtering.

Ring of ``SEGMENTS`` segments over the 64 bits, Hamming budget ``BUDGET``. For
two fingerprints within the budget some chain of consecutive segments exists
whose first ``l`` segments differ in at most ``l * BUDGET / SEGMENTS`` bits for
every ``l``. With five segments and two bits, both first segments of that chain
are equal, the third brings the sum to one at most, the fourth too, and the
fifth to two: fingerprints meet on two whole segments (25 or 26 bits) and
further sums prune them before the Hamming check. Where many meet, they meet on
the third segment too, or one bit beside it (38 or 39 bits).

Edge cases: a null text counts as an empty one (fingerprint 0); rows that
repeat, or share an id, each get a row; a null id never becomes a component's
id (a component of null ids only has a null one); an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from searchloom.llm.common import pick, stage, word_blocks
from searchloom.llm.components import connected_components

SHINGLE, SEED, BUDGET = 3, 42, 2
#: Segment widths around the ring, from the lowest bit.
WIDTHS = (13, 13, 13, 13, 12)
OFFSETS = (0, 13, 26, 39, 52)
SEGMENTS = len(WIDTHS)
#: Buckets of more fingerprints are split by the third segment of their chain.
PAIRED_BUCKET = 1024
_FULL = (1 << 64) - 1


def fingerprint(data: bytes | None) -> int:
    """Majority of each bit over the XXH64 of the 3-word shingles, repeats
    included; the whole sequence where it is shorter; 0 without words."""
    digest, counts, total, carry = xxhash.xxh64_intdigest, np.zeros(64, np.int64), 0, []
    for words in word_blocks((data or b"").lower()):
        words = carry + words
        carry = words[-(SHINGLE - 1) :]
        if len(words) < SHINGLE:
            continue
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        hashes = np.fromiter(
            [
                digest(joined[a:b], SEED)
                for a, b in zip(starts[: 1 - SHINGLE].tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)
            ],
            np.uint64,
        )
        counts += np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
        total += len(hashes)
    if not total:
        return digest(b" ".join(carry), SEED) if carry else 0
    return int(np.packbits(2 * counts > total, bitorder="little").view(np.uint64)[0])


@F.arrow_udf(T.LongType())
def fingerprint_udf(texts: pa.Array) -> pa.Array:
    values = np.fromiter((fingerprint(t) for t in texts.cast(pa.binary()).to_pylist()), np.uint64, len(texts))
    return pa.array(values.view(np.int64))


def _segment(i: int) -> Column:
    i %= SEGMENTS
    return F.shiftrightunsigned("fp", OFFSETS[i]).bitwiseAND(F.lit((1 << WIDTHS[i]) - 1))


def chain_keys() -> Column:
    """For each start of a chain, the bits that must be equal."""
    return F.array(
        *[
            (_segment(i) * (1 << 13) + _segment(i + 1)) * SEGMENTS + F.lit(i)
            for i in range(SEGMENTS)
        ]
    )


def _third_keys(start: Column) -> Column:
    """The third segment of a chain and all values that differ from it in one
    bit, which is what its budget allows: two fingerprints of a chain share the
    third segment of either."""
    third = F.coalesce(*[F.when(start == i, _segment(i + 2)) for i in range(SEGMENTS)])
    width = F.element_at(F.array(*[F.lit(WIDTHS[(i + 2) % SEGMENTS]) for i in range(SEGMENTS)]), (start + 1).cast("int"))
    flips = F.transform(F.sequence(F.lit(0), width - 1), lambda b: third.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), b)))
    return F.concat(F.array(third), flips)


def _chain_masks(start: int) -> list[np.uint64]:
    """Masks of the third segment, third and fourth, and all, of a chain."""
    mask = [((1 << WIDTHS[i]) - 1) << OFFSETS[i] for i in range(SEGMENTS)]
    third, fourth = mask[(start + 2) % SEGMENTS], mask[(start + 3) % SEGMENTS]
    return [np.uint64(third), np.uint64(third | fourth), np.uint64(_FULL)]


_MASKS = [_chain_masks(i) for i in range(SEGMENTS)]
#: Differing bits allowed within each mask: floor(l * BUDGET / SEGMENTS) for l = 3, 4, 5.
_ALLOWED = [length * BUDGET // SEGMENTS for length in (3, 4, 5)]


def bucket_links(start: int, fps: np.ndarray) -> list[tuple[int, int]]:
    """Spanning links of the fingerprints of one bucket: pairs that pass the
    chain's budgets are compared whole, and joined in a local forest."""
    parent = list(range(len(fps)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = []
    values = fps.view(np.uint64)
    for i in range(len(values) - 1):
        rest = np.arange(i + 1, len(values))
        for mask, allowed in zip(_MASKS[start], _ALLOWED, strict=True):
            rest = rest[np.bitwise_count((values[rest] ^ values[i]) & mask) <= allowed]
            if not len(rest):
                break
        for j in rest.tolist():
            a, b = root(i), root(j)
            if a != b:
                parent[b] = a
                links.append((int(fps[i]), int(fps[j])))
    return links


def _paired(batches):
    for batch in batches:
        u, v = [], []
        for key, members in zip(batch.column("k").to_pylist(), batch.column("fps"), strict=True):
            for a, b in bucket_links(key % SEGMENTS, np.asarray(members.values)):
                u.append(a)
                v.append(b)
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def fingerprint_links(fps: DataFrame) -> DataFrame:
    """``fps(fp)``, distinct, to links ``(u, v)`` that connect all that are
    within the budget of each other."""
    keys = fps.select("fp", F.explode(chain_keys()).alias("k"))
    sizes = keys.groupBy("k").agg(F.count("*").alias("n")).where("n > 1")
    met = keys.join(sizes, "k")
    paired = (
        met.where(F.col("n") <= PAIRED_BUCKET)
        .groupBy("k")
        .agg(F.collect_list("fp").alias("fps"))
        .mapInArrow(_paired, "u long, v long")
    )
    return paired.union(
        met.where(F.col("n") > PAIRED_BUCKET)
        .select("fp", "k", F.explode(_third_keys(F.col("k") % SEGMENTS)).alias("third"))
        .groupBy("k", "third")
        .agg(F.collect_list("fp").alias("fps"))
        .where(F.size("fps") > 1)
        .select("k", "fps")
        .mapInArrow(_paired, "u long, v long")
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp, component_id`` for each row of ``docs``."""
    rows = pick(docs, id_col, text_col).toDF("doc_id", "text")
    rows = stage(rows.select("doc_id", fingerprint_udf("text").alias("fp")), "fingerprints")
    classes = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "classes")
    roots = connected_components(fingerprint_links(classes.select("fp"))).toDF("fp", "root")
    rooted = classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(ids, "root").select("fp", "component_id", "root")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id", "root")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` (with ``doc_id`` and ``text``) with one row of each component:
    that of the smallest id. Where rows share an id or have none, the one of
    the smallest fingerprint, and one of its repeats."""
    named = near_duplicates(docs)
    own = named["doc_id"].eqNullSafe(named["component_id"])
    named = stage(named.withColumn("own", own), "components")
    ids = named.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("own").alias("own")).where("own")
    plain = docs.join(ids.where("n = 1 and doc_id is not null").select("doc_id"), "doc_id", "left_semi")
    shared = ids.where("n > 1 or doc_id is null").select("doc_id")
    if shared.isEmpty():
        return plain
    shared = stage(shared, "shared-ids")
    chosen = (
        named.where("own")
        .groupBy("root", "doc_id")
        .agg(F.min("fp").alias("_fp"))
        .join(shared.withColumnRenamed("doc_id", "_id"), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
        .select(F.col("doc_id").alias("_id"), F.col("_fp").alias("_chosen"))
    )
    rows = docs.join(shared.withColumnRenamed("doc_id", "_id"), docs["doc_id"].eqNullSafe(F.col("_id")), "left_semi")
    rows = rows.withColumn("_fp", fingerprint_udf("text"))
    rows = rows.join(chosen, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_fp") == F.col("_chosen")), "left_semi")
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    one = F.min(F.struct("text", *others)).alias("_row")  # of rows that share id and fingerprint, that of the least text
    rows = rows.groupBy("doc_id", "_fp").agg(one).select("doc_id", "_row.*")
    return plain.unionByName(rows.select(*docs.columns))
