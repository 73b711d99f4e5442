import random

import numpy as np
import pytest
import xxhash

from searchloom.llm import simhash
from searchloom.llm.components import connected_components
from tests.llm.samples import clashing, frame, plain, rows


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(data):
    prints = [brute_fingerprint(r[1]) for r in data]
    root = list(range(len(data)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(data)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(data):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return [(r[0], prints[i], least.get(find(i))) for i, r in enumerate(data)]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_components_are_brute_force(spark):
    got = plain(simhash.near_duplicates(frame(spark)).select("doc_id", "fp", "component_id"))
    want = sorted(((i, signed(f), c) for i, f, c in brute_components(rows())), key=repr)
    assert got == want


def test_query_is_brute_force(spark, folder):
    from searchloom.llm.queries import op1_simhash

    data = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    want = sorted(((i, f"{f:016x}", c) for i, f, c in brute_components(data)), key=repr)
    assert plain(op1_simhash(spark, folder)) == want


def test_long_text_in_blocks():
    text = " ".join(f"w{i % 977}" for i in range(400_000))
    words = text.encode().split()
    hashes = np.array([xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(len(words) - 2)], np.uint64)
    bits = [int(2 * ((hashes >> np.uint64(b)) & np.uint64(1)).sum() > len(hashes)) for b in range(64)]
    assert simhash.fingerprint(text.encode()) == sum(x << b for b, x in enumerate(bits))
    assert simhash.fingerprint(text.encode()) == simhash.fingerprint(text.upper().encode())


def linked(values, pairs):
    root = {v: v for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[find(a)] = find(b)
    groups = {}
    for v in values:
        groups.setdefault(find(v), set()).add(v)
    return sorted(map(sorted, groups.values()))


@pytest.mark.parametrize("paired", [1, 1024])
def test_links_lose_nothing(spark, monkeypatch, paired):
    """Random fingerprints with many neighbours; every bucket whole, or every one split."""
    monkeypatch.setattr(simhash, "PAIRED_BUCKET", paired)
    rng = random.Random(paired)
    values = set()
    for _ in range(40):
        base = rng.getrandbits(64)
        values.add(base)
        for _ in range(12):
            other = base
            for b in rng.sample(range(64), rng.choice([1, 2, 2, 3])):
                other ^= 1 << b
            values.add(other)
            base = rng.choice([base, other])
    values = [signed(v) for v in values]
    links = simhash.fingerprint_links(spark.createDataFrame([(v,) for v in values], "fp long")).collect()
    assert all(((a - b) and (a ^ b) & ((1 << 64) - 1)).bit_count() <= 2 for a, b in links)
    want = [(a, b) for i, a in enumerate(values) for b in values[:i] if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2]
    assert linked(values, [tuple(r) for r in links]) == linked(values, want)


def test_long_chains(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)]
    got = {r["u"]: r["v"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {101: 100}


def test_keep_one(spark):
    data = rows() + [(3, "an entirely different text that shares an id", "en", "s", 1)]
    kept = [(r["doc_id"], r["text"]) for r in simhash.keep_one(frame(spark, data)).collect()]
    components = {}
    for row, (i, f, c) in zip(data, brute_components(data), strict=True):
        components.setdefault((c, f if c is None or row[0] == 3 else None), []).append(row)
    assert len(kept) == len(set(kept))
    prints = [brute_fingerprint(t) for _, t in kept]
    assert all((a ^ b).bit_count() > 2 for i, a in enumerate(prints) for b in prints[:i])
    for _, text, *_ in data:
        assert any((brute_fingerprint(text) ^ p).bit_count() <= 2 for p in prints) or text is not None


def test_edges(spark):
    assert simhash.near_duplicates(frame(spark, [])).count() == 0
    assert simhash.keep_one(frame(spark, [])).count() == 0
    got = plain(simhash.near_duplicates(clashing(spark)).select("doc_id", "fp", "component_id"))
    assert got == plain(simhash.near_duplicates(frame(spark)).select("doc_id", "fp", "component_id"))
    empty = simhash.near_duplicates(frame(spark, [(1, None, "", "", 0), (2, "", "", "", 0)])).select("fp", "component_id")
    assert plain(empty) == [(0, 1), (0, 1)]
