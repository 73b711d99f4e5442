import math
import random
import zlib
from collections import Counter

import numpy as np

from searchloom.llm import toxicity
from tests.llm.samples import SCHEMA, clashing, frame, plain

BAD = ["vilea", "vileb", "rotten", "filthyx"]


def corpus(n=400, seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(rng.randint(1, 4)):
                text.insert(rng.randrange(len(text)), rng.choice(BAD) + rng.choice(["", "s", "er"]))
        docs.append((i, " ".join(text), "en", "s", 1))
        if i % 3:
            labels.append((i, 1, int(toxic)))
    return docs, labels


def index():
    docs, labels = corpus()
    known = dict((d, t) for d, _, t in labels)
    examples = [(d[0], d[1].encode(), known[d[0]]) for d in docs if d[0] in known]
    return built_of(examples, [2.0, 1.0]), examples, docs


def built_of(examples, weights, idf=lambda i: 1 + (i % 5) / 3):
    sizes = [sum(label == c for *_, label in examples) for c in (0, 1)]
    found = {}
    for _, data, label in examples:
        for t in {t for w in toxicity.word_counts(data) for t in toxicity.terms_of(w)}:
            found.setdefault(t, [0, 0])[label] += 1
    terms = toxicity.choose_terms(((t, *n) for t, n in found.items()), sizes)
    counter = toxicity.Terms(terms)
    counted = [(i, counter.counts(data), label, data.decode()) for i, data, label in examples]
    return toxicity.BlockMaxIndex(terms, np.array([idf(i) for i in range(len(terms))]), counted, weights)


def test_nearest_are_brute_force(monkeypatch):
    monkeypatch.setattr(toxicity, "BLOCK", 8)
    built, examples, docs = index()
    vectors = {d: built.vector(built.counter.counts(t)) for d, t, _ in examples}
    dense = {d: np.bincount(v[0], v[1], len(built.terms)) for d, v in vectors.items() if v}
    tried = 0
    for _, text, *_ in docs:
        query = built.vector(built.counter.counts(text.encode()))
        if query is None:
            continue
        own = np.bincount(query[0], query[1], len(built.terms))
        want = sorted(((-round(float(own @ v), 12), d) for d, v in dense.items() if own @ v > 0))[: toxicity.K]
        got = [(-c, int(built.ids[i])) for c, i in built.nearest(*query)]
        assert [round(c, 9) for c, _ in got] == [round(c, 9) for c, _ in want]
        tried += 1
    assert tried > 50


def test_terms_and_scores():
    built, _, docs = index()
    assert {b"vilea", b"vile*", b"rotten"} <= set(built.terms) or {b"vile*", b"rott*"} <= set(built.terms)
    assert built.score(b"")[0] == built.score(None)[0] < 0.1
    assert built.score(b"abc rotten vileb filthyx")[0] > 0.5


def test_no_term_is_cut():
    """600 words that 5 of 1000 toxic examples hold, under 1 % of them."""
    words = [f"{i:03d}w" for i in range(600)]
    examples = [(i, " ".join([f"t{i}", *(words[j] for j in range(600) if (i - j) % 200 == 0)]).encode(), 1) for i in range(1000)]
    examples += [(1000 + i, f"plain text {i}".encode(), 0) for i in range(1000)]
    built = built_of(examples, [1.0, 1.0], lambda i: 1.0)
    assert {w.encode() for w in words} <= set(built.terms)
    assert all(built.score(w.encode())[0] > 0.5 and len(built.score(w.encode())[1]) == 5 for w in words)


def test_held_out_accuracy(spark):
    docs, labels = corpus(800, 3)
    got = {r["doc_id"]: r for r in toxicity.score(frame(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert len(got) == 800
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    out = [(got[i]["predicted"], int(i % 4 == 0)) for i in got if got[i]["held_out"]]
    assert sum(a == b for a, b in out) / len(out) > 0.95
    evidence = next(r["evidence"] for r in got.values() if r["predicted"])
    assert evidence and all(zlib.crc32(str(e["doc_id"]).encode()) % 5 for e in evidence)


def test_near_copies_count_once():
    least = [toxicity.least_shingle(t) for t in (b"a b c d e f g h", b"A b c, d e f g h", b"other words in a text", b"", b"one")]
    assert least[0] == least[1] and len(set(least)) == 4


def brute_scores(docs, labels):
    """Scores by definition: all cosines over all pairs, in plain Python."""
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    marked = {}
    for i, _, t in labels:
        if t is not None and i is not None and not held(i):
            marked[i] = max(marked.get(i, 0), t)
    by_text = {}
    for i, text, *_ in docs:
        if i in marked:
            a, b = by_text.get(text or "", (i, 0))
            by_text[text or ""] = (min(a, i), max(b, marked[i]))
    groups = {}
    for text, (i, label) in by_text.items():
        key = (toxicity.least_shingle(text.encode()), label)
        groups[key] = min(groups.get(key, (i, text)), (i, text))
    examples = [(i, text.encode(), label) for (_, label), (i, text) in groups.items()]
    n = [sum(x == c for *_, x in examples) for c in (0, 1)]
    rows = [sum(x == c for x in marked.values()) for c in (0, 1)]
    weight = [rows[c] / n[c] for c in (0, 1)]
    terms_in = lambda data: Counter(t for w, k in toxicity.word_counts(data).items() for t in toxicity.terms_of(w) for _ in range(k))
    found = [terms_in(data) for _, data, _ in examples]
    both = {t: [sum(t in f for f, e in zip(found, examples, strict=True) if e[2] == c) for c in (0, 1)] for t in set().union(*found)}
    chosen = set(toxicity.choose_terms(((t, *k) for t, k in both.items()), n))
    of_docs = [terms_in((text or "").encode()) for _, text, *_ in docs]
    idf = {t: math.log(1 + len(docs) / (1 + sum(t in f for f in of_docs))) for t in chosen}

    def vector(f):
        v = {t: (1 + math.log(k)) * idf[t] for t, k in f.items() if t in chosen}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()}

    vectors = [vector(f) for f in found]
    empty = [sum(weight[c] for v, e in zip(vectors, examples, strict=True) if e[2] == c and not v) for c in (0, 1)]
    base = (empty[1] + sum(weight) * 1e-6) / (sum(empty) + 1) if sum(empty) else 0.0
    out = []
    for f in of_docs:
        own = vector(f)
        cosines = [(round(sum(x * v.get(t, 0) for t, x in own.items()), 9), e[2]) for v, e in zip(vectors, examples, strict=True)]
        out.append((base, sorted((c for c in cosines if c[0] > 0), reverse=True), weight))
    return out


def test_scores_are_brute_force(spark):
    """Score, nearest and ties. Where the last of the nearest tie with others of another label, either may be in."""
    docs, labels = corpus(300, 5)
    docs += [(1000, docs[4][1], "en", "s", 1), (1001, "", "en", "s", 1), (1002, None, "en", "s", 1), (1003, docs[4][1] + " " + "word " * 20000, "en", "s", 1)]
    labels += [(1003, 1, 1), (1002, 0, 0), (1000, 0, 1)]
    got = toxicity.score(frame(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    rows = {r["doc_id"]: r for r in got.collect()}
    checked = 0
    for (i, *_), (base, near, weight) in zip(docs, brute_scores(docs, labels), strict=True):
        k = toxicity.K
        best, evidence = near[:k], rows[i]["evidence"]
        assert len(evidence) == len(best) and all(abs(e["cosine"] - c) < 1e-7 for e, (c, _) in zip(evidence, best, strict=True))
        if not near:
            assert abs(rows[i]["score"] - base) < 1e-9
        elif len(near) <= k or near[k - 1][0] > near[k][0]:
            votes = [(c * weight[x], x) for c, x in best]
            scale = toxicity.PRIOR_VOTES * sum(weight[x] for _, x in best) / len(best)
            want = (sum(v * x for v, x in votes) + scale * base) / (sum(v for v, _ in votes) + scale)
            assert abs(rows[i]["score"] - want) < 1e-6
            checked += 1
    assert checked > 60


def test_registered_query(spark, folder):
    from searchloom.llm.queries import op5_toxicity

    got = op5_toxicity(spark, folder).collect()
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    out = [(r["score"], truth[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in truth]
    toxic, other = [s for s, t in out if t], [s for s, t in out if not t]
    if toxic and other:
        better = sum((a > b) + 0.5 * (a == b) for a in toxic for b in other)
        assert better / (len(toxic) * len(other)) >= 0.5


def test_edges(spark):
    labels = spark.createDataFrame([(1, 1, None), (None, 1, 1), (2, 0, 0), (2, 0, 1), (3, 0, 0)], "doc_id long, quality int, toxic int")
    scored = toxicity.score(frame(spark), labels).collect()
    assert len(scored) == frame(spark).count() and all(0 <= r["score"] <= 1 for r in scored)
    assert all(r["held_out"] is False for r in scored if r["doc_id"] is None)
    none = spark.createDataFrame([], labels.schema)
    assert {r["score"] for r in toxicity.score(frame(spark), none).collect()} == {0.0}
    assert toxicity.score(frame(spark, []), labels).count() == 0
    assert plain(toxicity.score(clashing(spark), labels).select("doc_id", "predicted")) == plain(toxicity.score(frame(spark), labels).select("doc_id", "predicted"))
    assert SCHEMA and math.isfinite(scored[0]["score"])
