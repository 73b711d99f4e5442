import hashlib
import random
import re

import pytest

from searchloom.llm import decontaminate
from tests.comparing import assert_same
from tests.llm.samples import clashing, frame, plain, rows

ITEMS = "item_id long, text string"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    out = []
    for doc_id, text, *_ in docs:
        ws, hit, met = words(text), set(), set()
        for item, item_text in items:
            iw = words(item_text)
            k = min(10, len(iw))
            for i in range(len(iw) - k + 1 if iw and item is not None else 0):
                for j in range(len(ws) - k + 1):
                    if ws[j : j + k] == iw[i : i + k]:
                        hit.update(range(j, j + k))
                        met.add(str(item))
        names = ",".join(sorted(met)).encode()
        out.append((doc_id, len(ws), len(hit), len(met), hashlib.sha256(names).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def planted():
    rng = random.Random(4)
    docs = rows()
    items = [(i, " ".join(rng.choice("ab cd ef gh ij kl".split()) + str(rng.randint(0, 5)) for _ in range(n))) for i, n in enumerate([25, 12, 10, 9, 3, 2, 1, 0])]
    items += [(20, items[0][1]), (21, None), (None, "one two"), (22, "ONE, two!"), (10, items[1][1])]
    for i, (_, text) in enumerate(items):
        docs.append((500 + i, f"before {text} after, and {text}", "en", "s", 1))
        docs.append((600 + i, " ".join((text or "").split()[2:14]), "en", "s", 1))
    docs.append((700, " ".join(items[0][1].split()[:9]), "en", "s", 1))
    return docs, items


@pytest.mark.parametrize("bits", [decontaminate.FILTER_BITS, 3])
def test_hits_are_brute_force(spark, bits):
    """Also with a filter of 8 bits, which lets nearly everything pass."""
    docs, items = planted()
    got = decontaminate.report(frame(spark, docs), spark.createDataFrame(items, ITEMS), bits)
    assert plain(got) == brute(docs, items)


def test_spans(spark):
    items = spark.createDataFrame([(1, "a b")], ITEMS)
    row = decontaminate.with_hits(frame(spark, [(1, "x A b a b y a.b", "", "", 0)]), items).first()["hits"]
    assert (row["starts"], row["ends"]) == ([1, 6], [5, 8])


def test_without_hits(spark):
    docs, items = planted()
    docs += docs[70:75]
    got = decontaminate.without_hits(frame(spark, docs), spark.createDataFrame(items, ITEMS))
    clean = [r for r in docs if not brute([r], items)[0][-1]]
    assert plain(got) == sorted(clean, key=repr)


def test_query_equals_sql(spark, duck, folder):
    from searchloom.llm.queries import op3_decontaminate

    assert_same(op3_decontaminate(spark, folder), duck, decontaminate.ORACLE_SQL)


def test_edges(spark):
    none = spark.createDataFrame([], ITEMS)
    assert {r["n_hit"] for r in decontaminate.report(frame(spark), none).collect()} == {0}
    assert decontaminate.report(frame(spark, []), spark.createDataFrame([(1, "a")], ITEMS)).count() == 0
    items = spark.createDataFrame(planted()[1], ITEMS)
    assert plain(decontaminate.report(clashing(spark), items)) == plain(decontaminate.report(frame(spark), items))


def test_rarest_shingle_is_the_prefix(spark):
    docs = frame(spark, [(1, "a b c x a b c b c d", "", "", 0)]).select("text")
    items = spark.createDataFrame([("1", b"a b c d")], "item string, text binary")
    windows = items.mapInArrow(decontaminate._windows, decontaminate._WINDOWS)
    (row,) = decontaminate._prefixes(docs, windows, [3], 16).collect()
    assert (row["w"], row["k"], row["place"]) == ("a b c d", 4, 1)


def test_a_large_benchmark_of_many_words(spark):
    """20 MB of items with 2**21 different words, one item of 6 MB; nothing is kept in the driver or one index."""
    rng = random.Random(9)
    names = [f"w{i:07x}" for i in range(1 << 21)]
    long = names[: 600_000]
    items = [(1, " ".join(long))] + [(2 + i, " ".join(names[600_000 + i * 100 : 600_000 + (i + 1) * 100])) for i in range(14_970)]
    docs, want = [], []
    for i in range(60):
        at = rng.randrange(len(names) - 40)
        n = rng.choice([5, 9, 10, 12, 30])
        docs.append((i, f"{i} a text that has " + " ".join(names[at : at + n]).upper() + " and more", "en", "s", 1))
        # Runs that stay inside one item, of 10 words at least.
        owner = lambda j: 1 if j < 600_000 else 2 + (j - 600_000) // 100
        hit = {j for s in range(at, at + n - 9) if owner(s) == owner(s + 9) for j in range(s, s + 10)}
        want.append((i, n + 7, len(hit), len({owner(j) for j in hit})))
    got = decontaminate.report(frame(spark, docs), spark.createDataFrame(items, ITEMS).repartition(8)).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"]) for r in got) == want
