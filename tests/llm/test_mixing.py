import hashlib
import math
import re

import pytest

from searchloom.llm import mixing
from tests.comparing import assert_same
from tests.llm.samples import clashing, frame, plain, rows, texts


def brute_targets(sizes):
    """Water filling, round by round."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    total, target = 1.5 * sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in target]
        left = total - sum(target.values())
        over = [s for s in rest if left * weight[s] / max(1, sum(weight[x] for x in rest)) > 2 * sizes[s]]
        if not over:
            return target | {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        target |= {s: 2.0 * sizes[s] for s in over}


def brute(data):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, t, _, s, _ in data:
        sizes[s] = sizes.get(s, 0) + size(t)
    target = brute_targets(sizes)
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    copies, taken = [], [0] * len(data)
    for rank, s in enumerate(names):
        own = [i for i, r in enumerate(data) if r[3] == s]
        own.sort(key=lambda i: (hashlib.md5(("" if data[i][0] is None else str(data[i][0])).encode()).hexdigest(), data[i][0] is not None, data[i][0] or 0, size(data[i][1])))
        end = 0
        for round_ in range(2):
            for i in own:
                end += size(data[i][1])
                if size(data[i][1]):
                    copies.append((end / target[s], rank, end, i))
    left = math.floor(1.5 * sum(sizes.values()))
    for _, _, _, i in sorted(copies):
        left -= size(data[i][1])
        if left < 0:
            break
        taken[i] += size(data[i][1])
    return sorted(((r[0], size(r[1]), sizes[r[3]], round(target[r[3]], 6), taken[i]) for i, r in enumerate(data)), key=repr)


def rounded(frame):
    return sorted(((r[0], r[1], r[2], round(r[3], 6), r[4]) for r in frame.collect()), key=repr)


def test_mix_is_brute_force(spark):
    assert rounded(mixing.report(frame(spark))) == brute(rows())


def test_partitions_change_nothing(spark):
    assert rounded(mixing.report(frame(spark).repartition(7))) == brute(rows())


def test_a_hot_id_and_repeats(spark, monkeypatch):
    """Rows without an id, and most rows the same one: the queue ends inside these."""
    monkeypatch.setattr(mixing, "_RUN", 7)
    data = [(None, t, "en", "a", 1) for t in texts(n=60)] + [(5, "one two three", "en", "b", 1)] * 4000 + [(i, t, "en", "c", 1) for i, t in enumerate(texts(n=40))]
    want = brute(data)
    assert rounded(mixing.report(frame(spark, data).repartition(9))) == want
    got = sorted((r[0], len((r[1] or "").split())) for r in map(tuple, mixing.mixture(frame(spark, data)).collect()) if r[0] is not None)
    assert got == sorted((r[0], r[1]) for r in want if r[0] is not None for _ in range(r[4] // max(1, r[1])))
    assert len({r[4] for r in want if r[0] == 5 and r[1] == 3}) == 2


def test_targets_are_met(spark):
    data = [(i, t, "en", f"s{min(i % 9, 4)}", 1) for i, t in enumerate(texts(n=400))]
    got = mixing.report(frame(spark, data).withColumnRenamed("none", "none")).collect()
    taken, target = {}, {}
    for row, (_, _, _, s, _) in zip(sorted(got, key=lambda r: r["doc_id"]), data, strict=True):
        taken[s] = taken.get(s, 0) + row["taken"]
        target[s] = row["target"]
        assert row["taken"] in (0, row["size"], 2 * row["size"])
    assert all(abs(taken[s] - target[s]) <= 160 for s in target)


def test_mixture_repeats_rows(spark):
    got = mixing.mixture(frame(spark)).collect()
    words = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in got)
    assert words == sum(r[4] for r in brute(rows()))


def test_mixture_is_even(spark):
    """Any half of the queue has about the target mix."""
    data = [(i, t, "en", f"s{i % 3}", 1) for i, t in enumerate(texts(n=300))]
    got = list(map(tuple, mixing.mixture(frame(spark, data)).collect()))
    words = lambda rows, s: sum(len(r[1].split()) for r in rows if r[3] == s)
    half = got[: len(got) // 2]
    for s in ("s0", "s1", "s2"):
        assert abs(words(half, s) / words(half, "s1") - words(got, s) / words(got, "s1")) < 0.5


def test_query_equals_sql(spark, duck, folder):
    from searchloom.llm.queries import op7_mixing

    assert_same(op7_mixing(spark, folder), duck, mixing.ORACLE_SQL)


def test_edges(spark):
    assert mixing.report(frame(spark, [])).count() == 0
    nothing = [(1, None, "", "a", 0), (2, "", "", None, 0)]
    assert [r[-1] for r in plain(mixing.report(frame(spark, nothing)))] == [0, 0]
    assert plain(mixing.report(clashing(spark))) == plain(mixing.report(frame(spark)))
    one = mixing.report(frame(spark, [(1, "a b c", "", "a", 0)])).first()
    assert one["target"] == 4.5 and one["taken"] == 3
