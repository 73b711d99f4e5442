import random
import re
from collections import Counter

from searchloom.llm import quality
from tests.comparing import assert_same
from tests.llm.samples import clashing, frame, rows


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)

    def inside(n):
        grams = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
        seen = Counter(grams)
        return {i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(n)}

    lines, repeats, chars = set(), 0, 0
    for line in text.split("\n"):
        own = re.findall(r"[^\x20\x09-\x0D]+", line)
        if own and line in lines:
            repeats += 1
            chars += sum(map(len, own))
        lines.add(line)
    total = sum(map(len, words))
    out = {
        "n_words": len(words), "word_chars": total, "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": repeats,
        "n_repeat_words": len(inside(3)), "dup_line_chars": chars,
    }
    out |= {f"dup_{n}gram_chars": sum(len(words[i]) for i in inside(n)) for n in quality.NGRAM_PERCENT}
    out["base_failed"] = len(words) < 50 or 100 * out["n_repeat_words"] > 50 * len(words)
    out["kept"] = (
        not out["base_failed"]
        and 100 * chars <= quality.LINE_PERCENT * total
        and all(100 * out[f"dup_{n}gram_chars"] <= p * total for n, p in quality.NGRAM_PERCENT.items())
    )
    return out


def repetitive(seed, n=40):
    rng = random.Random(seed)
    for _ in range(n):
        lines = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(1, 14))) for _ in range(8)]
        yield "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 20)))


def test_measures_are_brute_force():
    texts = [r[1] for r in rows()] + list(repetitive(2))
    got = quality.measure([None if t is None else t.encode() for t in texts])
    for i, text in enumerate(texts):
        assert {k: got[k][i] for k in brute(text)} == brute(text), text


def test_blocks_dont_mix(monkeypatch):
    monkeypatch.setattr(quality, "_BLOCK", 50)
    texts = list(repetitive(3))
    got = quality.measure([t.encode() for t in texts])
    assert [got["n_repeat_words"][i] for i in range(len(texts))] == [brute(t)["n_repeat_words"] for t in texts]


def test_query_equals_sql(spark, duck, folder):
    from searchloom.llm.queries import op2_quality

    assert_same(op2_quality(spark, folder), duck, quality.ORACLE_SQL)


def test_edges(spark):
    assert quality.with_quality(frame(spark, [])).count() == 0
    got = {(r["doc_id"], r["text"]): r["quality"]["n_words"] for r in quality.with_quality(frame(spark)).collect()}
    assert got[None, None] == 0
    more = quality.with_quality(clashing(spark))
    assert more.columns[-1] == "quality" and more.count() == len(rows())
