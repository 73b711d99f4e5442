"""Small tables that every operator must stand."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def texts(seed: int = 5, n: int = 60) -> list[str]:
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghé") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    out = []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([4, 30, 70, 150]))]
        out.append("\n".join(" ".join(words[j : j + 12]) for j in range(0, len(words), 12)))
    out += [out[3], out[3], out[4] + " tail", out[5].upper(), out[6].replace(" ", "  ", 2)]
    return out


EDGES = [None, "", " ", "\n\n\t", "one", "one two", "a\x0bb\x0cc\rd", "x" * 5000, "word " * 3000, "¡é 日本 \U0001f600 ok", "<|endoftext|> end"]


def rows() -> list[tuple]:
    found = [(i, t, "en", f"s{i % 3}" if i % 7 else None, None if t is None else len(t)) for i, t in enumerate(texts() + EDGES)]
    return found + [found[10], found[10], (None, "no id here", None, None, 10), (None, None, None, None, None)]


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)


def clashing(spark):
    """Extra columns of names that operators use, also in another case."""
    return frame(spark).selectExpr(
        "*", "1 AS fingerprint", "2 AS component_id", "3 AS n_words", "4 AS size", "5 AS hits", "6 AS fp", "7 AS Doc_ID", "8 AS TEXT", "9 AS score", "10 AS spans", "11 AS digest"
    )


def plain(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)
