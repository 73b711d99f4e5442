"""Quality rules: base counts, and repetition coverage by rolling hashes.

The verdict measures characters inside repeated n-grams (5 to 10 words) and
inside repeated lines against the shares in ``NGRAM_PERCENT`` and
``LINE_PERCENT``. A batch of texts is one flat array of word hashes; n-gram
hashes roll from n to n + 1 over all texts at once, so the work is a few numpy
sorts a batch, whatever the number of texts.

Edge cases: null and empty texts have no words and fail the base rules; rows
that repeat are judged alike; an empty table gives an empty result; other
columns are kept by :func:`with_quality` and ignored by the query.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from searchloom.llm.common import numbered, word_blocks

#: Most percent of word characters inside n-grams that occur twice or more (the first time counts too), by n.
NGRAM_PERCENT = {5: 50, 6: 48, 7: 46, 8: 45, 9: 44, 10: 43}
#: Most percent of word characters in lines equal to an earlier one.
LINE_PERCENT = 30
BASE_WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = 3, 50, 50
SYMBOLS = b"#*$%&|<>"
_BLOCK = 1 << 20
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

_NAMES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "dup_line_chars",
    *(f"dup_{n}gram_chars" for n in NGRAM_PERCENT),
)
_FLAGS = ("base_failed", "kept")
MEASURES = T.StructType([T.StructField(n, T.BooleanType() if n in _FLAGS else T.LongType()) for n in _NAMES])


def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: distinct for distinct inputs."""
    x = x.astype(np.uint64) + _MULTIPLIER
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _code_points(data: bytes) -> int:
    """Number of code points of UTF-8 data."""
    return len(data.decode("utf-8", "replace")) if not data.isascii() else len(data)


def _lines(data: bytes) -> tuple[int, int]:
    """Lines with a word that are equal to an earlier one, and their word characters."""
    lines = [line for line in data.split(b"\n") if line.strip()]
    seen: set[bytes] = set()
    repeats = chars = 0
    for line in lines:
        if line in seen:
            repeats += 1
            chars += _code_points(b"".join(line.split()))
        seen.add(line)
    return repeats, chars


def _covered(hashes: np.ndarray, fits: np.ndarray, n: int) -> np.ndarray:
    """Whether each word is inside an n-gram found twice or more; fits: where an n-gram starts."""
    starts = np.flatnonzero(fits)
    found = hashes[starts]
    order = np.sort(found)
    twice = order[1:][order[1:] == order[:-1]]
    inside = np.zeros(len(hashes) + 1, np.int64)
    if len(twice):
        at = np.minimum(np.searchsorted(twice, found), len(twice) - 1)
        starts = starts[twice[at] == found]
        np.add.at(inside, starts, 1)
        np.add.at(inside, starts + n, -1)
    return np.cumsum(inside[:-1]) > 0


def _block(ids: list[np.ndarray], sizes: list[int], chars: np.ndarray) -> dict[str, np.ndarray]:
    """Coverage of the texts of one block; ids: word ids, chars: code points of each word."""
    counts = np.array(sizes, np.int64)
    flat = np.concatenate(ids) if ids else np.empty(0, np.int64)
    doc = np.repeat(np.arange(len(counts)), counts)
    left = np.repeat(np.cumsum(counts), counts) - np.arange(len(flat))  # words to the text's end, itself included
    per_doc = lambda weights: np.bincount(doc, weights, len(counts)).astype(np.int64)
    words = _mixed(flat)
    own = _mixed(doc + (1 << 40))
    rolled, out = words.copy(), {"word_chars": per_doc(chars)}
    for n in range(2, max(NGRAM_PERCENT) + 1):
        rolled = rolled[:-1] if len(rolled) else rolled
        rolled = rolled * _MULTIPLIER + words[n - 1 :]
        if n != BASE_WINDOW and n not in NGRAM_PERCENT:
            continue
        hashes = np.zeros(len(words), np.uint64)
        hashes[: len(rolled)] = _mixed(rolled ^ own[: len(rolled)])
        covered = _covered(hashes, left >= n, n)
        if n == BASE_WINDOW:
            out["n_repeat_words"] = per_doc(covered)
        else:
            out[f"dup_{n}gram_chars"] = per_doc(covered * chars)
    return out


def measure(texts: list[bytes | None]) -> dict[str, list]:
    """The columns of ``MEASURES`` for each text."""
    columns: dict[str, list] = defaultdict(list)
    vocabulary: dict[bytes, int] = {}
    ids: list[np.ndarray] = []
    sizes: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal size
        lengths = np.fromiter(map(_code_points, vocabulary), np.int64, len(vocabulary))
        flat = np.concatenate(ids) if ids else np.empty(0, np.int64)
        for name, values in _block(ids, sizes, lengths[flat]).items():
            columns[name] += values.tolist()
        vocabulary.clear(), ids.clear(), sizes.clear()
        size = 0

    for data in texts:
        data = data or b""
        n = 0
        for words in word_blocks(data, _BLOCK):
            for word in set(words).difference(vocabulary):
                vocabulary[word] = len(vocabulary)
            ids.append(np.fromiter(map(vocabulary.__getitem__, words), np.int64, len(words)))
            n += len(words)
        sizes.append(n)
        repeats, chars = _lines(data)
        columns["n_words"].append(n)
        columns["n_symbols"].append(len(data) - len(data.translate(None, SYMBOLS)))
        columns["n_dup_lines"].append(repeats)
        columns["dup_line_chars"].append(chars)
        size += len(data)
        if size >= _BLOCK:
            flush()
    flush()
    for i, n in enumerate(columns["n_words"]):
        failed = n < MIN_WORDS or 100 * columns["n_repeat_words"][i] > MAX_REPEAT_PERCENT * n
        total = columns["word_chars"][i]
        columns["base_failed"].append(failed)
        columns["kept"].append(
            not failed
            and 100 * columns["dup_line_chars"][i] <= LINE_PERCENT * total
            and all(100 * columns[f"dup_{n}gram_chars"][i] <= p * total for n, p in NGRAM_PERCENT.items())
        )
    return columns


@F.arrow_udf(MEASURES)
def quality_udf(texts: pa.Array) -> pa.Array:
    columns = measure(texts.cast(pa.binary()).to_pylist())
    arrays = [pa.array(columns[n], pa.bool_() if n in _FLAGS else pa.int64()) for n in _NAMES]
    return pa.StructArray.from_arrays(arrays, _NAMES)


def with_quality(docs, text_col: str = "text", name: str = "quality"):
    """``docs`` with a struct of the measures and the verdict of each text."""
    text = F.col(f"_{docs.columns.index(text_col)}")
    return numbered(docs).withColumn(name, quality_udf.asNondeterministic()(text)).toDF(*docs.columns, name)


_RULES = " AND ".join(
    [f"100 * coalesce(dup_line_chars, 0) <= {LINE_PERCENT} * word_chars"]
    + [f"100 * coalesce(dup_{n}gram_chars, 0) <= {p} * word_chars" for n, p in NGRAM_PERCENT.items()]
)


def _coverage_sql(n: int) -> str:
    out = "count(*)" if n == BASE_WINDOW else "sum(length(w))"
    name = "n_repeat_words" if n == BASE_WINDOW else f"dup_{n}gram_chars"
    return f"""
g{n} AS (SELECT rid, i, list_slice(ws, i, i + {n - 1}) AS g
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - {n - 2})) AS i FROM docs WHERE len(ws) >= {n})),
s{n} AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM g{n}) WHERE c > 1),
c{n} AS (SELECT rid, CAST({out} AS BIGINT) AS {name}
  FROM words JOIN (SELECT DISTINCT rid, i + unnest(range({n})) AS i FROM s{n}) USING (rid, i) GROUP BY rid)"""


_SIZES = (BASE_WINDOW, *NGRAM_PERCENT)
ORACLE_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
words AS (SELECT rid, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM docs),
lines AS (SELECT rid, line, count(*) - 1 AS repeats,
    length(regexp_replace(line, '[\\x20\\x09-\\x0D]', '', 'g')) AS chars
  FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM docs)
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY rid, line),
dup AS (SELECT rid, CAST(sum(repeats) AS BIGINT) AS n_dup_lines, CAST(sum(repeats * chars) AS BIGINT) AS dup_line_chars
  FROM lines GROUP BY rid),
{','.join(_coverage_sql(n) for n in _SIZES)},
base AS (SELECT docs.rid, doc_id, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, dup_line_chars,
    {', '.join(f'dup_{n}gram_chars' for n in NGRAM_PERCENT)}
  FROM docs LEFT JOIN dup USING (rid) {' '.join(f'LEFT JOIN c{n} USING (rid)' for n in _SIZES)}),
judged AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {_RULES} AS kept FROM judged
"""
