"""Functions that Spark has no expression for, over Arrow batches."""

from __future__ import annotations

import html
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T


def cleaned(text: str) -> str:
    """Lower case, decomposed, only ``a-z``, digits and single spaces. Line breaks are dropped, not spaces."""
    plain = re.sub(r"[^a-z0-9 ]", "", unicodedata.normalize("NFKD", text.lower()))
    return re.sub(r" +", " ", plain)


def common_substring(a: str, b: str) -> int:
    """Length of the longest common substring: from each place of the shorter text
    only a longer one than the best so far is sought, by the string search."""
    if len(a) > len(b):
        a, b = b, a
    best = 0
    for i in range(len(a)):
        if i + best >= len(a):
            break
        while i + best < len(a) and a[i : i + best + 1] in b:
            best += 1
    return best


def unquoted(text: str) -> str:
    """Without paired outer quotes; doubled quotes are single ones."""
    while len(text) >= 2 and text[0] == text[-1] == '"':
        text = text[1:-1]
    return text.replace('""', '"')


def _text_function(function):
    @F.arrow_udf(T.StringType())
    def over(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else function(t) for t in texts.to_pylist()], pa.string())

    return over


clean_string = _text_function(cleaned)
html_unescape = _text_function(html.unescape)
normalise_quotes = _text_function(unquoted)


@F.arrow_udf(T.IntegerType())
def longest_common_substring(a: pa.Array, b: pa.Array) -> pa.Array:
    pairs = zip(a.to_pylist(), b.to_pylist(), strict=True)
    return pa.array([None if x is None or y is None else common_substring(x, y) for x, y in pairs], pa.int32())
