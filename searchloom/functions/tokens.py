"""Token lengths and token-bounded texts, with any tokenizer file."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

_tokenizers: dict = {}


def _tokenizer(path: str):
    if path not in _tokenizers:
        from tokenizers import Tokenizer

        _tokenizers[path] = Tokenizer.from_file(path)
    return _tokenizers[path]


def token_length(path: str, most: int | None = None):
    """A column function: tokens of a text, at most so many."""

    @F.arrow_udf(T.IntegerType())
    def length(texts: pa.Array) -> pa.Array:
        found = [None if t is None else len(_tokenizer(path).encode(t, add_special_tokens=False).ids) for t in texts.to_pylist()]
        return pa.array([n if n is None or most is None else min(n, most) for n in found], pa.int32())

    return length


def truncated(path: str, most: int):
    """A column function: a text up to the end of its ``most``-th token."""

    def cut(text: str) -> str:
        found = _tokenizer(path).encode(text, add_special_tokens=False)
        return text if len(found.ids) <= most else text[: found.offsets[most - 1][1]] if most else ""

    @F.arrow_udf(T.StringType())
    def over(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else cut(t) for t in texts.to_pylist()], pa.string())

    return over
