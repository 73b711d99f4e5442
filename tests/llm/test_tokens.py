import json
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from searchloom.llm import perfect_hash, token_counts, token_files
from searchloom.llm.bpe import Encoder
from searchloom.llm.queries import BYTE_BPE, PIECE_BPE
from tests.llm.samples import clashing, frame, plain, rows

LIBRARY = Tokenizer.from_file(BYTE_BPE)
ENCODER = Encoder(BYTE_BPE)


def library_ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


ODD = ["", "a  b\n\n c", "  x", "don't won'T 3²½ ٣ 日本語 é́", "<|endoftext|> x", "\x1f a\xa0b", "\t\t\nA" * 5, "x" * 3000 + " y", "é" * 10 + "ß ñandú\n" * 3, "!!?? ... 'll 're", " \n \n"]


def test_encoder_is_the_library():
    texts = ODD + [r[1] or "" for r in rows()]
    for text, raw in zip(texts, ENCODER.raw_many(texts), strict=True):
        assert np.frombuffer(raw, ENCODER.dtype).tolist() == library_ids(text), text[:40]


def test_long_texts_are_cut_safely(monkeypatch):
    monkeypatch.setattr("searchloom.llm.bpe._PIECE", 7)
    for text in [*ODD, "some  words\n and more words, it's 12 34  "]:
        assert np.frombuffer(ENCODER.raw(text), ENCODER.dtype).tolist() == library_ids(text)


@settings(max_examples=300, deadline=None)
@given(st.text("ab 'st\n\t.,1é²ÀZ<|> ", max_size=40))
def test_encoder_on_any_text(text):
    assert np.frombuffer(ENCODER.raw(text), ENCODER.dtype).tolist() == library_ids(text)


@pytest.mark.parametrize("n", [0, 1, 2, 7, 1000, 20000])
def test_perfect_hash(n):
    keys = np.random.default_rng(n).choice(10**12, n, replace=False).astype(np.int64) - 10**11
    pilots, slots = perfect_hash.build(keys)
    assert sorted(slots.tolist()) == list(range(n))
    assert perfect_hash.lookup(keys, pilots, n).tolist() == slots.tolist()


def expected(data):
    start, out = 0, []
    for i, text, *_ in sorted(data, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*library_ids(text), 2], "<u4")
        out.append((i, text, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out, start


def test_files_round_trip(spark, tmp_path):
    folder = str(tmp_path / "files")
    got = token_files.report(frame(spark), BYTE_BPE, folder).collect()
    want, total = expected(rows())
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got if r["doc_id"] is not None) == sorted((i, n, c) for i, _, n, c in want if i is not None)
    ordered = sorted(got, key=lambda r: r["start"])
    at = 0
    for r in ordered:
        assert r["start"] == at
        at += r["n_tokens"]
    assert at == total
    ids = [r["doc_id"] for r in ordered]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    by_id = {}
    for i, text, *_ in rows():
        by_id.setdefault(i, []).append([*library_ids(text), 2])
    for key in (0, 10, 59, 70):
        assert sorted(x.tolist() for x in token_files.fetch(folder, key)) == sorted(by_id[key])
    assert token_files.fetch(folder, 10**9) == []
    manifest = json.loads((tmp_path / "files/manifest.json").read_text())
    assert sum(s["n_rows"] for s in manifest["shards"]) == len(rows())


def test_shards_are_cut_and_keys_go_on(spark, tmp_path):
    folder = str(tmp_path / "cut")
    data = [(7, "the same words again", None, None, 0)] * 400 + [(i, f"text {i}", None, None, 0) for i in range(20)]
    manifest = token_files.write_token_files(frame(spark, data), folder, BYTE_BPE, most_bytes=500, most_rows=30)
    assert len(manifest) > 12 and max(s["n_rows"] for s in manifest) <= 30
    files = token_files.TokenFiles(folder)
    assert len(files.get(7)) == 401 and {len(x) for x in files.get(7)} == {len(library_ids(t)) + 1 for t in ("the same words again", "text 7")}
    assert [x.tolist() for x in files.get(12)] == [[*library_ids("text 12"), 2]]
    assert files.get(-1) == files.get(20) == []
    got = token_files.read_token_files(spark, folder).orderBy("start").collect()
    at = 0
    for row in got:
        assert row["start"] == at
        at += row["n_tokens"]
    assert sorted(r["doc_id"] for r in got) == sorted(r[0] for r in data) == [r["doc_id"] for r in got]


def test_a_colliding_absent_key_is_absent(tmp_path, monkeypatch):
    monkeypatch.setattr(perfect_hash, "fingerprints", lambda keys: np.full(len(keys), 9, np.uint32))
    writer = token_files.ShardWriter(str(tmp_path), "shard-x", np.dtype("<u2"))
    for key in (None, 3, 3, 8):
        writer.add(key, bytes([key or 0, 0]))
    assert writer.close() == {"n_rows": 4, "tokens": 4, "low": None, "high": 8}
    reader = token_files.ShardReader(str(tmp_path), "shard-x")
    assert [reader.find(k)[1] for k in (3, 8, 4, 5, 0)] == [2, 1, 0, 0, 0]
    assert [x.tolist() for x in reader.get(3)] == [[3], [3]]


def test_encoder_across_generations(monkeypatch):
    monkeypatch.setattr("searchloom.llm.bpe._GENERATION", 40)
    monkeypatch.setattr("searchloom.llm.bpe._LONG_GENERATION", 3)
    own, texts = Encoder(BYTE_BPE), ODD + [r[1] or "" for r in rows()]
    for _ in range(3):
        for text in texts:
            assert np.frombuffer(own.raw(text), own.dtype).tolist() == library_ids(text), text[:40]
    assert own.older is not None


@pytest.mark.parametrize("name", ["op6_token_files", "op9_token_counts"])
def test_registered_queries_on_documents(spark, folder, name):
    import sentencepiece

    from searchloom.llm.queries import queries

    data = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    got = queries()[name](spark, folder)
    if name == "op6_token_files":
        want, total = expected(data)
        assert plain(got.select("doc_id", "n_tokens", "ids_crc32")) == sorted(((i, n, c) for i, _, n, c in want), key=repr)
        last = max(got.collect(), key=lambda r: r["start"])
        assert last["start"] + last["n_tokens"] == total
    else:
        library = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
        counts = [(i, len((t or "").encode()), len(library.encode(t or ""))) for i, t in data]
        assert plain(got) == sorted(((i, b, n, n > 4096) for i, b, n in counts), key=repr)


def test_token_files_edges(spark):
    assert token_files.report(frame(spark, []), BYTE_BPE).count() == 0
    assert plain(token_files.report(clashing(spark), BYTE_BPE)) == plain(token_files.report(frame(spark), BYTE_BPE))
    (row,) = token_files.report(frame(spark, [(5, None, None, None, None)]), BYTE_BPE).collect()
    assert tuple(row) == (5, 0, 1, zlib.crc32(np.array([2], "<u4").tobytes()))


@pytest.mark.parametrize("vocabulary", [PIECE_BPE, BYTE_BPE])
def test_counts_are_the_library(spark, vocabulary):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    count = (lambda t: len(library.encode(t))) if vocabulary == PIECE_BPE else (lambda t: len(library_ids(t)))
    got = plain(token_counts.report(frame(spark), vocabulary))
    want = sorted(((i, len((t or "").encode()), count(t or ""), count(t or "") > 4096) for i, t, *_ in rows()), key=repr)
    assert got == want


def test_cache_is_used_and_appended(spark, tmp_path, monkeypatch):
    cache = str(tmp_path / "cache")
    first = plain(token_counts.count_tokens(frame(spark), PIECE_BPE, cache))
    stored = spark.read.parquet(cache)
    distinct = len({t or "" for _, t, *_ in rows()})
    assert stored.count() == distinct
    # Counts that are stored are not made again: a changed one shows.
    shifted = str(tmp_path / "shifted")
    stored.selectExpr("digest", "version", "n_tokens + 1000 AS n_tokens").write.parquet(shifted)
    again = plain(token_counts.count_tokens(frame(spark), PIECE_BPE, shifted))
    assert [r[2] - 1000 for r in again] == [r[2] for r in first]
    assert spark.read.parquet(shifted).count() == distinct
    # Another vocabulary has counts of its own; new texts are added.
    token_counts.count_tokens(frame(spark), BYTE_BPE, cache)
    assert spark.read.parquet(cache).count() == 2 * distinct
    token_counts.count_tokens(frame(spark, [(1, "a new text", "", "", 1)]), PIECE_BPE, cache)
    assert spark.read.parquet(cache).count() == 2 * distinct + 1


def test_count_edges(spark):
    assert token_counts.report(frame(spark, []), PIECE_BPE).count() == 0
    assert plain(token_counts.report(clashing(spark), PIECE_BPE)) == plain(token_counts.report(frame(spark), PIECE_BPE))
    assert public_tokenizers.path("piece_bpe_32k.model") == PIECE_BPE
