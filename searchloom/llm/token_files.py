"""Token-id files: raw ids by shard, with a minimal perfect hash index.

A folder holds shards, each a range of keys in ascending order: for the shard
``name``, ``name.ids`` is nothing but little-endian ids, and ``name.idx`` is

======================  =======================================================
first ``HEAD`` bytes    JSON, padded: version, dtype, rows, keys, nulls, tokens, buckets
``int64[rows]``         key of each row, ascending (null keys first, as 0)
``int64[rows + 1]``     id offset of each row, and the end
``int64[buckets]``      pilots of the hash
``uint32[keys]``        fingerprint of the key in each slot
``int64[keys, 2]``      first row of the key in each slot, and number of its rows
======================  =======================================================

and ``manifest.json`` lists the shards in order with their lowest and highest
key, so that a shard's first id has a global place. A key is found by bisection
of the manifest, then by reads at known places: one pilot, one slot's
fingerprint, its row and the exact key there (a fingerprint alone may mislead),
the offsets, the ids. A task begins another shard after ``SHARD_BYTES`` of ids
or ``SHARD_ROWS`` rows, so shards don't grow with the corpus, and rows of one
key may go on in the next shard. A shard is written under a name of the attempt
and then renamed, so a lost or repeated task does no harm.

Edge cases: a null or empty text is the end id alone; rows that share a key
follow each other (ordered by a hash of the text; repeated rows are
interchangeable) and a lookup gives them all, even over shards; null keys come
first and aren't looked up; an empty table gives a manifest of no shards; other
columns are ignored.
"""

from __future__ import annotations

import bisect
import json
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from searchloom.llm import perfect_hash
from searchloom.llm.bpe import encoder
from searchloom.llm.common import pick, scratch_path, shuffle_partitions

END_ID = 2
#: A shard's most bytes of ids and rows (a single longer text is a shard of its own).
SHARD_BYTES, SHARD_ROWS = 256 << 20, 1 << 20
HEAD = 256
#: Texts that are encoded together, bytes of ids that a reader takes at once, and its rows a batch.
_TEXTS, _READ, _ROWS = 1024, 8 << 20, 1 << 14
VERSION = 2
_SHARDS = "task long, part long, n_rows long, tokens long, low long, high long"


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder and its path there; ``file:/x`` is ``file:///x`` to Arrow."""
    if folder.startswith("file:/") and not folder.startswith("file://"):
        folder = "file://" + folder[5:]
    return pafs.FileSystem.from_uri(folder)


def _name(task: int, part: int) -> str:
    return f"shard-{task:05d}-{part:04d}"


class ShardWriter:
    def __init__(self, folder: str, name: str, dtype: np.dtype):
        self.fs, base = _open(folder)
        self.fs.create_dir(base, recursive=True)
        self.name, self.dtype = f"{base}/{name}", dtype
        self.attempt = f"{self.name}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(f"{self.attempt}.ids")
        self.keys, self.sizes, self.nulls, self.bytes = array("q"), array("q"), 0, 0

    def add(self, key: int | None, raw: bytes) -> None:
        self.out.write(raw)
        self.keys.append(0 if key is None else key)
        self.sizes.append(len(raw) // self.dtype.itemsize)
        self.nulls += key is None
        self.bytes += len(raw)

    def full(self, more: int, most_bytes: int, most_rows: int) -> bool:
        return len(self.keys) > 0 and (self.bytes + more > most_bytes or len(self.keys) >= most_rows)

    def close(self) -> dict:
        self.out.close()
        keys, nulls = np.array(self.keys, np.int64), self.nulls
        offsets = np.concatenate(([0], np.cumsum(np.array(self.sizes, np.int64)))).astype(np.int64)
        distinct, first, counts = np.unique(keys[nulls:], return_index=True, return_counts=True)
        pilots, slots = perfect_hash.build(distinct)
        prints, rows = np.zeros(len(distinct), np.uint32), np.zeros((len(distinct), 2), np.int64)
        prints[slots] = perfect_hash.fingerprints(distinct)
        rows[slots, 0], rows[slots, 1] = first + nulls, counts
        head = {
            "version": VERSION, "dtype": self.dtype.str, "rows": len(keys), "keys": len(distinct), "nulls": nulls,
            "tokens": int(offsets[-1]), "buckets": len(pilots),
        }
        with self.fs.open_output_stream(f"{self.attempt}.idx") as out:
            out.write(json.dumps(head).encode().ljust(HEAD - 1) + b"\n")
            for part in (keys, offsets, pilots, prints, rows):
                out.write(part.tobytes())
        for kind in ("ids", "idx"):
            self.fs.move(f"{self.attempt}.{kind}", f"{self.name}.{kind}")
        low, high = (None if i < nulls else int(keys[i]) for i in (0, len(keys) - 1))
        return {"n_rows": len(keys), "tokens": int(offsets[-1]), "low": low, "high": high}


class ShardReader:
    """Reads parts of a shard's files at their places; nothing is loaded whole."""

    def __init__(self, folder: str, name: str):
        fs, base = _open(folder)
        self.index, self.payload = fs.open_input_file(f"{base}/{name}.idx"), fs.open_input_file(f"{base}/{name}.ids")
        self.head = h = json.loads(self.index.read_at(HEAD, 0))
        self.dtype = np.dtype(h["dtype"])
        self.places, at = {}, HEAD
        for part, dtype, n in (
            ("keys", "<i8", h["rows"]), ("offsets", "<i8", h["rows"] + 1), ("pilots", "<i8", h["buckets"]),
            ("prints", "<u4", h["keys"]), ("rows", "<i8", 2 * h["keys"]),
        ):
            self.places[part] = at, np.dtype(dtype)
            at += n * np.dtype(dtype).itemsize

    def part(self, name: str, first: int, n: int) -> np.ndarray:
        at, dtype = self.places[name]
        return np.frombuffer(self.index.read_at(n * dtype.itemsize, at + first * dtype.itemsize), dtype)

    def find(self, key: int) -> tuple[int, int]:
        """First row and number of rows of a key; no rows where it is absent."""
        if not self.head["keys"]:
            return 0, 0
        keys = np.array([key], np.int64)
        pilot = self.part("pilots", int(perfect_hash.buckets_of(keys, self.head["buckets"])[0]), 1)
        slot = int(perfect_hash.slots_of(keys, pilot, self.head["keys"])[0])
        if self.part("prints", slot, 1)[0] != perfect_hash.fingerprints(keys)[0]:
            return 0, 0
        first, n = self.part("rows", 2 * slot, 2).tolist()
        return (first, n) if self.part("keys", first, 1)[0] == key else (0, 0)

    def ids(self, start: int, end: int) -> np.ndarray:
        size = self.dtype.itemsize
        return np.frombuffer(self.payload.read_at((end - start) * size, start * size), self.dtype)

    def get(self, key: int) -> list[np.ndarray]:
        first, n = self.find(key)
        offsets = self.part("offsets", first, n + 1).tolist()
        return [self.ids(a, b) for a, b in zip(offsets, offsets[1:], strict=False)]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """Key, id offset and ids of every row, in order: the slots of the hash say
        which rows a key has, and these must be all rows, once."""
        n, nulls = self.head["rows"], self.head["nulls"]
        keys = self.part("keys", 0, n)
        distinct = np.unique(keys[nulls:])
        slots = perfect_hash.lookup(distinct, self.part("pilots", 0, self.head["buckets"]), self.head["keys"])
        rows = self.part("rows", 0, 2 * self.head["keys"]).reshape(-1, 2)[slots]
        same = np.array_equal(self.part("prints", 0, self.head["keys"])[slots], perfect_hash.fingerprints(distinct))
        if not same or not np.array_equal(keys[rows[:, 0]], distinct) or nulls + rows[:, 1].sum() != n:
            raise ValueError("the index does not fit its shard")
        offsets = self.part("offsets", 0, n + 1)
        row = 0
        while row < n:
            limit = offsets[row] + _READ // self.dtype.itemsize
            last = max(row + 1, int(np.searchsorted(offsets, limit, "right")) - 1)
            places = offsets[row : last + 1].tolist()
            ids, base = self.ids(places[0], places[-1]), places[0]
            for i, key, a, b in zip(range(row, last), keys[row:last].tolist(), places, places[1:], strict=False):
                yield None if i < nulls else key, a, ids[a - base : b - base]
            row = last


def _shard_writer(folder: str, vocabulary: str, end_id: int, most_bytes: int, most_rows: int):
    def write(batches):
        task, part = TaskContext.get().partitionId(), 0
        encode = encoder(vocabulary)
        end = np.array([end_id], encode.dtype).tobytes()
        kind = pa.schema([(n.split()[0], pa.int64()) for n in _SHARDS.split(", ")])
        writer = None
        for batch in batches:
            for at in range(0, batch.num_rows, _TEXTS):
                rows = batch.slice(at, _TEXTS)
                texts = [text or "" for text in rows.column(1).to_pylist()]
                for key, raw in zip(rows.column(0).to_pylist(), encode.raw_many(texts), strict=True):
                    if writer and writer.full(len(raw) + len(end), most_bytes, most_rows):
                        yield pa.RecordBatch.from_pylist([{"task": task, "part": part} | writer.close()], kind)
                        writer, part = None, part + 1
                    writer = writer or ShardWriter(folder, _name(task, part), encode.dtype)
                    writer.add(key, raw + end)
        if writer:
            yield pa.RecordBatch.from_pylist([{"task": task, "part": part} | writer.close()], kind)

    return write


def write_token_files(
    docs: DataFrame, folder: str, vocabulary: str, end_id: int = END_ID, most_bytes: int = SHARD_BYTES, most_rows: int = SHARD_ROWS
) -> list[dict]:
    """Writes the shards of ``docs`` (``doc_id``, ``text``) in ascending order of
    id and returns the manifest: one entry a shard, in order."""
    spark = docs.sparkSession
    # The place in the input is the last part of the order: it parts rows that repeat, however many.
    rows = pick(docs, "doc_id", "text").withColumn("_tie", F.xxhash64("text")).withColumn("_at", F.monotonically_increasing_id())
    order = ("doc_id", "_tie", "_at")
    rows = rows.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    write = _shard_writer(folder, vocabulary, end_id, most_bytes, most_rows)
    written = rows.select("doc_id", "text").mapInArrow(write, _SHARDS)
    manifest, start = [], 0
    for row in sorted(written.collect(), key=lambda r: (r["task"], r["part"])):  # one row a shard
        entry = {"shard": _name(row["task"], row["part"]), "start": start}
        manifest.append(entry | {n: row[n] for n in ("n_rows", "tokens", "low", "high")})
        start += row["tokens"]
    fs, base = _open(folder)
    fs.create_dir(base, recursive=True)
    with fs.open_output_stream(f"{base}/manifest.json") as out:
        out.write(json.dumps({"version": VERSION, "shards": manifest}).encode())
    return manifest


def read_manifest(folder: str) -> list[dict]:
    fs, base = _open(folder)
    with fs.open_input_stream(f"{base}/manifest.json") as stream:
        return json.loads(stream.read())["shards"]


class TokenFiles:
    """Keyed access to a folder of shards."""

    def __init__(self, folder: str):
        self.folder = folder
        self.shards = [s for s in read_manifest(folder) if s["high"] is not None]
        self.highs = [s["high"] for s in self.shards]
        self.readers: dict[str, ShardReader] = {}

    def get(self, key: int) -> list[np.ndarray]:
        """Ids of every document of a key."""
        found = []
        for entry in self.shards[bisect.bisect_left(self.highs, key) :]:
            if entry["low"] is not None and entry["low"] > key:
                break
            name = entry["shard"]
            if name not in self.readers:
                self.readers[name] = ShardReader(self.folder, name)
            found += self.readers[name].get(key)
        return found


def fetch(folder: str, key: int) -> list[np.ndarray]:
    return TokenFiles(folder).get(key)


_NAMES = ("doc_id", "start", "n_tokens", "ids_crc32")


def _shard_reader(folder: str):
    def batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(4)], _NAMES)

    def read(batches):
        out: list[tuple] = []
        for shards in batches:
            for shard, start in zip(shards.column(0).to_pylist(), shards.column(1).to_pylist(), strict=True):
                for key, at, ids in ShardReader(folder, shard).documents():
                    out.append((key, start + at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    if len(out) == _ROWS:
                        yield batch(out)
                        out = []
        yield batch(out)

    return read


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files:
    each key is looked up in its shard's index and its ids are read."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    shards = read_manifest(folder)
    if not shards:
        return spark.createDataFrame([], schema)
    places = spark.createDataFrame([(s["shard"], s["start"]) for s in shards], "shard string, start long")
    return places.repartition(len(shards)).mapInArrow(_shard_reader(folder), schema)


def report(docs: DataFrame, vocabulary: str, folder: str | None = None) -> DataFrame:
    """Writes the files (in the shared folder, if none is given) and reads them back."""
    folder = folder or scratch_path(docs.sparkSession, "token-files")
    write_token_files(docs, folder, vocabulary)
    return read_token_files(docs.sparkSession, folder)
