"""Byte-level BPE ids of whole texts through the tokenizers library, with the
library's ids of each distinct chunk of text kept in the worker.

Texts are cut into chunks at places where the library's own pre-tokens always
end: before a single space (or the last white space of a run) that a character
follows, before and after runs of white space, and before a full stop or comma
that stands between a letter or digit and white space. So a text is the
concatenation of its chunks, and its ids are those of its chunks. Cutting,
finding the chunks' ids and putting them together are array operations over
about 1 MB of text; only a chunk not seen before is cut into pre-tokens by this
module's pattern, which go to the library's model one by one. Texts of
characters where the pattern and the library might differ (other scripts,
special strings) are encoded whole by the library.

Chunks are found by their bytes, never by a hash alone. Two generations of
them are kept, so memory is bounded and frequent ones stay.
"""

from __future__ import annotations

import os
import re

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Letters and numbers up to U+024F.
_LETTERS, _NUMBERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾"
_PRETOKEN = re.compile(
    rf" ?[{_LETTERS}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{_NUMBERS}]+| ?[^\s{_LETTERS}{_NUMBERS}]+|\s+(?!\S)|\s+"
)
_OTHER = re.compile("[^\t\n\x0b\x0c\r\x20-\x7e¡-ɏ]")
#: A long text is cut before the white space after a word.
_CUT = re.compile(r"(?<=\S)\s")
_PIECE, _GROUP = 1 << 20, 1 << 20
#: Classes of bytes: white space, space, full stop and comma, letter or digit, end of a text.
_WHITE, _SPACE, _STOP, _ALNUM, _END = 1, 2, 4, 8, 16
_CLASS = np.zeros(256, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = _WHITE
_CLASS[32] |= _SPACE
_CLASS[[44, 46]] = _STOP
_CLASS[[c for c in range(128) if chr(c).isalnum()]] = _ALNUM
_CLASS[0] = _END
#: Bytes of a chunk that the table holds; longer chunks are in a dictionary, up to _LONGEST.
_WIDTH, _LONGEST = 16, 256
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_SLOT_BITS = 20
#: Chunks of a generation (two thirds of the slots), and long ones.
_GENERATION, _LONG_GENERATION = 700_000, 100_000
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _byte_level() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the
    others for the characters from U+0100 on, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(0x100 + i) for i, b in enumerate(others)}


_BYTES = _byte_level()


class _Table:
    """Open addressing from the bytes of a chunk (two words) to its place in a pool of ids."""

    def __init__(self, bits: int, dtype: np.dtype):
        self.first, self.second = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint64)
        self.at, self.n_ids = np.zeros(1 << bits, np.int32), np.zeros(1 << bits, np.int32)
        self.shift, self.mask, self.size = np.uint64(64 - bits), (1 << bits) - 1, 0
        self.pool, self.used = np.zeros(1 << 16, dtype), 0
        self.long: dict[bytes, tuple[int, int]] = {}

    def _start(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        mixed = (first ^ (second * _B)) * _A
        return ((mixed ^ (mixed >> np.uint64(29))) * _B >> self.shift).astype(np.int64)

    def find(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Slot of each chunk, -1 where it is absent."""
        found = np.full(len(first), -1, np.int64)
        slot = self._start(first, second)
        left = None
        while len(slot):
            there = self.first[slot]
            hit = (there == first) & (self.second[slot] == second)
            where = np.flatnonzero(hit)
            found[where if left is None else left[where]] = slot[where]
            on = np.flatnonzero(~hit & (there != 0))
            left = on if left is None else left[on]
            slot, first, second = (slot[on] + 1) & self.mask, first[on], second[on]
        return found

    def put(self, first: np.ndarray, second: np.ndarray, at: np.ndarray, n_ids: np.ndarray) -> None:
        """Adds distinct chunks that are absent."""
        self.size += len(first)
        slot, left = self._start(first, second), np.arange(len(first))
        while len(left):
            free = np.flatnonzero(self.first[slot] == 0)
            chosen, which = np.unique(slot[free], return_index=True)
            won = free[which]
            for column, values in ((self.first, first), (self.second, second), (self.at, at), (self.n_ids, n_ids)):
                column[chosen] = values[left[won]]
            rest = np.ones(len(left), bool)
            rest[won] = False
            left, slot = left[rest], slot[rest]
            slot = np.where(self.first[slot] != 0, (slot + 1) & self.mask, slot)

    def add_ids(self, ids: list) -> np.ndarray:
        """Appends lists of ids to the pool; where each begins."""
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        ends = self.used + np.cumsum(sizes)
        end = int(ends[-1]) if len(ids) else self.used
        if end > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros(max(end, 2 * len(self.pool)) - len(self.pool), self.pool.dtype)))
        self.pool[self.used : end] = np.fromiter((i for part in ids for i in part), self.pool.dtype, end - self.used)
        self.used = end
        return ends - sizes


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.dtype = np.dtype("<u2") if self.library.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, added))) if added else None
        self.known, self.older = _Table(_SLOT_BITS, self.dtype), None

    def _token(self, token: str) -> list[int]:
        """Ids of one pre-token, by the library's model."""
        if token.isascii() and token.isprintable():
            mapped = token.replace(" ", _BYTES[32])
        else:
            mapped = token.encode().decode("latin-1").translate(_BYTES)
        return [t.id for t in self.model.tokenize(mapped)]

    def _ids(self, chunk: bytes) -> list[int]:
        if chunk[0] == 32 and chunk[1:].isalpha():
            return [t.id for t in self.model.tokenize(_BYTES[32] + chunk[1:].decode())]
        return [i for token in _PRETOKEN.findall(chunk.decode()) for i in self._token(token)]

    def _turn(self, more: int) -> None:
        """A new generation, once the young one is full or may not hold so many more."""
        full = self.known.size > _GENERATION or self.known.size + more > 0.9 * (1 << _SLOT_BITS)
        if self.known.size and (full or len(self.known.long) > _LONG_GENERATION):
            self.older, self.known = self.known, _Table(_SLOT_BITS, self.dtype)

    def _learn(self, data: bytes, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, second: np.ndarray) -> None:
        """Puts the distinct ones of these chunks, all absent, into the young generation."""
        order = np.lexsort((second, first))
        a, b = first[order], second[order]
        order = order[np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))]
        first, second = first[order], second[order]
        slots = self.older.find(first, second) if self.older else np.full(len(first), -1)
        ids = []
        for s, e, slot in zip(starts[order].tolist(), ends[order].tolist(), slots.tolist(), strict=True):
            if slot < 0:
                ids.append(self._ids(data[s:e]))
            else:
                at = self.older.at[slot]
                ids.append(self.older.pool[at : at + self.older.n_ids[slot]])
        at = self.known.add_ids(ids)
        self.known.put(first, second, at, np.fromiter(map(len, ids), np.int64, len(ids)))

    def _long(self, chunk: bytes) -> tuple[int, int]:
        """Place and number of ids of a chunk that is wider than the table's."""
        found = self.known.long.get(chunk)
        if found is None:
            old = self.older.long.get(chunk) if self.older else None
            ids = self._ids(chunk) if old is None else self.older.pool[old[0] : sum(old)]
            found = int(self.known.add_ids([ids])[0]), len(ids)
            if len(chunk) <= _LONGEST:
                self.known.long[chunk] = found
        return found

    def _found(self, texts: list[bytes]) -> list[bytes]:
        """Ids of texts in the checked alphabet."""
        data = b"\0".join([*texts, b""])
        flat = np.frombuffer(data, np.uint8)
        kind = np.zeros(len(data) + 2, np.uint8)  # an end before and after
        kind[0] = kind[-1] = _END
        np.take(_CLASS, flat, out=kind[1:-1])
        white = kind & _WHITE > 0
        inside = kind & (_WHITE | _END) == 0
        own, before, after = slice(1, -1), slice(0, -2), slice(2, None)
        begins = white[own] & (inside[before] | inside[after])
        begins |= white[before] & (kind[before] & _SPACE == 0) & inside[own]
        begins |= (kind[own] & _STOP > 0) & (kind[before] & _ALNUM > 0) & ~inside[after]
        begins |= (kind[own] | kind[before]) & _END > 0
        starts = np.flatnonzero(begins)
        self._turn(len(starts))
        ends = np.concatenate((starts[1:], [len(data)]))
        sizes = ends - starts
        padded = np.frombuffer(data + bytes(_WIDTH), np.uint8)
        words = np.ndarray((len(data) + 8,), "<u8", padded, strides=(1,))
        first = words[starts] & _MASKS[np.minimum(sizes, 8)]
        second = words[starts + 8] & _MASKS[np.clip(sizes - 8, 0, 8)]
        last = flat[starts] == 0
        short = np.flatnonzero((sizes <= _WIDTH) & ~last)
        first, second = first[short], second[short]
        slots = self.known.find(first, second)
        new = np.flatnonzero(slots < 0)
        if len(new):
            self._learn(data, starts[short[new]], ends[short[new]], first[new], second[new])
            slots[new] = self.known.find(first[new], second[new])
        at, n_ids = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        at[short], n_ids[short] = self.known.at[slots], self.known.n_ids[slots]
        wide = np.flatnonzero(sizes > _WIDTH).tolist()
        kept = [i for i in wide if sizes[i] <= _LONGEST]
        for i in kept:
            at[i], n_ids[i] = self._long(data[starts[i] : ends[i]])
        used = self.known.used
        for i in wide:
            if sizes[i] > _LONGEST:
                at[i], n_ids[i] = self._long(data[starts[i] : ends[i]])
        self.known.used = used  # the longest ones stay only as long as these texts
        done = np.cumsum(n_ids)
        ids = self.known.pool[np.repeat(at - done + n_ids, n_ids) + np.arange(done[-1] if len(done) else 0)]
        raw, size, out, start = ids.tobytes(), self.dtype.itemsize, [], 0
        for end in (done[last] * size).tolist():
            out.append(raw[start:end])
            start = end
        return out

    def _cut(self, text: str) -> list[str]:
        pieces, at = [], 0
        while len(text) - at > _PIECE and (cut := _CUT.search(text, at + _PIECE)):
            pieces.append(text[at : cut.start()])
            at = cut.start()
        return [*pieces, text[at:]]

    def raw_many(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts, as bytes of ``dtype``."""
        out: list[bytes] = [b""] * len(texts)
        group: list[int] = []
        parts: list[bytes] = []
        size = 0

        def flush() -> None:
            for i, raw in zip(group, self._found(parts), strict=True):
                out[i] = raw
            group.clear()
            parts.clear()

        for i, text in enumerate(texts):
            if _OTHER.search(text) or (self.special and self.special.search(text)):
                ids = self.library.encode(text, add_special_tokens=False).ids
                out[i] = np.array(ids, self.dtype).tobytes()
            elif len(text) > _PIECE:
                out[i] = b"".join(self._found([p.encode()])[0] for p in self._cut(text))
            else:
                group.append(i)
                parts.append(text.encode())
                size += len(parts[-1])
                if size > _GROUP:
                    flush()
                    size = 0
        if group:
            flush()
        return out

    def raw(self, text: str) -> bytes:
        return self.raw_many([text])[0]

    def counts(self, texts: list[str]) -> list[int]:
        return [len(raw) // self.dtype.itemsize for raw in self.raw_many(texts)]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder of a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
