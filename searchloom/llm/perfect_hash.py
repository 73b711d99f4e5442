"""Minimal perfect hash of distinct 64-bit keys, with stored fingerprints.

Hash and displace: keys fall into buckets of about three; from the largest
bucket down, a pilot is sought that sends all its keys to free slots. Buckets
of one key name their slot outright, so the last slots cost no search. A
lookup reads one pilot and one slot.
"""

from __future__ import annotations

import numpy as np

_LOAD = 3
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    x = np.asarray(x).astype(np.int64).view(np.uint64) + np.uint64(int(_GOLDEN) * (salt + 1) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _slots(hashes: np.ndarray, pilots: np.ndarray, n: int) -> np.ndarray:
    x = hashes + (pilots.astype(np.uint64) + np.uint64(1)) * _GOLDEN
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return ((x ^ (x >> np.uint64(32))) % np.uint64(n)).astype(np.int64)


def build(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pilots by bucket, and the slot of each key. Keys are distinct."""
    n = len(keys)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    hashes = mixed(keys)
    buckets = buckets_of(keys, -(-n // _LOAD))
    order = np.argsort(buckets, kind="stable")
    sizes = np.bincount(buckets, minlength=-(-n // _LOAD))
    ends = np.cumsum(sizes)
    pilots, slots, free = np.zeros(len(sizes), np.int64), np.zeros(n, np.int64), np.ones(n, bool)
    for bucket in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[bucket])
        if size < 2:
            break
        members = order[ends[bucket] - size : ends[bucket]]
        first, step = 0, 16
        while True:
            tried = np.arange(first, first + step)
            places = _slots(hashes[members][None, :], tried[:, None], n)
            good = free[places].all(axis=1)
            if size > 1:
                ordered = np.sort(places, axis=1)
                good &= (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
            hit = np.flatnonzero(good)
            if len(hit):
                pilots[bucket] = tried[hit[0]]
                slots[members] = places[hit[0]]
                free[places[hit[0]]] = False
                break
            first, step = first + step, min(4096, 2 * step)
    single = np.flatnonzero(sizes == 1)
    rest = np.flatnonzero(free)
    pilots[single] = -1 - rest
    slots[order[ends[single] - 1]] = rest
    return pilots, slots


def buckets_of(keys: np.ndarray, n_buckets: int) -> np.ndarray:
    return (mixed(keys, 1) % np.uint64(n_buckets)).astype(np.int64)


def slots_of(keys: np.ndarray, pilots: np.ndarray, n: int) -> np.ndarray:
    """The slot of each of ``n`` keys by the pilot of its bucket."""
    return np.where(pilots < 0, -1 - pilots, _slots(mixed(keys), np.maximum(pilots, 0), n))


def lookup(keys: np.ndarray, pilots: np.ndarray, n: int) -> np.ndarray:
    """The slot where each key would be; any slot for a key that isn't there."""
    if not n:
        return np.zeros(len(keys), np.int64)
    return slots_of(keys, pilots[buckets_of(keys, len(pilots))], n)


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys, 2) >> np.uint64(32)).astype(np.uint32)
