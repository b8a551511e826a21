"""Minimal perfect hash over a bounded set of keys, with fingerprints and stored values.

Keys are pairs of 64-bit words. On each level the keys that are left are hashed into twice as many bits;
those that are alone on theirs are done, the others go to the next level. The number of set bits before a
key's own is its slot, so n keys have the slots 0 .. n-1 and a look-up reads a few words, whatever n is.
A slot keeps the fingerprint of its key: a key that was never put in is found out (but for one in 2**32).
"""

from __future__ import annotations

import json

import numpy as np

SPACE = 2.0  # bits per key and level
_LEVELS = 200
_SEED = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64(0xD6E8FEB86659FD93)
_MAGIC = b"PHASH\0\0\1"


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _hashed(high: np.ndarray, low: np.ndarray, level: int) -> np.ndarray:
    seed = np.uint64((level + 1) * int(_SEED) % 2**64)
    return mixed(mixed(high ^ seed) + low * _LOW)


def fingerprints(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    return _hashed(high, low, _LEVELS).astype(np.uint32)


class PerfectHash:
    def __init__(self, sizes: np.ndarray, words: np.ndarray):
        self.sizes, self.words = sizes, words
        self.first = np.r_[0, np.cumsum(sizes // 64)].astype(np.int64)
        ones = np.bitwise_count(words).astype(np.int64)
        self.before = np.cumsum(ones) - ones
        self.n = int(ones.sum())

    @staticmethod
    def build(high: np.ndarray, low: np.ndarray) -> PerfectHash:
        """Of distinct keys; ValueError if a key stands there twice."""
        sizes, words = [], []
        left = np.arange(len(high))
        while len(left):
            if len(sizes) == _LEVELS:
                raise ValueError("a key is repeated")
            size = 64 * (1 + int(SPACE * len(left)) // 64)
            at = _hashed(high[left], low[left], len(sizes)) % np.uint64(size)
            at = at.astype(np.int64)
            alone = np.bincount(at, minlength=size)[at] == 1
            bits = np.zeros(size, bool)
            bits[at[alone]] = True
            sizes.append(size)
            words.append(np.packbits(bits, bitorder="little").view("<u8"))
            left = left[~alone]
        return PerfectHash(np.array(sizes, np.int64), np.concatenate([np.zeros(0, "<u8"), *words]))

    def slots(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 for a key that is surely not in. Others need their fingerprint checked."""
        found = np.full(len(high), -1, np.int64)
        left = np.arange(len(high))
        for level, size in enumerate(self.sizes.tolist()):
            at = (_hashed(high[left], low[left], level) % np.uint64(size)).astype(np.int64)
            word = self.first[level] + at // 64
            bit = np.uint64(1) << (at % 64).astype(np.uint64)
            here = (self.words[word] & bit) != 0
            word, bit = word[here], bit[here]
            found[left[here]] = self.before[word] + np.bitwise_count(self.words[word] & (bit - np.uint64(1)))
            left = left[~here]
        return found


def packed(high: np.ndarray, low: np.ndarray, values: dict[str, np.ndarray]) -> bytes:
    """The index as bytes: hash, fingerprints, and the values, each in slot order."""
    index = PerfectHash.build(high, low)
    order = np.empty(len(high), np.int64)
    order[index.slots(high, low)] = np.arange(len(high))
    arrays = {"sizes": index.sizes.astype("<i8"), "words": index.words, "fingerprints": fingerprints(high, low)[order]}
    arrays |= {name: column[order] for name, column in values.items()}
    head = json.dumps([(name, a.dtype.str, len(a)) for name, a in arrays.items()]).encode()
    head += b" " * (-len(head) % 8)
    body = [a.tobytes() + bytes(-a.nbytes % 8) for a in arrays.values()]
    return b"".join([_MAGIC, len(head).to_bytes(8, "little"), head, *body])


class Index:
    """Reads what ``packed`` has made."""

    def __init__(self, data: bytes):
        if data[:8] != _MAGIC:
            raise ValueError("not an index of this kind")
        at = 16 + int.from_bytes(data[8:16], "little")
        self.values: dict[str, np.ndarray] = {}
        for name, kind, n in json.loads(data[16:at]):
            self.values[name] = np.frombuffer(data, kind, n, at)
            at += -(-self.values[name].nbytes // 8) * 8
        self.hash = PerfectHash(self.values.pop("sizes"), self.values.pop("words"))
        self.prints = self.values.pop("fingerprints")

    def find(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 where the fingerprint tells that it was not put in."""
        slots = self.hash.slots(high, low)
        some = slots >= 0
        slots[some] = np.where(self.prints[slots[some]] == fingerprints(high[some], low[some]), slots[some], -1)
        return slots
