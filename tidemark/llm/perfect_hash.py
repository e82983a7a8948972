"""A minimal perfect hash over a set of byte strings, with the strings kept for verification.

Each level is a bit array twice as large as the keys that are still without a place. A key whose bit no other key of the
level wants has its place there; the others go on to the next level. A key's slot is the number of bits set before its
own, so n keys have the slots 0 to n - 1. A string outside the set may find a slot too, which is why a lookup compares
it with the key kept there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Seed of XXH64, that of Spark's xxhash64, so Spark and Python deal keys alike.
SEED = 42
#: Levels after which keys that are left (whose 64-bit hashes are equal) are kept in a plain table.
LEVELS = 48


def hashes(keys: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(k, SEED) for k in keys), np.uint64, len(keys))


def _mix(h: np.ndarray, level: int) -> np.ndarray:
    x = h + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """`keys` (pa.binary, in the order of their slots), the levels' sizes and bits, and the keys without a bit."""

    def __init__(self, sizes: list[int], bits: bytes, keys: pa.Array, spare: int):
        self.sizes, self.bits, self.keys, self.spare = sizes, bits, keys, spare
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.set = np.unpackbits(np.frombuffer(bits, np.uint8))[: self.starts[-1]]
        self.rank = np.concatenate([[0], np.cumsum(self.set, dtype=np.int64)])
        first = len(keys) - spare
        self.rest = {k: first + n for n, k in enumerate(keys.slice(first).to_pylist())}

    @classmethod
    def build(cls, keys: list[bytes]) -> PerfectHash:
        """Over distinct keys."""
        h = hashes(keys)
        left, sizes, bits, order = np.arange(len(keys)), [], [], []
        while len(left) and len(sizes) < LEVELS:
            size = 2 * len(left)
            at = (_mix(h[left], len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size)[at] == 1
            level = np.zeros(size, np.uint8)
            level[at[alone]] = 1
            order.append(left[alone][np.argsort(at[alone])])
            sizes.append(size)
            bits.append(level)
            left = left[~alone]
        order = np.concatenate([*order, left]) if len(keys) else np.zeros(0, np.int64)
        packed = np.packbits(np.concatenate(bits)).tobytes() if bits else b""
        return cls(sizes, packed, pa.array([keys[k] for k in order.tolist()], pa.binary()), len(left))

    def slots(self, words: pa.Array, h: np.ndarray) -> np.ndarray:
        """The slot of each word (pa.binary) with its hash in `h`; -1 for words that are no keys."""
        found, left = np.full(len(h), -1, np.int64), np.arange(len(h))
        for level, size in enumerate(self.sizes):
            if not len(left):
                break
            at = self.starts[level] + (_mix(h[left], level) % np.uint64(size)).astype(np.int64)
            here = self.set[at] == 1
            found[left[here]] = self.rank[at[here]]
            left = left[~here]
        some = np.flatnonzero(found >= 0)
        same = pc.equal(self.keys.take(pa.array(found[some])), words.take(pa.array(some))).to_numpy(zero_copy_only=False)
        found[some[~same]] = -1
        if self.rest:
            for k in np.flatnonzero(found < 0).tolist():
                found[k] = self.rest.get(words[k].as_py(), -1)
        return found
