"""Minimal perfect hashing of 128-bit keys: n keys to the numbers 0 to n - 1, about three bits a key.

Keys are thrown into a bit array of their number; those alone in their place keep it, the others go
on to the next, smaller array, until none is left. A key's number is the rank of its bit.
"""

from __future__ import annotations

import numpy as np

from fluxgauge.llm.text import mix

_STEP = 0x9E3779B97F4A7C15
_RANK = 512


def _places(one: np.ndarray, two: np.ndarray, level: int, size: int) -> np.ndarray:
    seed = np.uint64((level + 1) * _STEP % 2**64)
    return mix(mix(one + seed) ^ two) % np.uint64(size)


class PerfectHash:
    """``sizes`` of the levels and their bits, one array after the other."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.starts = np.cumsum(sizes) - sizes
        ones = np.bitwise_count(np.pad(bits, (0, -len(bits) % (_RANK // 8)))).reshape(-1, _RANK // 8)
        self.within = np.cumsum(ones, axis=1, dtype=np.int64) - ones
        whole = ones.sum(axis=1, dtype=np.int64)
        self.before = np.cumsum(whole) - whole

    @classmethod
    def build(cls, one: np.ndarray, two: np.ndarray) -> "PerfectHash":
        """A function for the keys ``(one, two)``, which must differ from each other."""
        sizes, flags = [], []
        while len(one):
            size = -(-len(one) // 8) * 8
            place = _places(one, two, len(sizes), size)
            alone = np.bincount(place.astype(np.int64), minlength=size) == 1
            sizes.append(size)
            flags.append(alone)
            left = ~alone[place.astype(np.int64)]
            one, two = one[left], two[left]
        bits = np.packbits(np.concatenate(flags), bitorder="little") if flags else np.zeros(0, np.uint8)
        return cls(np.array(sizes, np.int64), bits)

    def numbers(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """The number of every key; any number, or -1, for a key the function was not built for."""
        out = np.full(len(one), -1, np.int64)
        left = np.arange(len(one))
        for level, (size, start) in enumerate(zip(self.sizes, self.starts)):
            at = start + _places(one[left], two[left], level, int(size)).astype(np.int64)
            byte, bit = at >> 3, (at & 7).astype(np.uint8)
            hit = (self.bits[byte] >> bit) & 1 == 1
            byte, bit = byte[hit], bit[hit]
            lower = np.bitwise_count(self.bits[byte] & ((np.uint8(1) << bit) - np.uint8(1)))
            group, inner = byte // (_RANK // 8), byte % (_RANK // 8)
            out[left[hit]] = self.before[group] + self.within[group, inner] + lower
            left = left[~hit]
        return out
