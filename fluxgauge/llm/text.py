"""Words of Arrow text columns as numpy arrays of 64-bit hashes.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D. Work goes over slices of a few
megabytes, so memory stays bounded whatever the size of a batch; only a single word longer than
a segment needs memory in proportion to its own length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEGMENT = 1 << 20
SLICE_BYTES = 2 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C17
_BASES = (_BASE, 0xC2B2AE3D27D4EB4F)
_BYTE = np.random.default_rng(7).integers(1, 2**64, 256, dtype=np.uint64)
_powers: dict[tuple[int, int], np.ndarray] = {}


def powers(base: int, sign: int, n: int) -> np.ndarray:
    """``base ** (sign * i)`` modulo 2**64 for i below ``n``."""
    have = _powers.get((base, sign))
    if have is None or len(have) < n:
        size = max(n, SEGMENT + 1)
        factors = np.full(size, pow(base, sign, 2**64), np.uint64)
        factors[0] = 1
        have = _powers[base, sign] = np.cumprod(factors, dtype=np.uint64)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


@dataclass
class Words:
    """Words of some documents: hashes, byte spans, and ``first[d]``, the first word of document d."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def document(self) -> np.ndarray:
        """The document of every word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows; nulls are empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches, column: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows with about ``size`` bytes of text; a longer text is alone."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + size, side="right")))
            yield batch.slice(at, to - at)
            at = to


def _cuts(data: np.ndarray, offsets: np.ndarray) -> list[int]:
    """Segment borders: document borders or white space, about ``SEGMENT`` bytes apart."""
    cuts, at, n = [0], 0, len(data)
    while n - at > SEGMENT:
        to = at + SEGMENT
        border = offsets[np.searchsorted(offsets, to)] if to <= offsets[-1] else n
        look = to
        while look < border:
            stop = min(look + 65536, border)
            space = np.flatnonzero(SPACE[data[look:stop]])
            if len(space):
                border = look + int(space[0])
                break
            look = stop
        at = int(min(border, n))
        cuts.append(at)
    if n > cuts[-1]:
        cuts.append(n)
    return cuts


def split_words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> Words:
    """Words of the documents in ``data``; ``lower`` folds A-Z before hashing."""
    table = _BYTE[LOWER] if lower else _BYTE
    hashes, starts, ends = [], [], []
    cuts = _cuts(data, offsets)
    for a, b in zip(cuts, cuts[1:]):
        part = data[a:b]
        inside = ~SPACE[part]
        inner = offsets[(offsets > a) & (offsets < b)] - a
        before = np.zeros(len(part), bool)
        before[1:] = inside[:-1]
        before[inner] = False
        after = np.zeros(len(part), bool)
        after[:-1] = inside[1:]
        after[inner - 1] = False
        first = np.flatnonzero(inside & ~before)
        last = np.flatnonzero(inside & ~after) + 1
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(table[part] * powers(_BASE, 1, len(part)), out=total[1:])
        h = (total[last] - total[first]) * powers(_BASE, -1, len(part) + 1)[first]
        hashes.append(mix(h))
        starts.append(first + a)
        ends.append(last + a)
    empty = np.zeros(0, np.int64)
    start = np.concatenate(starts) if starts else empty
    return Words(
        np.concatenate(hashes) if hashes else np.zeros(0, np.uint64),
        start,
        np.concatenate(ends) if ends else empty,
        np.searchsorted(start, offsets),
    )


def windows(h: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """Hash of ``h[i:i+size]`` for every i; ``which`` 0 and 1 are independent hashes."""
    if len(h) < size:
        return np.zeros(0, np.uint64)
    base = _BASES[which]
    values = mix(h + np.uint64(which * 0x632BE59BD9B4E019))
    weights = powers(base, 1, size)
    out = np.zeros(len(h) - size + 1, np.uint64)
    for k in range(size):
        out += values[k : k + len(out)] * weights[k]
    return mix(out)


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column from its flat values and the length of every list."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
