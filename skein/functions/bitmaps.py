"""Compressed bitmaps over dense integer ids.

Ids are cut into containers of 65,536. A container with few bits is a sorted uint16 array, one with many is a bitset of
8 KB; both are taken apart with numpy. This is the published two-kind container layout of roaring bitmaps.
"""

from __future__ import annotations

import numpy as np

SPARSE_LIMIT = 4096
_BITS = 65536


class Bitmap:
    """A set of non-negative integers."""

    def __init__(self, parts: dict[int, np.ndarray]):
        self.parts = parts

    @classmethod
    def of(cls, ids: np.ndarray) -> "Bitmap":
        """ids: any order, repeats allowed."""
        ids = np.unique(np.asarray(ids, dtype=np.int64))
        parts: dict[int, np.ndarray] = {}
        if len(ids):
            high = ids >> 16
            edges = np.flatnonzero(np.diff(high)) + 1
            for chunk in np.split(ids, edges):
                parts[int(chunk[0] >> 16)] = _pack((chunk & 0xFFFF).astype(np.uint16))
        return cls(parts)

    def andnot(self, other: "Bitmap") -> "Bitmap":
        """The ids of this bitmap that the other lacks."""
        out: dict[int, np.ndarray] = {}
        for high, mine in self.parts.items():
            theirs = other.parts.get(high)
            left = mine if theirs is None else _andnot(mine, theirs)
            if left is not None and len(left):
                out[high] = left
        return Bitmap(out)

    def ids(self) -> np.ndarray:
        """Sorted ids."""
        if not self.parts:
            return np.empty(0, dtype=np.int64)
        return np.concatenate([(high << 16) + _low(self.parts[high]).astype(np.int64) for high in sorted(self.parts)])

    def __len__(self) -> int:
        return int(sum(len(p) if p.dtype == np.uint16 else int(np.bitwise_count(p).sum()) for p in self.parts.values()))

    @property
    def nbytes(self) -> int:
        return sum(p.nbytes for p in self.parts.values())


def _pack(low: np.ndarray) -> np.ndarray:
    if len(low) <= SPARSE_LIMIT:
        return low
    bits = np.zeros(_BITS, dtype=np.uint8)
    bits[low] = 1
    return np.packbits(bits, bitorder="little")


def _low(part: np.ndarray) -> np.ndarray:
    if part.dtype == np.uint16:
        return part
    return np.flatnonzero(np.unpackbits(part, bitorder="little")).astype(np.uint16)


def _andnot(mine: np.ndarray, theirs: np.ndarray) -> np.ndarray:
    if mine.dtype == np.uint16:
        if theirs.dtype == np.uint16:
            return mine[~np.isin(mine, theirs, assume_unique=True)]
        return mine[(theirs[mine >> 3] >> (mine & 7).astype(np.uint8)) & 1 == 0]
    if theirs.dtype == np.uint16:
        mine = mine.copy()
        np.bitwise_and.at(mine, theirs >> 3, ~(np.uint8(1) << (theirs & 7).astype(np.uint8)))
        return _pack(_low(mine))
    return _pack(_low(mine & ~theirs))
