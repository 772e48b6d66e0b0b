"""Token ids of distinct pieces of text, kept in flat arrays so that a batch is assembled by gathers."""

from __future__ import annotations

import numpy as np


def expand(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions ``start[k] .. start[k] + size[k] - 1`` of every k, in order."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)


class PieceStore:
    def __init__(self) -> None:
        self.flat, self.used = np.zeros(1 << 16, dtype=np.uint32), 0
        self.start, self.size = np.zeros(1 << 14, dtype=np.int64), np.zeros(1 << 14, dtype=np.int64)
        self.count = 0

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> range:
        """Store the pieces whose ids are concatenated in ``ids``; their numbers."""
        k, m = len(sizes), len(ids)
        while self.used + m > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.count + k > len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
            self.size = np.concatenate([self.size, np.zeros_like(self.size)])
        self.flat[self.used : self.used + m] = ids
        self.start[self.count : self.count + k] = self.used + np.cumsum(sizes) - sizes
        self.size[self.count : self.count + k] = sizes
        self.used += m
        self.count += k
        return range(self.count - k, self.count)

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces with these numbers, concatenated, and each one's count."""
        size = self.size[numbers]
        return self.flat[expand(self.start[numbers], size)], size


def per_text(sizes: np.ndarray, n_pieces: np.ndarray) -> np.ndarray:
    """Sums of ``sizes`` over consecutive groups of ``n_pieces``."""
    return np.diff(np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(n_pieces)])])


#: Bases of the two polynomial hashes, odd.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _powers(n: int, base: int, kept: dict = {}) -> np.ndarray:  # noqa: B006
    """``base ** i`` for i < n, remembered."""
    if base not in kept or len(kept[base]) < n:
        out = np.full(max(n, 1 << 16), base & (1 << 64) - 1, dtype=np.uint64)
        out[0] = 1
        kept[base] = np.multiply.accumulate(out)
    return kept[base][:n]


def slice_hashes(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """Two hashes of each slice of ``raw``, independent of where it stands; never 0."""
    out = []
    for base in BASES:
        # byte values stand for odd multiples of a constant of their own
        value = (np.arange(1, 257, dtype=np.uint64) * np.uint64(base ^ 0xFF51AFD7ED558CCD)) ^ np.uint64(base >> 7)
        sums = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum(value[raw] * _powers(len(raw), base), out=sums[1:])
        h = (sums[start + size] - sums[start]) * _powers(len(raw) + 1, pow(base, -1, 1 << 64))[start]
        h = (h ^ (h >> np.uint64(32)) ^ size.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        out.append(np.maximum(h ^ (h >> np.uint64(29)), np.uint64(1)))
    return out


class PieceTable:
    """Pairs of hashes -> numbers, by open addressing; many are looked up at once."""

    def __init__(self, bits: int = 22):
        self.shift, self.mask, self.count = np.uint64(64 - bits), (1 << bits) - 1, 0
        self.a, self.b = np.zeros(1 << bits, dtype=np.uint64), np.zeros(1 << bits, dtype=np.uint64)
        self.number = np.zeros(1 << bits, dtype=np.int32)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """-1 for pairs that aren't there."""
        out = np.full(len(a), -1, dtype=np.int64)
        todo, slot = np.arange(len(a)), (a >> self.shift).astype(np.int64)
        while len(todo):
            there = self.a[slot]
            hit = (there == a[todo]) & (self.b[slot] == b[todo])
            out[todo[hit]] = self.number[slot[hit]]
            on = (there != 0) & ~hit
            todo, slot = todo[on], (slot[on] + 1) & self.mask
        return out

    def put(self, a: np.ndarray, b: np.ndarray, number: np.ndarray) -> None:
        """Add pairs that are distinct and not there yet; the table must keep some room."""
        self.count += len(a)
        if 2 * self.count > self.mask:
            self._grow()
        todo, slot = np.arange(len(a)), (a >> self.shift).astype(np.int64)
        while len(todo):
            free = self.a[slot] == 0
            at, who = slot[free], todo[free]
            self.number[at] = who  # of several that want a slot one wins
            won = self.number[at] == who
            at, who = at[won], who[won]
            self.a[at], self.b[at], self.number[at] = a[who], b[who], number[who]
            left = np.ones(len(a), dtype=bool)
            left[who] = False
            on = left[todo]
            todo, slot = todo[on], (slot[on] + (self.a[slot[on]] != 0)) & self.mask

    def _grow(self) -> None:
        used = np.flatnonzero(self.a)
        held = self.a[used], self.b[used], self.number[used]
        count = self.count
        self.__init__((2 * count).bit_length())  # many may come at once
        self.put(*held)
        self.count = count
