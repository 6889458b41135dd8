"""Minimal perfect hashing of 64-bit keys in numpy.

Each level is a bit array over the keys that are left: a key that is alone at
its place is settled there, the others go on to the next level with another
hash. A key's slot is the number of set bits before its own, so n keys have the
slots 0 to n-1 at some three bits a key. Keys that were not among them get some
slot too: the stored key of the slot tells.
"""

from __future__ import annotations

import numpy as np

from .textblocks import mix

#: Places a key on each level.
SPREAD = 2
#: Keys that are still in each other's way after so many levels are ordered and searched.
MAX_LEVELS = 40


def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    h = mix(keys ^ mix(np.array([level + 1], np.uint64) * np.uint64(0x9E3779B97F4A7C15))[0])
    return ((h >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)


class PerfectHash:
    """Slots of distinct uint64 keys; `keys` has them in the order of their slots."""

    def __init__(self, keys: np.ndarray):
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        slots = np.empty(len(keys), np.int64)
        left, base = np.arange(len(keys)), 0
        while len(left) and len(self.levels) < MAX_LEVELS:
            size = max(64, SPREAD * len(left))
            at = _place(keys[left], len(self.levels), size).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            words = np.packbits(np.pad(alone, (0, -size % 64)), bitorder="little").view(np.uint64)
            before = base + np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))])[:-1]
            self.levels.append((size, words, before))
            settled = alone[at]
            slots[left[settled]] = self._rank(at[settled], words, before)
            base += int(settled.sum())
            left = left[~settled]
        self.last = np.sort(keys[left])
        slots[left] = base + np.searchsorted(self.last, keys[left])
        self.base = base
        self.keys = np.empty(len(keys), np.uint64)
        self.keys[slots] = keys
        self.order = np.argsort(slots, kind="stable")

    def __len__(self) -> int:
        return len(self.keys)

    @staticmethod
    def _rank(at: np.ndarray, words: np.ndarray, before: np.ndarray) -> np.ndarray:
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        below = words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return before[word] + np.bitwise_count(below)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for those that the stored key shows to be others."""
        out = np.full(len(keys), -1, np.int64)
        if not len(self.keys):
            return out
        left = np.arange(len(keys))
        for level, (size, words, before) in enumerate(self.levels):
            if not len(left):
                break
            at = _place(keys[left], level, size).astype(np.int64)
            settled = (words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
            out[left[settled]] = self._rank(at[settled], words, before)
            left = left[~settled]
        if len(left) and len(self.last):
            at = np.minimum(np.searchsorted(self.last, keys[left]), len(self.last) - 1)
            out[left] = np.where(self.last[at] == keys[left], self.base + at, -1)
        found = out >= 0
        out[found] = np.where(self.keys[out[found]] == keys[found], out[found], -1)
        return out
