"""Minimal perfect hashing of 64-bit keys by levels of collision-free bits.

On every level the keys that are left are hashed into ``BITS`` times as many bits (so
nine tenths of all keys are found on the first); keys
alone on their bit stay there, the others go to the next level.  A key's number
is how many bits stand before its own, counted over all levels.  The keys are
kept beside the hash, in the order of their numbers, so that a key that was not
in the set is told from one that was.

Defined cases: no keys give an empty hash that knows nothing; keys that repeat
count once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .text import mixed

#: Bits per key of a level.
BITS = 8
SEEDS = np.random.default_rng(5).integers(1, 2**63, 64, dtype=np.uint64)


def places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mixed(keys ^ SEEDS[level]) % np.uint64(size)).astype(np.int64)


@dataclass(frozen=True)
class PerfectHash:
    """Bits of each level in 64-bit words, how many bits stand before each word, and the keys by number."""

    words: tuple[np.ndarray, ...]
    before: tuple[np.ndarray, ...]
    keys: np.ndarray

    def __len__(self) -> int:
        return len(self.keys)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of keys from 0; -1 for keys that were not in the set."""
        asked = np.asarray(keys).astype(np.uint64)
        out = np.full(len(asked), -1, np.int64)
        open_ = np.arange(len(asked))
        for level, (words, before) in enumerate(zip(self.words, self.before)):
            if not len(open_):
                break
            at = places(asked[open_], level, 64 * len(words))
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            alone = (word >> bit & np.uint64(1)).astype(bool)
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[open_[alone]] = (before[at >> 6] + below)[alone]
            open_ = open_[~alone]
        known = out >= 0
        known[known] = self.keys[out[known]] == asked[known]
        out[~known] = -1
        return out


def perfect_hash(keys: np.ndarray) -> PerfectHash:
    """Build the hash of a set of keys."""
    left = np.unique(np.asarray(keys).astype(np.uint64))
    held = np.empty(len(left), np.uint64)
    words, before, total = [], [], 0
    while len(left):
        if len(words) == len(SEEDS):
            raise ValueError("keys collide on every level")
        size = 64 * max(1, (BITS * len(left) + 63) // 64)
        at = places(left, len(words), size)
        alone = np.bincount(at, minlength=size) == 1
        level = np.packbits(alone, bitorder="little").view(np.uint64)
        counts = np.bitwise_count(level).astype(np.int64)
        stays = alone[at]
        held[total + (np.cumsum(alone) - 1)[at[stays]]] = left[stays]
        words.append(level)
        before.append(total + np.cumsum(counts) - counts)
        total += int(counts.sum())
        left = left[~stays]
    return PerfectHash(tuple(words), tuple(before), held)
