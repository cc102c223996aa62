"""Minimal perfect hash tables over 64-bit keys, with stored keys."""

from __future__ import annotations

import numpy as np

#: Fixed odd multipliers of the mixing steps.
MULTIPLIERS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit integers for each salt."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(salt + 1) * MULTIPLIERS[0]
        x = (x ^ (x >> np.uint64(30))) * MULTIPLIERS[1]
        x = (x ^ (x >> np.uint64(27))) * MULTIPLIERS[2]
    return x ^ (x >> np.uint64(31))


class SlotTable:
    """Slots 0 to n - 1 of n distinct keys.

    Every level hashes the keys still open into twice as many bits; keys alone on their bit stay there, the
    others go on. A slot is the number of set bits before the key's bit. The key itself is stored at its slot, so
    that a key which isn't in the table is told from one that is.
    """

    def __init__(self, keys: np.ndarray):
        self.n, self.levels, rest, before = len(keys), [], keys.astype(np.uint64), 0
        while len(rest):
            size = 2 * len(rest) + 1
            at = (mix(rest, len(self.levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            bits = np.packbits(alone, bitorder="little")
            bits = np.concatenate([bits, np.zeros(-len(bits) % 8, np.uint8)]).view(np.uint64)
            ranks = before + np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)[:-1]])
            self.levels.append((size, bits, ranks))
            before += int(alone.sum())
            rest = rest[~alone[at]]
        self.stored = np.empty(self.n, np.uint64)
        self.stored[self._places(keys.astype(np.uint64))] = keys

    def _places(self, keys: np.ndarray) -> np.ndarray:
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (size, bits, ranks) in enumerate(self.levels):
            at = mix(keys[open_], level) % np.uint64(size)
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            held = bits[word]
            own = (held >> bit) & np.uint64(1) == 1
            below = held[own] & ((np.uint64(1) << bit[own]) - np.uint64(1))
            out[open_[own]] = ranks[word[own]] + np.bitwise_count(below)
            open_ = open_[~own]
            if not len(open_):
                break
        return out

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for keys that the table does not hold."""
        keys = keys.astype(np.uint64)
        if not self.n:
            return np.full(len(keys), -1, np.int64)
        out = self._places(keys)
        return np.where((out >= 0) & (self.stored[out] == keys), out, -1)
