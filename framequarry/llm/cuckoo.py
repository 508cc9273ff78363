"""Cuckoo filters of one shard as arrays: 16-bit fingerprints, two buckets of four slots each, and a stash."""

from __future__ import annotations

import numpy as np

SLOTS = 4
#: A filter is made twice as large when more than this share of its slots is taken.
FULL = 0.8
#: Rounds of moves after which what has no slot goes to the stash.
ROUNDS = 200


def buckets_for(entries: int) -> int:
    """The least power of two whose buckets hold so many entries."""
    out = 8
    while out * SLOTS * FULL < entries:
        out *= 2
    return out


class CuckooFilter:
    """Counts how often a 64-bit key was added, never too low; equal fingerprints in one place make it too high.

    All methods take arrays. A key may be added several times, and removed as often as it was added.
    """

    def __init__(self, buckets: int, table: bytes | None = None, stash: bytes | None = None) -> None:
        self.buckets = buckets
        self.table = np.zeros((buckets, SLOTS), np.uint16) if table is None else np.frombuffer(table, np.uint16).reshape(buckets, SLOTS).copy()
        #: fingerprint << 32 | the lesser of its two buckets
        self.stash = np.zeros(0, np.int64) if stash is None else np.frombuffer(stash, np.int64).copy()

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = keys.astype(np.int64).view(np.uint64)
        prints = np.maximum(h >> np.uint64(48), np.uint64(1)).astype(np.uint16)
        return prints, ((h >> np.uint64(24)) & np.uint64(self.buckets - 1)).astype(np.int64)

    def _other(self, prints: np.ndarray, at: np.ndarray) -> np.ndarray:
        return at ^ ((prints.astype(np.int64) * 0x5BD1E995 >> 8) & (self.buckets - 1))

    def _stashed(self, prints: np.ndarray, at: np.ndarray) -> np.ndarray:
        return prints.astype(np.int64) << 32 | np.minimum(at, self._other(prints, at))

    def copies(self, keys: np.ndarray) -> np.ndarray:
        prints, a = self._places(keys)
        b = self._other(prints, a)
        out = (self.table[a] == prints[:, None]).sum(1) + np.where(a == b, 0, (self.table[b] == prints[:, None]).sum(1))
        if len(self.stash):
            held = np.sort(self.stash)
            want = self._stashed(prints, a)
            out = out + np.searchsorted(held, want, "right") - np.searchsorted(held, want, "left")
        return out

    def add(self, keys: np.ndarray) -> None:
        prints, at = self._places(keys)
        rng = np.random.default_rng(len(prints))
        for k in range(ROUNDS):
            order = np.argsort(at, kind="stable")
            prints, at = prints[order], at[order]
            rank = np.arange(len(at)) - np.searchsorted(at, at)
            taken = self.table[at] != 0
            fits = rank < SLOTS - taken.sum(1)
            slot = np.argsort(taken[fits], 1, kind="stable")[np.arange(fits.sum()), rank[fits]]
            self.table[at[fits], slot] = prints[fits]
            prints, at, rank = prints[~fits], at[~fits], rank[~fits]
            if not len(at):
                return
            if k:  # one of each bucket takes the slot of another, which moves on
                heads = np.concatenate(([True], at[1:] != at[:-1]))
                where, slots = at[heads], rng.integers(0, SLOTS, heads.sum())
                moved = self.table[where, slots]
                self.table[where, slots] = prints[heads]
                prints[heads] = moved
            at = self._other(prints, at)
        self.stash = np.concatenate((self.stash, self._stashed(prints, at)))

    def remove(self, keys: np.ndarray) -> None:
        prints, at = self._places(keys)
        left = self._stashed(prints, at)
        for second in (False, True):
            where = self._other(prints, at) if second else at
            order = np.lexsort((prints, where))
            prints, at, where, left = prints[order], at[order], where[order], left[order]
            same = np.concatenate(([0], np.cumsum((where[1:] != where[:-1]) | (prints[1:] != prints[:-1]))))
            rank = np.arange(len(where)) - np.searchsorted(same, same)
            match = self.table[where] == prints[:, None]
            hit = rank < match.sum(1)
            slot = np.argsort(~match[hit], 1, kind="stable")[np.arange(hit.sum()), rank[hit]]
            self.table[where[hit], slot] = 0
            prints, at, left = prints[~hit], at[~hit], left[~hit]
            if not len(at):
                return
        for x in left:
            found = np.flatnonzero(self.stash == x)
            if not len(found):
                raise ValueError("a key was removed more often than it was added")
            self.stash = np.delete(self.stash, found[0])
