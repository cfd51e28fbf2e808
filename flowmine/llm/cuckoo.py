"""Cuckoo filters on arrays: many keys are added, looked up and removed at once.

A key is a 64-bit hash. Sixteen of its bits are the fingerprint kept in one of
two buckets of four; the other bucket follows from the bucket and the
fingerprint, so stored fingerprints can move without their keys. The few that
find no slot go to a stash. Each added key has its own fingerprint, hence
removing a key that was added takes nothing from others, and a key that is in is
always found. A filter over its load still answers right, but slowly; its owner
builds a larger one from the exact keys (see ``room``).
"""

from __future__ import annotations

import numpy as np

SLOTS = 4
#: Rounds of moving fingerprints before the rest goes to the stash, and the load that counts as full.
KICKS, FULL = 200, 0.9


def _parts(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprints, never zero, and first buckets) of keys among 2^bits buckets."""
    prints = (keys >> np.uint64(48)).astype(np.uint16)
    return np.where(prints == 0, np.uint16(1), prints), (keys & np.uint64((1 << bits) - 1)).astype(np.int64)


def _other(prints: np.ndarray, bucket: np.ndarray, bits: int) -> np.ndarray:
    mixed = (prints.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
    return bucket ^ (mixed & np.uint64((1 << bits) - 1)).astype(np.int64)


def _rank(values: np.ndarray) -> np.ndarray:
    """How many equal values stand before each."""
    order = np.argsort(values, kind="stable")
    ranked = values[order]
    first = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1]))) if len(values) else np.zeros(0, int)
    lengths = np.diff(np.append(first, len(values)))
    out = np.empty(len(values), np.int64)
    out[order] = np.arange(len(values)) - np.repeat(first, lengths)
    return out


class CuckooFilter:
    """2^bits buckets for about ``expected`` keys."""

    def __init__(self, expected: int = 0):
        self.bits = max(2, int(np.ceil(np.log2(max(1.0, expected / (SLOTS * FULL))))))
        self.table = np.zeros((1 << self.bits, SLOTS), np.uint16)
        self.stash = np.zeros(0, np.int64)

    def _codes(self, prints: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        return (np.minimum(bucket, _other(prints, bucket, self.bits)) << 16) | prints.astype(np.int64)

    @property
    def size(self) -> int:
        """Keys that are in."""
        return int(np.count_nonzero(self.table)) + len(self.stash)

    @property
    def room(self) -> int:
        """Keys that it should still take."""
        return int(self.table.size * FULL) - self.size

    def contains(self, keys: np.ndarray) -> np.ndarray:
        prints, bucket = _parts(keys, self.bits)
        there = (self.table[bucket] == prints[:, None]).any(axis=1)
        there |= (self.table[_other(prints, bucket, self.bits)] == prints[:, None]).any(axis=1)
        return there | np.isin(self._codes(prints, bucket), self.stash) if len(self.stash) else there

    def _settle(self, prints: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Put fingerprints into free slots of their buckets; tells which found one."""
        empty = self.table[bucket] == 0
        rank = _rank(bucket)
        fits = rank < empty.sum(axis=1)
        at, nth = np.flatnonzero(fits), rank[fits]
        slot = (np.cumsum(empty[at], axis=1) == (nth + 1)[:, None]).argmax(axis=1)
        self.table[bucket[at], slot] = prints[at]
        return fits

    def add(self, keys: np.ndarray) -> None:
        """Add each key, whether or not it is in."""
        prints, bucket = _parts(keys, self.bits)
        for turn in range(KICKS):
            left = ~self._settle(prints, bucket)
            prints, bucket = prints[left], bucket[left]
            other = _other(prints, bucket, self.bits)
            left = ~self._settle(prints, other)
            prints, bucket = prints[left], other[left]
            if not len(prints):
                return
            moving = np.flatnonzero(_rank(bucket) == 0)     # one move a bucket and turn; the others wait
            slot = (bucket[moving] + turn) % SLOTS
            victim = self.table[bucket[moving], slot].copy()
            self.table[bucket[moving], slot] = prints[moving]
            prints[moving] = victim
            bucket[moving] = _other(victim, bucket[moving], self.bits)
        self.stash = np.concatenate([self.stash, self._codes(prints, bucket)])

    def remove(self, keys: np.ndarray) -> None:
        """Remove keys that were added; one that was not is an error."""
        prints, first = _parts(keys, self.bits)
        done = np.zeros(len(keys), bool)
        for bucket in (first, _other(prints, first, self.bits)):
            while True:
                left = np.flatnonzero(~done)
                left = left[(self.table[bucket[left]] == prints[left, None]).any(axis=1)]
                left = left[_rank(bucket[left]) == 0]
                if not len(left):
                    break
                slot = (self.table[bucket[left]] == prints[left, None]).argmax(axis=1)
                self.table[bucket[left], slot] = 0
                done[left] = True
        if len(self.stash):
            left = np.flatnonzero(~done)
            codes = self._codes(prints[left], first[left])
            found, held = np.unique(self.stash, return_counts=True)
            at = np.minimum(np.searchsorted(found, codes), len(found) - 1)
            out = (found[at] == codes) & (_rank(codes) < held[at])
            done[left[out]] = True
            self.stash = np.repeat(found, held - np.bincount(at[out], minlength=len(found)))
        if not done.all():
            raise KeyError(f"{int((~done).sum())} keys are not in the filter")

    def to_bytes(self) -> bytes:
        return np.array([self.bits, len(self.stash)], np.int64).tobytes() + self.stash.tobytes() + self.table.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        out = cls()
        out.bits, stashed = np.frombuffer(data, np.int64, 2).tolist()
        out.stash = np.frombuffer(data, np.int64, stashed, 16).copy()
        out.table = np.frombuffer(data, np.uint16, offset=16 + 8 * stashed).reshape(-1, SLOTS).copy()
        return out
