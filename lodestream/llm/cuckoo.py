"""A cuckoo filter over 64-bit hashes: compact membership with deletion."""

from __future__ import annotations

import numpy as np

_SLOTS = 4
_MAX_KICKS = 500
_U = np.uint64


class FilterFull(Exception):
    """No place was found for a key; rebuild from the exact table with more buckets."""


class CuckooFilter:
    """``buckets`` (a power of two) times four 16-bit fingerprints; 0 marks a free slot.

    ``insert`` takes keys that are not in the filter yet and ``delete`` only keys that are: the
    exact table behind the filter knows which ones these are.
    """

    def __init__(self, buckets: int, table: np.ndarray | None = None):
        self.buckets = buckets
        self.table = np.zeros((buckets, _SLOTS), np.uint16) if table is None else table

    @classmethod
    def sized_for(cls, n: int) -> CuckooFilter:
        buckets = 4
        while buckets * _SLOTS * 0.8 < n:
            buckets *= 2
        return cls(buckets)

    @classmethod
    def of(cls, keys: np.ndarray) -> CuckooFilter:
        """A filter of distinct keys, grown until every key has a place."""
        out = cls.sized_for(len(keys))
        while True:
            try:
                out.insert(keys)
                return out
            except FilterFull:
                out = cls(out.buckets * 2)

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def from_bytes(cls, blob: bytes) -> CuckooFilter:
        table = np.frombuffer(blob, np.uint16).reshape(-1, _SLOTS).copy()
        return cls(len(table), table)

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys = keys.astype(_U, copy=False)
        mask = _U(self.buckets - 1)
        mark = (keys >> _U(48)).astype(np.uint16)
        mark[mark == 0] = 1
        one = (keys & mask).astype(np.int64)
        return mark, one, self._other(one, mark)

    def _other(self, place: np.ndarray, mark: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            step = (mark.astype(_U) * _U(0x5BD1E9955BD1E995)) >> _U(20)
        return place ^ (step & _U(self.buckets - 1)).astype(np.int64)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        mark, one, two = self._places(keys)
        return ((self.table[one] == mark[:, None]) | (self.table[two] == mark[:, None])).any(axis=1)

    def insert(self, keys: np.ndarray) -> None:
        mark, one, two = self._places(keys)
        left = np.arange(len(keys))
        for place in (one, two):
            for slot in range(_SLOTS):
                if not len(left):
                    return
                at = place[left]
                free = self.table[at, slot] == 0
                ready = left[free]
                chosen, index = np.unique(place[ready], return_index=True)
                self.table[chosen, slot] = mark[ready[index]]
                left = np.setdiff1d(left, ready[index], assume_unique=True)
        for i in left:
            self._kick(int(mark[i]), int(one[i]))

    def _kick(self, mark: int, place: int) -> None:
        for turn in range(_MAX_KICKS):
            free = np.flatnonzero(self.table[place] == 0)
            if len(free):
                self.table[place, free[0]] = mark
                return
            slot = (turn * 7 + mark) % _SLOTS
            mark, self.table[place, slot] = int(self.table[place, slot]), mark
            place = int(self._other(np.array([place]), np.array([mark], np.uint16))[0])
        raise FilterFull

    def delete(self, keys: np.ndarray) -> None:
        for mark, one, two in zip(*self._places(keys), strict=True):
            for place in (one, two):
                slots = np.flatnonzero(self.table[place] == mark)
                if len(slots):
                    self.table[place, slots[0]] = 0
                    break
