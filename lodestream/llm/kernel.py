"""Vectorised text kernels over Arrow buffers.

A batch of texts is one byte buffer plus offsets, so words, lines and their hashes come from a
few whole-buffer NumPy passes instead of a Python loop over words. UTF-8 keeps every byte of a
non-ASCII character at 0x80 or above, so character classes that only tell ASCII characters apart
can be decided byte by byte.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes that one pass of the kernels works on; a longer text is a pass of its own.
PASS_BYTES = 1 << 20
#: The same for kernels that keep many numbers for each byte or word.
SMALL_PASS = 1 << 18

_U = np.uint64
_BASE = (_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def tidied(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, a task's work on batches; at its end the worker, which serves later tasks, gives its free memory back."""

    @functools.wraps(run)
    def task(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
            if trim:
                trim(0)

    return task


def byte_class(*codes: int) -> np.ndarray:
    """A 256-entry membership table of the given byte values."""
    table = np.zeros(256, dtype=bool)
    table[list(codes)] = True
    return table


#: \x20 and \x09-\x0D.
SPACE = byte_class(0x20, *range(0x09, 0x0E))
#: Everything but \x00-\x2F, \x3A-\x60 and \x7B-\x7F: digits, a-z and all non-ASCII characters.
ALNUM = ~byte_class(*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string or binary array; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        width = np.int32
    else:
        column = column.cast(pa.large_string() if pa.types.is_large_string(column.type) else pa.large_binary())
        width = np.int64
    _, ends, data = column.buffers()
    if len(column) == 0 or ends is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(ends, dtype=width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    if column.null_count:
        valid = column.is_valid().to_numpy(zero_copy_only=False)
        if (np.diff(offsets)[~valid] > 0).any():
            return buffers(column.fill_null("" if not pa.types.is_binary(column.type) else b""))
    return raw, offsets


def passes(offsets: np.ndarray, budget: int = PASS_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``budget`` bytes each, or of one longer row."""
    start, n = 0, len(offsets) - 1
    while start < n:
        stop = int(np.searchsorted(offsets, offsets[start] + budget, side="right")) - 1
        stop = min(max(stop, start + 1), n)
        yield start, stop
        start = stop


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z become a-z; every other byte stays."""
    return _LOWER[data]


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes of a class, cut at row ends.

    Returns starts, ends and ``first``: row i holds the runs first[i] to first[i + 1].
    ``offsets`` start at 0 and end at ``len(data)``.
    """
    n = len(data)
    if n == 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    mask = inside[data]
    cut = np.zeros(n + 1, dtype=bool)
    cut[offsets] = True
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = mask[:-1]
    starts = np.flatnonzero(mask & (~before | cut[:n]))
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = mask[1:]
    ends = np.flatnonzero(mask & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing permutation of splitmix64, on uint64."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


class SpanHash:
    """64-bit hashes of byte spans from prefix sums of a polynomial modulo 2**64."""

    def __init__(self, which: int = 0):
        self.base = _BASE[which] | _U(1)
        self.inverse = _U(pow(int(self.base), -1, 1 << 64))
        self.powers = np.ones(1, _U)
        self.inverses = np.ones(1, _U)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            size = max(n, SMALL_PASS + 1)
            with np.errstate(over="ignore"):
                steps = np.full(size, self.base, dtype=_U)
                steps[0] = 1
                self.powers = np.multiply.accumulate(steps)
                steps[1:] = self.inverse
                self.inverses = np.multiply.accumulate(steps)

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if len(starts) == 0:
            return np.zeros(0, _U)
        n = len(data)
        self._grow(n + 1)
        total = np.empty(n + 1, _U)
        total[0] = 0
        with np.errstate(over="ignore"):
            np.add(data, _U(257), out=total[1:], dtype=_U)
            total[1:] *= self.powers[:n]
            np.cumsum(total, out=total)
            value = (total[ends] - total[starts]) * self.inverses[starts]
            return mix(value + (ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93))


def distinct_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct keys, a place of each, the number of each key among them)."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.ones(len(keys), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    inverse = np.empty(len(keys), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return ordered[new], order[new], inverse


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive word hashes, rows ignored; entry i covers words i to i + k - 1."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    with np.errstate(over="ignore"):
        out = words[:n].copy()
        for j in range(1, k):
            out = out * _U(0x100000001B3) + words[j : n + j]
        return mix(out + _U(k))


class Words:
    """Word hashes of the rows of one pass."""

    def __init__(self, inside: np.ndarray, which: int = 0):
        self.inside, self.hash = inside, SpanHash(which)

    def __call__(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, first): row i holds the words first[i] to first[i + 1]."""
        data = lower_ascii(raw[offsets[0] : offsets[-1]])
        starts, ends, first = spans(data, offsets - offsets[0], self.inside)
        return self.hash(data, starts, ends), first


class SpaceUnits:
    """Texts cut before each space, as hashes: what lies between two spaces is a unit.

    A text is ``plain`` if it has no space at its ends or next to another one; only of plain texts
    do the units and single spaces make up the text.
    """

    def __init__(self):
        self.one, self.two, self.inside = SpanHash(0), SpanHash(1), ~byte_class(0x20)

    def __call__(self, raw: np.ndarray, offsets: np.ndarray):
        """(data, starts, ends, first, h1, h2, plain) of the rows of one pass."""
        data, at = raw[offsets[0] : offsets[-1]], offsets - offsets[0]
        starts, ends, first = spans(data, at, self.inside)
        spaces = np.concatenate([[0], np.cumsum(data == 0x20)])
        n_spaces = spaces[at[1:]] - spaces[at[:-1]]
        plain = np.diff(first) == n_spaces + 1
        return data, starts, ends, first, self.one(data, starts, ends), self.two(data, starts, ends), plain


class WordTable:
    """Records of values by 128-bit key, some thirty bytes a word and the values: a bounded cache.

    ``lookup`` takes keys with repeats and asks ``make`` for the records of distinct keys it has not
    met; beyond ``most`` words it starts anew. New keys go to a small sorted list, which joins the
    large one when it has grown to a part of it.
    """

    def __init__(self, dtype, most: int):
        self.dtype, self.most = np.dtype(dtype), most
        self._clear()

    def _clear(self) -> None:
        self.lists = [self._none(), self._none()]
        self.starts, self.lengths, self.pool, self.used = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), np.zeros(1 << 16, self.dtype), 0
        self.words = 0

    @staticmethod
    def _none() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.zeros(0, _U), np.zeros(0, _U), np.zeros(0, np.int64)

    @staticmethod
    def _merged(a: tuple, b: tuple) -> tuple:
        at = np.searchsorted(a[0], b[0])
        return tuple(np.insert(x, at, y) for x, y in zip(a, b, strict=True))

    @staticmethod
    def _room(array: np.ndarray, used: int, more: int) -> np.ndarray:
        if used + more <= len(array):
            return array
        return np.concatenate([array[:used], np.zeros(max(more, len(array)), array.dtype)])

    def _add(self, keys: np.ndarray, checks: np.ndarray, flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """File the records, which follow each other in ``flat``; their numbers."""
        n = len(keys)
        self.pool = self._room(self.pool, self.used, len(flat))
        self.pool[self.used : self.used + len(flat)] = flat
        self.starts, self.lengths = self._room(self.starts, self.words, n), self._room(self.lengths, self.words, n)
        self.starts[self.words : self.words + n] = self.used + np.cumsum(lengths) - lengths
        self.lengths[self.words : self.words + n] = lengths
        numbers = self.words + np.arange(n)
        self.words, self.used = self.words + n, self.used + len(flat)
        order = np.argsort(keys)
        self.lists[1] = self._merged(self.lists[1], (keys[order], checks[order], numbers[order]))
        if len(self.lists[1][0]) > max(1 << 14, len(self.lists[0][0]) // 8):
            self.lists = [self._merged(*self.lists), self._none()]
        return numbers

    def lookup(self, keys: np.ndarray, checks: np.ndarray, make) -> tuple[np.ndarray, np.ndarray]:
        """(values, ends): the records of all keys one after another, and where each one ends.

        ``make`` gets places in ``keys`` and returns them in an order of its own, with the records'
        values one after another in that order, and their lengths.
        """
        if not len(keys):
            return self.pool[:0], np.zeros(0, np.int64)
        distinct, index, inverse = distinct_of(keys)
        if (checks != checks[index][inverse]).any():
            raise ArithmeticError("two words of a pass have one 64-bit hash")
        if self.words + len(distinct) > self.most:
            self._clear()
        number = np.full(len(distinct), -1)
        for sorted_keys, sorted_checks, numbers in self.lists:
            if len(sorted_keys):
                at = np.minimum(np.searchsorted(sorted_keys, distinct), len(sorted_keys) - 1)
                hit = (sorted_keys[at] == distinct) & (sorted_checks[at] == checks[index])
                number[hit] = numbers[at[hit]]
        missing = np.flatnonzero(number < 0)
        if len(missing):
            place, flat, lengths = make(index[missing])
            number[inverse[place]] = self._add(keys[place], checks[place], flat, lengths)
        each = number[inverse]
        lengths = self.lengths[each]
        ends = np.cumsum(lengths)
        take = np.repeat(self.starts[each] - ends + lengths, lengths)
        take += np.arange(len(take))
        return self.pool[take], ends


def batch(columns: dict[str, object], schema: pa.Schema) -> pa.RecordBatch:
    """A record batch of ``schema`` from arrays or lists by column name."""
    return pa.RecordBatch.from_arrays([x if isinstance(x := columns[f.name], pa.Array) else pa.array(x, type=f.type) for f in schema], schema=schema)


def binaries(rows: list[bytes]) -> pa.Array:
    return pa.array(rows, type=pa.binary())
