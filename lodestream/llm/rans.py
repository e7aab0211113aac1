"""Static range asymmetric numeral system over many interleaved lanes.

A block codes its symbols with a frequency table that all blocks share: symbol i belongs to lane
i mod ``lanes``, and one step works on all lanes at once. Blocks stand alone, so they decode in
parallel; inside a block, checkpoints hold the lanes' states, from which decoding can start.

Layout, little-endian: magic, scale bits (u8), lanes (u16), symbols, words, checkpoints, checksum of
all that follows the head, checksum of the symbols as u32 (u32 each); the lanes' states (u64); each
checkpoint as step, word offset (u32 each) and states; the words (u32).
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"LSR1"
LANES = 512
#: Symbols between two checkpoints.
CHECKPOINT = 1 << 17

_HEAD = struct.Struct("<4sBHIIIII")
_U = np.uint64
_LOW = _U(1 << 31)
_WORD = _U(32)


class BadBlock(ValueError):
    """A block's checksum, magic or table doesn't fit."""


class FrequencyTable:
    """Frequencies of symbols scaled to a power of two; symbols without a count have no code."""

    def __init__(self, freqs: np.ndarray, bits: int):
        self.bits = bits
        self.freqs = freqs.astype(np.int64)
        self.starts = np.cumsum(self.freqs) - self.freqs
        self._f, self._c = self.freqs.astype(_U), self.starts.astype(_U)
        self._limit = self._f << _U(63 - bits)
        self._slots: np.ndarray | None = None

    @classmethod
    def of_counts(cls, counts: np.ndarray, bits: int = 18) -> FrequencyTable:
        """Each counted symbol keeps a frequency of 1 at least; the largest ones take the rounding."""
        counts = np.asarray(counts, np.int64)
        used = int((counts > 0).sum())
        while used * 4 > 1 << bits:
            bits += 1
        size, total = 1 << bits, int(counts.sum())
        freqs = np.zeros(len(counts), np.int64)
        if not used:
            return cls(freqs, bits)
        exact = counts * (size / total)
        freqs = np.where(counts > 0, np.maximum(1, np.floor(exact)), 0).astype(np.int64)
        order = np.argsort(-counts, kind="stable")[:used]
        spare = size - int(freqs.sum())
        while spare:
            for s in order.tolist():
                step = min(spare, max(1, spare // used)) if spare > 0 else -min(-spare, freqs[s] - 1, max(1, int(freqs[s]) // 8))
                freqs[s] += step
                spare -= step
                if not spare:
                    break
        return cls(freqs, bits)

    def to_bytes(self) -> bytes:
        return struct.pack("<BI", self.bits, len(self.freqs)) + zlib.compress(self.freqs.astype("<u4").tobytes(), 1)

    @classmethod
    def from_bytes(cls, blob: bytes) -> FrequencyTable:
        bits, n = struct.unpack_from("<BI", blob)
        freqs = np.frombuffer(zlib.decompress(blob[5:]), "<u4")
        if len(freqs) != n:
            raise BadBlock("frequency table of another size")
        return cls(freqs, bits)

    @property
    def slots(self) -> np.ndarray:
        """The symbol of each slot."""
        if self._slots is None:
            self._slots = np.repeat(np.arange(len(self.freqs), dtype=np.uint32), self.freqs)
        return self._slots


def encode(symbols: np.ndarray, table: FrequencyTable, lanes: int = LANES, checkpoint: int = CHECKPOINT) -> bytes:
    """One block. Every symbol has to have a frequency in the table."""
    n = len(symbols)
    lanes = max(1, min(lanes, n // 64))
    steps = -(-n // lanes)
    if n and not table.freqs[symbols].all():
        raise ValueError("a symbol has no frequency")
    f, c, limit, bits = table._f[symbols], table._c[symbols], table._limit[symbols], _U(table.bits)
    every = max(1, checkpoint // lanes)
    states = np.full(lanes, _LOW, _U)
    words, marks = [], []
    for step in range(steps - 1, -1, -1):
        lo, hi = step * lanes, min(n, (step + 1) * lanes)
        x = states[: hi - lo]
        over = x >= limit[lo:hi]
        words.append(x[over].astype(np.uint32))
        x = np.where(over, x >> _WORD, x)
        q = x // f[lo:hi]
        states[: hi - lo] = (q << bits) + (x - q * f[lo:hi]) + c[lo:hi]
        if step and step % every == 0:
            marks.append((step, len(words), states.copy()))
    sizes = np.array([len(w) for w in words[::-1]], np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    stream = np.concatenate(words[::-1]) if words else np.zeros(0, np.uint32)
    body = [states.astype("<u8").tobytes()]
    for step, _, held in marks[::-1]:
        body += [struct.pack("<II", step, int(offsets[step])), held.astype("<u8").tobytes()]
    body = b"".join([*body, stream.astype("<u4").tobytes()])
    return _HEAD.pack(MAGIC, table.bits, lanes, n, len(stream), len(marks), zlib.crc32(body), checksum(symbols)) + body


def checksum(symbols: np.ndarray) -> int:
    """crc32 of the symbols as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(symbols, "<u4"))


class Block:
    """A parsed block, checked against the checksum of its bytes."""

    def __init__(self, blob: bytes, table: FrequencyTable):
        magic, bits, self.lanes, self.n, n_words, n_marks, crc, self.crc_symbols = _HEAD.unpack_from(blob)
        body = memoryview(blob)[_HEAD.size :]
        if magic != MAGIC or bits != table.bits or zlib.crc32(body) != crc:
            raise BadBlock("the block is damaged or belongs to another table")
        self.table, at = table, 8 * self.lanes
        self.steps = -(-self.n // self.lanes)
        self.marks = [(0, 0, np.frombuffer(body[:at], "<u8"))]
        for _ in range(n_marks):
            step, offset = struct.unpack_from("<II", body, at)
            self.marks.append((step, offset, np.frombuffer(body[at + 8 : at + 8 + 8 * self.lanes], "<u8")))
            at += 8 + 8 * self.lanes
        self.words = np.frombuffer(body[at : at + 4 * n_words], "<u4")

    def part(self, k: int) -> np.ndarray:
        """The symbols from checkpoint k up to the next one."""
        step, at, held = self.marks[k]
        last = self.marks[k + 1][0] if k + 1 < len(self.marks) else self.steps
        table, lanes, states = self.table, self.lanes, held.astype(_U)
        slots, bits, mask = table.slots, _U(table.bits), _U((1 << table.bits) - 1)
        begin, end = step * lanes, min(self.n, last * lanes)
        out = np.empty(end - begin, np.uint32)
        for s in range(step, last):
            lo, hi = s * lanes, min(self.n, (s + 1) * lanes)
            x = states[: hi - lo]
            slot = x & mask
            symbol = slots[slot.view(np.int64)]
            out[lo - begin : hi - begin] = symbol
            x = table._f[symbol] * (x >> bits) + slot - table._c[symbol]
            low = np.flatnonzero(x < _LOW)
            x[low] = (x[low] << _WORD) | self.words[at : at + len(low)]
            at += len(low)
            states[: hi - lo] = x
        return out

    def symbols(self) -> np.ndarray:
        """All symbols, checked against their checksum."""
        out = np.concatenate([self.part(k) for k in range(len(self.marks))])
        if checksum(out) != self.crc_symbols:
            raise BadBlock("the symbols differ from those encoded")
        return out
