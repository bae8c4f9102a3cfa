"""Vectorised access to the UTF-8 bytes and words of an Arrow text column.

A word is a run of bytes other than space and the control characters 9 to 13. All
functions work on a *chunk*: the concatenated bytes of several texts with their offsets,
so that the cost is a few numpy passes over the bytes and nothing per row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

CHUNK_BYTES = 1 << 20

_WORD = np.ones(256, dtype=bool)
_WORD[[9, 10, 11, 12, 13, 32]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_CODE = np.random.default_rng(0x5EED).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (splitmix64's finaliser)."""
    x = np.asarray(x, dtype=np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_column(column: pa.Array) -> pa.Array:
    """The column as 64-bit-offset strings without nulls (null: empty)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string())
    return column.fill_null("") if column.null_count else column


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of rows of about ``limit`` bytes.

    A single longer text makes a chunk of its own; texts are never cut.
    """
    column = text_column(column)
    if not len(column):
        return
    _, offset_buffer, data = column.buffers()
    offsets = np.frombuffer(offset_buffer, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    low = 0
    while low < len(column):
        high = int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1
        high = min(max(high, low + 1), len(column))
        yield low, high, raw[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct values as they appear, where each appears first, which one each value is); by hashing, not sorting."""
    which, unique = pd.factorize(values)
    first = np.empty(len(unique), np.int64)
    first[which[::-1]] = np.arange(len(values) - 1, -1, -1)
    return unique, first, which


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text index) of every word of a chunk."""
    size = len(raw)
    if not size:
        empty = np.empty(0, np.int64)
        return empty, empty, empty
    inside = _WORD[raw]
    before = np.empty(size, bool)
    before[0], before[1:] = False, inside[:-1]
    after = np.empty(size, bool)
    after[-1], after[:-1] = False, inside[1:]
    first, last = offsets[:-1], offsets[1:] - 1
    before[first[first < size]] = False
    after[last[last >= 0]] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def eights(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number (zeros behind the end); a view, nothing is copied eightfold."""
    padded = np.zeros(len(raw) + 16, np.uint8)
    padded[: len(raw)] = raw
    return np.ndarray((len(raw) + 8,), "<u8", padded, 0, (1,))


#: What remains of eight bytes when only the first so many count.
_FIRST = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
_SEED = np.uint64(0xA0761D6478BD642F)


def span_hash(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of the bytes of each span.

    Eight bytes at a time are scrambled, and the scrambled numbers of a span are combined two
    by two in a tree; this is no polynomial, so no family of strings is known to collide. What
    must be right at any size also compares the bytes, see ``equal_spans``.
    """
    if not len(starts):
        return np.empty(0, np.uint64)
    lengths = ends - starts
    view = eights(_LOWER[raw] if lower else raw)
    out = mix((view[starts] & _FIRST[np.minimum(lengths, 8)]) ^ _SEED)
    at = np.flatnonzero(lengths > 8)
    if len(at):
        counts = (lengths[at] + 7) // 8
        heads = np.cumsum(counts) - counts
        place = np.arange(int(counts.sum())) - np.repeat(heads, counts)
        value = mix((view[np.repeat(starts[at], counts) + 8 * place] & _FIRST[np.minimum(np.repeat(lengths[at], counts) - 8 * place, 8)]) ^ _SEED)
        while len(at):  # only spans of more than one number are left
            half = (counts + 1) // 2
            after = np.cumsum(half) - half
            left = np.repeat(heads - 2 * after, half) + 2 * np.arange(int(half.sum()))
            paired = left + 1 < np.repeat(heads + counts, half)
            value = mix(mix(value[left] + _STEP) + np.where(paired, value[np.minimum(left + 1, len(value) - 1)], np.uint64(0)))
            whole = half == 1
            out[at[whole]] = value[after[whole]]
            at, counts, heads = at[~whole], half[~whole], after[~whole]
    return mix(out + lengths.astype(np.uint64) * _STEP)


def equal_spans(left: np.ndarray, a: np.ndarray, right: np.ndarray, b: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether the spans at ``a`` and ``b`` of two texts hold the same bytes; both are given as ``eights``."""
    same = (left[a] ^ right[b]) & _FIRST[np.minimum(lengths, 8)] == 0
    long = np.flatnonzero(same & (lengths > 8))
    if len(long):
        counts = (lengths[long] - 1) // 8
        heads = np.cumsum(counts) - counts
        place = 8 * (np.arange(int(counts.sum())) - np.repeat(heads, counts) + 1)
        differs = (left[np.repeat(a[long], counts) + place] ^ right[np.repeat(b[long], counts) + place]) & _FIRST[np.minimum(np.repeat(lengths[long], counts) - place, 8)] != 0
        same[long] = np.add.reduceat(differs, heads) == 0
    return same


def span_ids(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which distinct string each span is, a first span of each distinct string), by bytes.

    Hashes bring equal spans together; every span is then compared with the one that
    stands for it, and those that differ in spite of an equal hash are told apart by their bytes.
    """
    _, first, which = distinct(span_hash(raw, starts, ends))
    if not len(starts):
        return which, first
    stands = first[which]
    lengths = ends - starts
    view = eights(raw)
    odd = np.flatnonzero((lengths != lengths[stands]) | ~equal_spans(view, starts, view, starts[stands], np.minimum(lengths, lengths[stands])))
    if len(odd):
        known: dict[tuple[int, bytes], int] = {}
        more = []
        for i in odd.tolist():
            key = (int(which[i]), raw[starts[i] : ends[i]].tobytes())
            if key not in known:
                known[key] = len(first) + len(more)
                more.append(i)
            which[i] = known[key]
        first = np.concatenate([first, np.array(more, np.int64)])
    return which, first


def by_text_and_value(text: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The order by text, then value; texts are in order already."""
    if not len(text) or int(text[-1]) >= 1 << 16:
        return np.lexsort((value, text))
    order = np.argsort(value)
    return order[np.argsort(text[order].astype(np.uint16), kind="stable")]


_POWERS: dict[str, np.ndarray] = {}


def powers(count: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of an odd base modulo 2**64, and of its inverse."""
    if not _POWERS or len(_POWERS["up"]) < count:
        for name, base in (("up", int(_STEP)), ("down", pow(int(_STEP), -1, 2**64))):
            row = np.full(count, base, np.uint64)
            row[0] = 1
            _POWERS[name] = np.cumprod(row, dtype=np.uint64)
    return _POWERS["up"][:count], _POWERS["down"][:count]


def prefix_hash(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums, inverse powers): bytes a to b have the hash ``(sums[b] - sums[a]) * inverse[a]`` wherever they stand.

    A polynomial modulo 2**64: different strings of a thousand bytes can be built that collide.
    It only brings candidates together; equality is never concluded from it.
    """
    up, down = powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE_CODE[raw] * up[:-1], out=sums[1:])
    return sums, down


_PRIME = (1 << 61) - 1
_BASE = 0x12345678ABCDEF5 % _PRIME  # fixed, so that tasks agree


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo 2**61 - 1 of numbers below it."""
    low, high = np.uint64((1 << 32) - 1), np.uint64(32)
    a0, a1, b0, b1 = a & low, a >> high, b & low, b >> high
    middle = a1 * b0 + a0 * b1  # below 2**62
    rest = a0 * b0
    total = (a1 * b1 << np.uint64(3)) + (middle >> np.uint64(29)) + ((middle & np.uint64((1 << 29) - 1)) << high) + (rest >> np.uint64(61)) + (rest & np.uint64(_PRIME))
    total = (total & np.uint64(_PRIME)) + (total >> np.uint64(61))
    return np.where(total >= np.uint64(_PRIME), total - np.uint64(_PRIME), total)


class PrimeSums:
    """Hashes of any stretches of some bytes, modulo the prime 2**61 - 1.

    Strings of n bytes that differ have equal hashes for at most n of the 2**61 bases.
    """

    _tables: dict[int, tuple] = {}

    def __init__(self, raw: np.ndarray):
        # Limbs of the powers, short enough that their sums stay exact.
        self.bits = 31 if len(raw) < 1 << 23 else 21
        limbs, self.down = self._powers(len(raw) + 1, self.bits)
        code = raw.astype(np.uint64) + np.uint64(1)
        self.sums = []
        for limb in limbs:
            row = np.zeros(len(raw) + 1, np.uint64)
            np.cumsum(code * limb[: len(raw)], out=row[1:])
            self.sums.append(row)

    @classmethod
    def _powers(cls, count: int, bits: int) -> tuple[list[np.ndarray], np.ndarray]:
        """(limbs of the powers of the base, powers of its inverse), at least ``count`` of each."""
        if bits not in cls._tables or len(cls._tables[bits][1]) < count:
            rows = []
            for base in (_BASE, pow(_BASE, -1, _PRIME)):
                row = np.ones(1, np.uint64)
                while len(row) < count:
                    row = np.concatenate([row, _times(row, np.uint64(pow(base, len(row), _PRIME)))])
                rows.append(row)
            mask = np.uint64((1 << bits) - 1)
            cls._tables[bits] = [rows[0] >> np.uint64(shift) & mask for shift in range(0, 61, bits)], rows[1]
        return cls._tables[bits]

    def hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        total = np.zeros(len(starts), np.uint64)
        for k, row in enumerate(self.sums):
            part = (row[ends] - row[starts]) % np.uint64(_PRIME)
            total += _times(part, np.uint64(1 << k * self.bits)) if k else part
        return _times(total % np.uint64(_PRIME), self.down[starts])


def windows_hash(words: np.ndarray, owner: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of the first word) of every run of ``width`` words within one text."""
    count = len(words) - width + 1
    if count <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    value = np.zeros(count, np.uint64)
    for j in range(width):
        value = value * _STEP + words[j : j + count]
    whole = np.flatnonzero(owner[:count] == owner[width - 1 :])
    return mix(value[whole]), whole


def per_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of a per-byte array over each text of the chunk."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]
