"""Vectorised work on UTF-8 text columns, used inside Arrow tasks.

Texts are taken as the raw bytes of an Arrow column, so that splitting into words and
rolling hashes run over whole batches. A word's hash is a sum of mixed 64-bit values, one
for each byte at its place, so equal sums of different words are no more likely than with
random values. Windows of words have Rabin-Karp hashes: polynomials of the words' hashes
modulo the prime 2^61 - 1 at a fixed random base. For n different windows of k words a
wrong match has a chance of about k n^2 / 2^62; where that is too much, the hashes at a
second base are taken as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTES = np.random.default_rng(20240501).integers(0, 2**64, 256, dtype=_U)
_FOLDED = _BYTES.copy()
_FOLDED[65:91] = _BYTES[97:123]
_PLACE, _LENGTH = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F)
#: The modulus of windows, and the bases of their polynomials.
PRIME = (1 << 61) - 1
BASES = (0x0C3A5C85C97CB312, 0x14F2B6A1D9E3780B)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (null: empty) and the offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):  # several chunks are kept where they don't fit one
        column = pa.concat_arrays(column.chunks)
    column = pc.fill_null(column, "").cast(pa.large_string()) if column.null_count else column.cast(pa.large_string())
    _, at, data = column.buffers()
    if at is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def blocks(offsets: np.ndarray, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of rows with about ``size`` bytes, one row at least."""
    low, n = 0, len(offsets) - 1
    while low < n:
        high = int(np.searchsorted(offsets, offsets[low] + size, "right")) - 1
        high = min(n, max(high, low + 1))
        yield low, high
        low = high


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of marked bytes that don't cross rows: starts, ends, and the runs before each row."""
    if not len(inside):
        zero = np.zeros(0, np.int64)
        return zero, zero, np.zeros(len(offsets), np.int64)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = offsets[(offsets > 0) & (offsets < len(inside))]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of bytes other than space and tab to carriage return."""
    return runs(~_SPACE[raw], offsets)


def folded(raw: np.ndarray) -> np.ndarray:
    """The bytes with Latin letters with marks in small letters: their second byte differs by 32."""
    out = raw.copy()
    if len(raw) > 1:
        large = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)
        out[1:][large] += 32
    return out


def sums(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of the values of the bytes of disjoint spans, and where in them each span begins.

    ``total[first + k] - total[first]`` belongs to the first k bytes of a span.
    """
    size = ends - starts
    first = np.cumsum(size) - size
    n = int(size.sum())
    place = np.arange(n)
    value = (_FOLDED if fold else _BYTES)[raw[place + np.repeat(starts - first, size)]]
    place -= np.repeat(first, size)
    value += place.view(_U) * _PLACE
    total = np.zeros(n + 1, _U)
    np.cumsum(mix(value), out=total[1:])
    return total, first


def sealed(total: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    """Hashes of spans of so many bytes from the sums of their values."""
    return mix(total + np.asarray(size).astype(_U) * _LENGTH)


def hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
    """A hash of the bytes of each of several disjoint spans; ``fold``: A-Z count as a-z."""
    total, first = sums(raw, starts, ends, fold)
    size = ends - starts
    return sealed(total[first + size] - total[first], size)


def word_hashes(raw: np.ndarray, offsets: np.ndarray, piece: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word, and the words before each row.

    Long rows are taken in pieces cut at white space, so that memory beyond the result
    doesn't grow with them.
    """
    found, at, low, n = [], [], 0, len(raw)
    while low < n:
        high = min(n, low + piece)
        row_end = int(offsets[np.searchsorted(offsets, high)])
        while high < row_end:
            blank = np.flatnonzero(_SPACE[raw[high : high + 4096]])
            high = min(row_end, high + (int(blank[0]) if len(blank) else 4096))
            if len(blank):
                break
        inner = offsets[np.searchsorted(offsets, low, "right") : np.searchsorted(offsets, high)]
        starts, ends, _ = words(raw[low:high], np.concatenate([[0], inner - low, [high - low]]))
        found.append(hashes(raw[low:high], starts, ends))
        at.append(starts + low)
        low = high
    if not found:
        return np.zeros(0, _U), np.zeros(len(offsets), np.int64)
    return np.concatenate(found), np.searchsorted(np.concatenate(at), offsets)


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & _U(PRIME)) + (x >> _U(61))
    return np.minimum(x, x - _U(PRIME))  # what is below the prime wraps round to more


def _times(a: np.ndarray, c: int) -> np.ndarray:
    """a * c modulo 2^61 - 1, by halves of 31 bits, not yet reduced (below 2^63 + 2^62)."""
    half = _U((1 << 31) - 1)
    c_high, c_low = _U(c >> 31), _U(c & ((1 << 31) - 1))
    high, low = a >> _U(31), a & half
    middle = high * c_low + low * c_high
    high *= c_high << _U(1)
    low *= c_low
    low += high
    low += middle >> _U(30)
    low += (middle & _U((1 << 30) - 1)) << _U(31)
    return low


def rolled(h: np.ndarray, k: int, base: int) -> np.ndarray:
    """The polynomial of each k consecutive values: h[0] b^(k-1) + ... + h[k-1] modulo 2^61 - 1."""
    step = max(1 << 14, 4 * k)
    parts = [_rolled(h[low : low + step + k - 1], k, base) for low in range(0, len(h) - k + 1, step)]
    return np.concatenate(parts) if parts else np.zeros(0, _U)


def _rolled(h: np.ndarray, k: int, base: int) -> np.ndarray:
    """Polynomials of 1, 2, 4, ... values are made from each other, and put together to k."""
    part = _reduced(h)
    out, done, size = None, 0, 1
    while True:
        if k & size:
            if out is None:
                out, done = part, size
            else:
                n = len(h) - done - size + 1
                out = _reduced(_reduced(_times(part[:n], pow(base, done, PRIME))) + out[size : size + n])
                done += size
        if 2 * size > k:
            return out
        n = len(part) - size
        part = _reduced(_reduced(_times(part[:n], pow(base, size, PRIME))) + part[size:])
        size *= 2


def fitting(before: np.ndarray, k: int) -> np.ndarray:
    """Where windows of k items start that don't leave their row."""
    n = int(before[-1])
    if n < k:
        return np.zeros(0, np.int64)
    fits = np.ones(n - k + 1, bool)
    for back in range(1, k):
        late = before[1:] - back
        late = late[(late >= before[:-1]) & (late < len(fits))]
        fits[late] = False
    return np.flatnonzero(fits)


def windows(h: np.ndarray, before: np.ndarray, k: int, base: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Rabin-Karp hashes of all k consecutive items of one row: where they start, and the hashes, spread over 64 bits."""
    at = fitting(before, k)
    if not len(at):
        return at, np.zeros(0, _U)
    return at, mix(rolled(h, k, BASES[base])[at])


def row_of(at: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The row that each item belongs to."""
    return np.searchsorted(before, at, "right") - 1
