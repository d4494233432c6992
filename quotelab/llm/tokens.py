"""Vectorised word and window hashing over the UTF-8 bytes of Arrow string columns.

Everything here works on one Arrow batch inside a task: the bytes of all its texts are one numpy
array, words are runs of word bytes, and a word or window is known by a 64-bit hash.  Texts are never
decoded and no loop runs over words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text that are worked on at once; a longer text is a piece of its own.
PIECE_BYTES = 512 << 10


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (a bijection): spreads every input bit over the whole word."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


#: One random odd number for each byte value, and the odd base of the polynomial in a word's bytes.
BYTE_VALUE = mixed(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)
BYTE_BASE = U64(0xD6E8FEB86659FD93)
WORD_BASE = U64(0xA0761D6478BD642F)


def powers(base: np.uint64, n: int) -> np.ndarray:
    """``base ** 0 ... base ** (n - 1)`` modulo 2**64."""
    out = np.full(max(n, 1), base, U64)
    out[0] = 1
    return np.multiply.accumulate(out)


def lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def alphanumeric_bytes() -> np.ndarray:
    """Bytes of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` (digits, a-z, everything outside ASCII)."""
    table = np.ones(256, bool)
    table[0x00:0x30] = table[0x3A:0x61] = table[0x7B:0x80] = False
    return table


def nonspace_bytes() -> np.ndarray:
    """Bytes of ``[^\\x20\\x09-\\x0D]``."""
    table = np.ones(256, bool)
    table[0x20] = table[0x09:0x0E] = False
    return table


@dataclass
class Words:
    """Words of consecutive documents: ``first[d]:first[d + 1]`` are those of document ``d``."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    data: np.ndarray


def pieces(column: pa.Array, size: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices ``(from, to, bytes, offsets)`` of a string column, each of about ``size`` bytes.

    ``offsets`` has one entry more than the slice has rows and starts at 0; a null text has no bytes.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        kind = np.int32
    else:
        column, kind = column.cast(pa.large_binary()), np.int64
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    start = 0
    while start < n:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + size, "right")) - 1)
        stop = min(stop, n)
        yield start, stop, data[offsets[start] : offsets[stop]], offsets[start : stop + 1] - offsets[start]
        start = stop


def words_of(
    data: np.ndarray, offsets: np.ndarray, word_byte: np.ndarray, lower: bool = False, cut: np.ndarray | None = None
) -> Words:
    """Words (maximal runs of ``word_byte`` bytes, never across documents) with their hashes.

    ``cut`` marks bytes at which a word ends and another begins.
    """
    if lower:
        data = lower_table()[data]
    inside = word_byte[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[heads] |= inside[heads]
    if cut is not None:
        begins |= cut & inside
    starts = np.flatnonzero(begins)
    stops = np.zeros(len(data) + 1, bool)
    stops[1:] = inside
    stops[1:-1] &= ~inside[1:] | begins[1:]
    ends = np.flatnonzero(stops)
    first = np.searchsorted(starts, offsets)
    if not len(starts):
        return Words(np.zeros(0, U64), starts, ends, first, data)
    where = np.flatnonzero(inside)
    lengths = ends - starts
    inner = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    values = BYTE_VALUE[data[where]]
    values *= powers(BYTE_BASE, int(lengths.max()))[np.arange(len(where)) - np.repeat(inner, lengths)]
    hashes = mixed(np.add.reduceat(values, inner) + lengths.astype(U64))
    return Words(hashes, starts, ends, first, data)


def window_hashes(values: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all ``k`` consecutive values (``len(values) - k + 1`` of them, document ends ignored)."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    scale = powers(WORD_BASE, k)
    total = np.zeros(n, U64)
    for i in range(k) if k <= 8 else ():
        total += values[i : i + n] * scale[i]
    if k > 8:  # doubling: hashes of 1, 2, 4, ... values, put together by the bits of k
        block, width, done = values.copy(), 1, 0
        while width <= k:
            if k & width:
                total += block[done : done + n] * scale[done]
                done += width
            if 2 * width <= k:
                block = block[:-width] + block[width:] * scale[width]
            width *= 2
    return mixed(total)


def whole_windows(first: np.ndarray, k: int, total: int) -> np.ndarray:
    """Whether the ``k`` words from each position lie in one document (one entry per window)."""
    n = max(0, total - k + 1)
    good = np.ones(n, bool)
    for d in range(1, k):  # a window that starts d words before a document's first word crosses it
        at = first[1:-1] - d
        good[at[(at >= 0) & (at < n)]] = False
    return good


def sliding_minimum(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each ``w`` consecutive values, by doubling."""
    n = len(values) - w + 1
    if n <= 0:
        return values[:0]
    out, width = values, 1
    while 2 * width <= w:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    return np.minimum(out[:n], out[w - width : w - width + n])


def winnowed(hashes: np.ndarray, w: int) -> np.ndarray:
    """Marks every value that is the minimum of some ``w`` consecutive ones (all ties are kept)."""
    low = sliding_minimum(hashes, w)
    if not len(low):
        return np.zeros(len(hashes), bool)
    padded = np.concatenate((np.zeros(w - 1, U64), low, np.zeros(w - 1, U64)))
    # A value is kept when it equals the largest of the window minima that it takes part in.
    return hashes == ~sliding_minimum(~padded, w)


def documents_of(first: np.ndarray) -> np.ndarray:
    """Document number of each word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))
