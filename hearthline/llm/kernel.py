"""Vectorised text primitives over Arrow batches: words, word hashes and shingle hashes in numpy.

All work is on the UTF-8 bytes of a batch, whole texts at a time; a text is never cut short. Bytes
are hashed in blocks of at most ``BLOCK`` so the temporaries stay small however long a text is.
"""

from __future__ import annotations

import contextlib
import ctypes
from functools import lru_cache

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
_U = np.uint64


def fmix(x: np.ndarray) -> np.ndarray:
    """The public 64-bit murmur finaliser."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64, and of its inverse."""
    base = 0x9E3779B97F4A7C15 | 1
    inverse = pow(base, -1, 1 << 64)
    up, down = np.full(BLOCK + 1, base, np.uint64), np.full(BLOCK + 1, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


@lru_cache(maxsize=2)
def _byte_values(lower: bool) -> np.ndarray:
    """A 64-bit value for each byte, alike for A-Z and a-z where ``lower``."""
    code = np.arange(256, dtype=np.uint64)
    if lower:
        code[65:91] += _U(32)
    return fmix(code + _U(0x1234567))


def tidy(body):
    """``body``, a function of batches, that hands freed memory back to the system at its end: the worker stays for later tasks."""

    def run(batches):
        try:
            yield from body(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # only glibc has it
                ctypes.CDLL(None).malloc_trim(0)

    return run


def class_table(excluded) -> np.ndarray:
    """A 256-entry table that is true for word bytes: all but the excluded ones."""
    table = np.ones(256, bool)
    table[list(excluded)] = False
    return table


# The byte classes that separate words in the contracts.
WHITE = class_table([0x20, *range(0x09, 0x0E)])
ALNUM = class_table([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0) of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        column = column.cast(pa.large_binary())
    elif pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, 8 * column.offset)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def find_words(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) bytes of every word and, per text, the place of its first word (one entry more than texts)."""
    inside = table[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offsets[1:-1]
    edges = edges[edges < len(raw)]
    first[edges] = inside[edges]
    starts = np.flatnonzero(first)
    last = inside
    last[:-1] &= ~table[raw[1:]] if len(raw) else True
    back = edges[edges > 0] - 1
    last[back] = table[raw[back]]
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash per word: polynomial over byte values, then mixed with the length."""
    out = np.empty(len(starts), np.uint64)
    values = _byte_values(lower)
    up, down = _powers()
    k = 0
    while k < len(starts):
        begin = starts[k]
        stop = int(np.searchsorted(ends, begin + BLOCK, "right"))
        if stop <= k:  # one word longer than a block: fold its blocks
            out[k] = _long_word(raw[starts[k] : ends[k]], values)
            k += 1
            continue
        piece = raw[begin : ends[stop - 1]]
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(values[piece] * up[: len(piece)], out=sums[1:])
        a, b = starts[k:stop] - begin, ends[k:stop] - begin
        out[k:stop] = fmix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64) * _U(0x9FB21C651E98DF25))
        k = stop
    return out


def _long_word(word: np.ndarray, values: np.ndarray) -> np.uint64:
    up, _ = _powers()
    total, scale = 0, 1
    for at in range(0, len(word), BLOCK):
        part = word[at : at + BLOCK]
        total += int((values[part] * up[: len(part)]).sum(dtype=np.uint64)) * scale
        scale = scale * int(up[BLOCK]) % (1 << 64)
    mixed = (total + len(word) * 0x9FB21C651E98DF25) % (1 << 64)
    return fmix(np.array([mixed], np.uint64))[0]


def combine(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` consecutive words from each place (places too near the end are left out)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(size):
        factor = (0xD6E8FEB86659FD93 * (2 * k + 1)) % (1 << 64) | 1
        part = hashes[k : n + k] + _U((k + 1) * 0x632BE59BD9B4E019 % (1 << 64))
        part ^= part >> _U(29)
        total += part * _U(factor)
        total ^= total >> _U(31)
        total *= _U(0x9E3779B97F4A7C15)
    return fmix(total)


def slices(offsets: np.ndarray, most: int = 4 * BLOCK):
    """(from, to) runs of texts with about ``most`` bytes each; a longer text is a run of its own."""
    k, n = 0, len(offsets) - 1
    while k < n:
        stop = max(k + 1, int(np.searchsorted(offsets, offsets[k] + most, "right")) - 1)
        yield k, min(stop, n)
        k = min(stop, n)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The integers of all [start, start + length) one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) - np.repeat(ends - lengths, lengths) + np.repeat(starts, lengths)
