"""Vectorised words and hashes over Arrow string columns.

Words are the runs of bytes outside space and ``\\t\\n\\v\\f\\r``; these bytes are ASCII, so
cutting the UTF-8 bytes cuts the same words as the code-point pattern ``[^\\x20\\x09-\\x0D]+``.
A word's 64-bit hash chains its 8-byte blocks through an avalanche that is one-to-one, so words of
one length of at most 8 bytes never collide; words beyond ``LONG_WORD`` bytes are hashed by BLAKE2. Runs of
words are hashed by joining the hashes of shorter runs through the same avalanche. Nothing here is a polynomial,
so texts of regular structure collide no more often than any others. Work goes in pieces of about one
megabyte, so memory does not grow with a batch.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
LONG_WORD = 64
U = np.uint64
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: What stays of an 8-byte block of which only so many bytes belong to the word.
OWN = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=U)


def mix(x):
    """Avalanche of uint64 values, one to one, in place on a fresh array."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def join(a, b):
    """Hash of two neighbouring runs from theirs."""
    return mix(a * U(0xA0761D6478BD642F) + b)


def runs(values, k: int):
    """Hashes of every run of ``k`` neighbouring values, by doubling."""
    out, size, power = None, 0, [values]
    while 2 << len(power) - 1 <= k:
        half, p = 1 << len(power) - 1, power[-1]
        power.append(join(p[:-half], p[half:]) if len(p) > half else p[:0])
    for bit in reversed(range(len(power))):
        if k >> bit & 1:
            if out is None:
                out = power[bit]
            else:
                n = max(0, len(values) - size - (1 << bit) + 1)
                out = join(out[:n], power[bit][size : size + n])
            size += 1 << bit
    return out if k > 1 else mix(values)


def column_bytes(column):
    """(bytes, offsets) of an Arrow string or binary array; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    _, off, data = column.buffers()
    if len(column) == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(off, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets, limit: int = PIECE):
    """Ranges of rows whose bytes stay below ``limit`` (a longer row stands alone)."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield lo, hi
        lo = hi


def find_words(data, offsets, space=SPACE):
    """Starts and ends of all words, and the index of each row's first word (one more at the end)."""
    n = len(data)
    solid = ~space[data]
    begin, close = solid.copy(), solid.copy()
    if n:
        begin[1:] &= ~solid[:-1]
        close[:-1] &= ~solid[1:]
        at = offsets[offsets < n]
        begin[at] = solid[at]
        at = offsets[offsets > 0] - 1
        close[at] = solid[at]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(close) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def blocks(data):
    """The 8 bytes that begin at every place of ``data`` (zeros beyond its end), as little-endian uint64."""
    wide = np.zeros(len(data) + 8, dtype=np.uint8)
    wide[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", wide, strides=(1,))


def hash_words(data, starts, ends):
    """64-bit hash of each word."""
    size = ends - starts
    eight = blocks(data)
    out = mix((eight[starts] & OWN[np.minimum(size, 8)]) + size.astype(U) * U(0xD6E8FEB86659FD93))
    live = np.flatnonzero(size > 8)
    for at in range(8, LONG_WORD, 8):
        if not len(live):
            break
        out[live] = mix(out[live] ^ (eight[starts[live] + at] & OWN[np.minimum(size[live] - at, 8)]))
        live = live[size[live] > at + 8]
    for i in np.flatnonzero(size > LONG_WORD):
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return out


def same_bytes(data, a, b, size):
    """Whether the ``size`` bytes from each place of ``a`` equal those from ``b``."""
    out = np.ones(len(a), dtype=bool)
    eight, live, at = blocks(data), np.flatnonzero((a != b) & (size > 0)), 0
    while len(live) and at < LONG_WORD:
        own = OWN[np.minimum(size[live] - at, 8)]
        out[live] &= (eight[a[live] + at] & own) == (eight[b[live] + at] & own)
        at += 8
        live = live[size[live] > at]
    for i in live[out[live]]:
        out[i] = np.array_equal(data[a[i] : a[i] + size[i]], data[b[i] : b[i] + size[i]])
    return out


def sliding_argmin(values, width: int):
    """Index of the least value in each window of ``width``; the rightmost one on ties."""
    index = np.arange(len(values))

    def step(val, idx, d):
        right = val[d:] <= val[:-d]
        return np.where(right, val[d:], val[:-d]), np.where(right, idx[d:], idx[:-d])

    val, reach = values, 1
    while reach * 2 <= width:
        val, index = step(val, index, reach)
        reach *= 2
    if reach < width:
        val, index = step(val, index, width - reach)
    return index


def shingles(values, first, k: int):
    """Hashes of the k-word shingles of each row and the index of each row's first shingle.

    A row of 1 to k-1 words has one shingle, all its words; a row without words has none.
    ``values`` are the rows' word hashes, ``first`` the rows' first words.
    """
    n = np.diff(first)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
    begin = np.zeros(len(count) + 1, dtype=np.int64)
    np.cumsum(count, out=begin[1:])
    lo = np.repeat(first[:-1] - begin[:-1], count) + np.arange(begin[-1])
    every = runs(values, k)
    out = np.zeros(len(lo), dtype=U)
    whole = np.repeat(n >= k, count)
    out[whole] = every[lo[whole]]
    for size in range(1, k):
        short = np.flatnonzero(n == size)
        if len(short):
            own = values[first[short][:, None] + np.arange(size)]
            h = np.full(len(short), size, dtype=U)
            for column in own.T:
                h = join(h, column)
            out[begin[short]] = h
    return out, begin


def row_shingles(data, offsets, k: int):
    """``shingles`` straight from bytes and row offsets."""
    starts, ends, first = find_words(data, offsets)
    return shingles(hash_words(data, starts, ends), first, k)


def sorted_sets(values, begin):
    """Each row's values sorted without repeats, and where each row begins."""
    row = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    order = np.lexsort((values, row))
    values, row = values[order], row[order]
    keep = np.ones(len(values), dtype=bool)
    keep[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
    values, row = values[keep], row[keep]
    return values, np.searchsorted(row, np.arange(len(begin)))
