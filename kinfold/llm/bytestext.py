"""Vectorised access to the UTF-8 bytes of Arrow text columns, and word hashes over them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes hashed at once; every array below is a small multiple of this.
PIECE = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, PIECE + 64), base, U64)
        steps[0] = 1
        have = _powers[base] = np.cumprod(steps)
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit generator: every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(bytes, offsets)`` of a string or binary array; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def row_blocks(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``most`` bytes together; a longer row stands alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(n, max(last, first + 1))
        yield first, last
        first = last


def _piece_words(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words of ``data``; words also end at each of ``breaks``."""
    word = ~SPACE[data]
    start = word.copy()
    start[1:] &= ~word[:-1]
    end = word.copy()
    end[:-1] &= ~word[1:]
    inner = breaks[(breaks > 0) & (breaks < len(data))]
    start[inner] = word[inner]
    end[inner - 1] = word[inner - 1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum((LOWER[data].astype(U64) + U64(1)) * powers(BASE, len(data))[: len(data)], out=sums[1:])
    h = (sums[e] - sums[s]) * powers(INVERSE, len(data))[s]
    return s, mix(h + (e - s).astype(U64) * U64(0xD6E8FEB86659FD93))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased, and each row's word offsets.

    Works through pieces cut at white space or between rows, so that memory stays bounded for any length of row.
    """
    starts, hashes, at = [], [], 0
    while at < len(data):
        to = min(len(data), at + PIECE)
        if to < len(data):
            row_end = offsets[np.searchsorted(offsets, to, "right") - 1]
            if row_end > at:
                to = int(row_end)
            else:
                while True:
                    gaps = np.flatnonzero(SPACE[data[at:to]])
                    if len(gaps):
                        to = at + int(gaps[-1]) + 1
                        break
                    nxt = int(offsets[np.searchsorted(offsets, at, "right")])
                    if to >= nxt or to >= len(data):
                        to = min(nxt, len(data))
                        break
                    to = min(nxt, to + PIECE)
        lo, hi = np.searchsorted(offsets, [at, to])
        s, h = _piece_words(data[at:to], offsets[lo:hi] - at)
        starts.append(s + at)
        hashes.append(h)
        at = to
    s = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    h = np.concatenate(hashes) if hashes else np.zeros(0, U64)
    return h, np.searchsorted(s, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """Per row the sorted distinct hashes of its word ``width``-grams; a row of fewer words has its whole sequence
    as one, a row without words none."""
    h, at = word_hashes(data, offsets)
    full = np.zeros(0, U64)
    if len(h) >= width:
        n = len(h) - width + 1
        full = h[:n].copy()
        for k in range(1, width):
            full = full * U64(BASE) + h[k : k + n]
        full = mix(full)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= width:
            yield np.unique(full[a : b - width + 1])
        elif b > a:
            short = U64(b - a)
            for x in h[a:b]:
                short = U64((int(short) * BASE + int(x)) & (2**64 - 1))
            yield mix(np.array([short], U64) ^ U64(0x5851F42D4C957F2D))
        else:
            yield full[:0]
