"""Numpy kernels that cut UTF-8 text into words and hash them, a chunk of documents at a time.

All functions work on the raw buffers of an Arrow string column, so no Python string is made for a
document. Memory is bounded by SEGMENT bytes of text at a time; a longer document is cut at word
boundaries and its word arrays are put together again, so its whole text is always covered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _byte_class(is_word) -> np.ndarray:
    return np.array([is_word(b) for b in range(256)], dtype=bool)


#: Bytes of words: all but white space (0x20, 0x09-0x0D).
NON_SPACE = _byte_class(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
#: Bytes of words: ASCII digits and letters, and all of every character beyond ASCII.
ALNUM = _byte_class(lambda b: 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80)
_LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(SEGMENT, 1 << max(1, (n - 1).bit_length()))
    if size not in _powers:
        if size > SEGMENT:
            _powers.pop(max(_powers, default=SEGMENT) if max(_powers, default=0) > SEGMENT else -1, None)
        up, down = np.full(size, _BASE, np.uint64), np.full(size, _INVERSE, np.uint64)
        up[0] = down[0] = 1
        _powers[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers[size]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit words whose bits are all well mixed."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column; a null has no bytes."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return at, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def _segment_words(part: np.ndarray, doc_at: np.ndarray, word_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of a few documents that lie one after another."""
    low = _LOWER[part]
    inside = word_bytes[part]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    full = doc_at[:-1] < doc_at[1:]
    first, last = doc_at[:-1][full], doc_at[1:][full] - 1
    begins[first] = inside[first]
    ends[last] = inside[last]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    up, down = _power_tables(len(part))
    summed = np.zeros(len(part) + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=summed[1:])
    hashes = (summed[stops] - summed[starts]) * down[starts]
    return starts, stops, mix(hashes)


def words_of(column: pa.Array, word_bytes: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Yields (first row, row after the last, word_at, starts, stops, hashes) for runs of rows.

    Words of row i are word_at[i - first] to word_at[i - first + 1]; starts and stops are byte offsets
    into the column's data buffer. A-Z are hashed as a-z.
    """
    at, data = text_buffers(column)
    n, row = len(at) - 1, 0
    while row < n:
        stop = max(row + 1, int(np.searchsorted(at, at[row] + SEGMENT, side="right")) - 1)
        lo, hi = int(at[row]), int(at[stop])
        if hi - lo <= SEGMENT:
            starts, stops, hashes = _segment_words(data[lo:hi], at[row : stop + 1] - lo, word_bytes)
            word_at = np.searchsorted(starts, at[row : stop + 1] - lo)
            yield row, stop, word_at, starts + lo, stops + lo, hashes
        else:
            parts, here = [], lo
            while here < hi:
                end = min(here + SEGMENT, hi)
                while end < hi and word_bytes[data[end]] and word_bytes[data[end - 1]]:
                    ahead = np.flatnonzero(~word_bytes[data[end : end + SEGMENT]])
                    end = end + int(ahead[0]) if len(ahead) else min(end + SEGMENT, hi)
                s, e, h = _segment_words(data[here:end], np.array([0, end - here]), word_bytes)
                parts.append((s + here, e + here, h))
                here = end
            starts, stops, hashes = (np.concatenate(x) for x in zip(*parts))
            yield row, stop, np.array([0, len(starts)]), starts, stops, hashes
        row = stop


_TURN = np.array([pow(0xD6E8FEB86659FD93 | 1, i + 1, 1 << 64) for i in range(64)], np.uint64)


def gram_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of width words; the hash depends on their order."""
    if len(hashes) < width:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(hashes) - width + 1, np.uint64)
    for i in range(width):
        total += hashes[i : len(hashes) - width + 1 + i] * _TURN[i]
    return mix(total)
