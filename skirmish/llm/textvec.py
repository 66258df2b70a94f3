"""Tokens and 64-bit hashes of Arrow string columns, computed with numpy on the UTF-8 bytes.

Every separator of the word classes in use is one ASCII byte, and such bytes never occur inside
a longer UTF-8 sequence, so splitting the bytes is the same as splitting the characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
CHUNK = 1 << 21
BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def byte_set(members) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(members)] = True
    return table


BLANKS = byte_set([0x20, *range(0x09, 0x0E)])
NON_WORD = byte_set([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
NEWLINE = byte_set([0x0A])
SAME = np.arange(256, dtype=np.uint8)
LOWER = np.where((SAME >= 65) & (SAME <= 90), SAME + 32, SAME).astype(np.uint8)


def chunks(column: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, starts): consecutive rows of about `size` bytes, at least one row each.

    starts has one entry more than there are rows. Null is an empty text.
    """
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def tokens(data: np.ndarray, starts: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and row of each maximal run of bytes that aren't separators; none spans two rows."""
    n = len(data)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    word = ~separators[data]
    begin, last = word.copy(), word.copy()
    begin[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    first = starts[:-1][starts[:-1] < n]
    begin[first] = word[first]
    final = starts[1:][starts[1:] > 0] - 1
    last[final] = word[final]
    begins = np.flatnonzero(begin)
    return begins, np.flatnonzero(last) + 1, np.searchsorted(starts, begins, "right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64: a bijection of 64-bit values."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_powers: list[np.ndarray] = []


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        n = max(n, BLOCK + 4096)
        with np.errstate(over="ignore"):
            _powers[:] = [np.cumprod(np.concatenate([np.ones(1, U64), np.full(n - 1, base, U64)])) for base in (_BASE, _BASE_INVERSE)]
    return _powers[0], _powers[1]


def span_hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes; spans are in order and don't overlap. Works in blocks of bytes."""
    out = np.zeros(len(begins), U64)
    at = 0
    while at < len(begins):
        to = max(at + 1, int(np.searchsorted(ends, begins[at] + BLOCK, "right")))
        low, b, e = begins[at], begins[at:to] - begins[at], ends[at:to] - begins[at]
        part = data[low : ends[to - 1]]
        power, inverse = _tables(len(part))
        sums = np.zeros(len(part) + 1, U64)
        np.cumsum((part.astype(U64) + U64(1)) * power[: len(part)], out=sums[1:])
        out[at:to] = (sums[e] - sums[b]) * inverse[b] + (e - b).astype(U64) * U64(0xD6E8FEB86659FD93)
        at = to
    return mix(out)


def windows(hashes: np.ndarray, rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first token of each run of `width` tokens inside one row."""
    count = len(hashes) - width + 1
    if count <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    first = np.flatnonzero(rows[:count] == rows[width - 1 :])
    total = np.zeros(len(first), U64)
    for k in range(width):
        total = mix(total * U64(0xA0761D6478BD642F) + hashes[first + k])
    return total, first


def per_row(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of per-byte values by row."""
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return sums[starts[1:]] - sums[starts[:-1]]
