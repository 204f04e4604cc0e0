"""Vectorised text primitives shared by the operators of this subpackage.

Everything works on the UTF-8 bytes of an Arrow string column: no Python string is made per word. White space is the six
ASCII characters 0x20 and 0x09-0x0D, so a byte scan finds the same words as a scan of code points. A null text counts as
an empty one. Memory is a small multiple of one block (``BLOCK`` bytes, or one longer word), however long a text is.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

BLOCK = 1 << 18


def return_memory() -> None:
    """Gives freed memory back to the system. Python workers are used again by task after task, and would hold the peaks of
    all of them."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

_MULT = 0x9E3779B97F4A7C15 | 1
_MULT_INV = pow(_MULT, -1, 1 << 64)
_VALUES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True
#: Everything in ASCII but letters and digits parts words; bytes of longer code points belong to words.
IS_PUNCT = np.zeros(256, bool)
IS_PUNCT[:128] = [not chr(i).isalnum() for i in range(128)]
IS_NEWLINE = np.zeros(256, bool)
IS_NEWLINE[10] = True

_powers: list[np.ndarray] = [np.empty(0, np.uint64), np.empty(0, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, m in enumerate((_MULT, _MULT_INV)):
            steps = np.full(max(n, BLOCK), m, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Final mixing of 64-bit hashes (the published splitmix64 finaliser)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Tokens(NamedTuple):
    """Words of several rows in order. ``row_start[i]:row_start[i + 1]`` are row i's words."""

    hashes: np.ndarray
    start: np.ndarray  # byte offset in its row
    length: np.ndarray  # bytes
    row_start: np.ndarray
    prefixes: tuple[np.ndarray, ...] = ()  # hashes of the words' first bytes, as asked for


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (from 0) of a string column; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32, n + 1, column.offset * (8 if wide else 4)).astype(np.int64)
    first, last = int(offsets[0]), int(offsets[-1])
    data = np.frombuffer(buffers[2], np.uint8, last - first, first) if last > first else np.empty(0, np.uint8)
    return data, offsets - first


def batches_by_bytes(batches, column: str, limit: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Cuts record batches into runs of rows with about ``limit`` bytes of text (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_buffers(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end
    return_memory()


def _block_ends(data: np.ndarray, separators: np.ndarray) -> list[int]:
    """Cuts at separators so that no word is parted; a word longer than a block widens its block."""
    ends, at, n = [], 0, len(data)
    while n - at > BLOCK:
        cut = at + BLOCK
        back = np.flatnonzero(separators[data[max(at, cut - 4096) : cut]])
        if len(back):
            cut = max(at, cut - 4096) + int(back[-1]) + 1
        else:
            while cut < n:
                ahead = np.flatnonzero(separators[data[cut : cut + BLOCK]])
                if len(ahead):
                    cut += int(ahead[0]) + 1
                    break
                cut = min(n, cut + BLOCK)
        ends.append(cut)
        at = cut
    if at < n or not ends:
        ends.append(n)
    return ends


def tokenize(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = IS_SPACE, lower: bool = False, prefixes: tuple[int, ...] = ()) -> Tokens:
    """Maximal runs of other bytes than ``separators`` in each row, with 64-bit content hashes. ``lower`` folds A-Z.

    ``prefixes``: also hash the first so many bytes of each word (or the whole of a shorter one).
    """
    hashes, starts, lengths = [], [], []
    heads: list[list[np.ndarray]] = [[] for _ in prefixes]
    at = 0
    for end in _block_ends(data, separators):
        part = data[at:end]
        n = len(part)
        if n:
            if lower:
                part = _LOWER[part]
            inside = ~separators[part]
            edges = offsets[(offsets > at) & (offsets < end)] - at
            before = np.empty(n, bool)
            before[0] = False
            before[1:] = inside[:-1]
            before[edges] = False
            after = np.empty(n, bool)
            after[-1] = False
            after[:-1] = inside[1:]
            after[edges - 1] = False
            s, e = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
            power, inverse = _power_tables(n)
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(_VALUES[part] * power[:n], out=sums[1:])
            h = (sums[e] - sums[s]) * inverse[s]
            hashes.append(mix(h + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
            for p, head in zip(prefixes, heads, strict=True):
                head.append(mix((sums[np.minimum(s + p, e)] - sums[s]) * inverse[s] + np.uint64(p)))
            starts.append(s + at)
            lengths.append(e - s)
        at = end
    h, s, ln = (np.concatenate(x) if x else np.empty(0, kind) for x, kind in ((hashes, np.uint64), (starts, np.int64), (lengths, np.int64)))
    row_start = np.searchsorted(s, offsets, "left")
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(row_start))
    return Tokens(h, s - offsets[row], ln, row_start, tuple(np.concatenate(x) if x else np.empty(0, np.uint64) for x in heads))


def tokenize_column(column: pa.Array, separators: np.ndarray = IS_SPACE, lower: bool = False, prefixes: tuple[int, ...] = ()) -> Tokens:
    return tokenize(*text_buffers(column), separators, lower, prefixes)


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Order-sensitive hashes of all runs of ``k`` consecutive words (rows must be parted by the caller)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = h[:n].copy()
    for i in range(1, k):
        out = out * np.uint64(0xFF51AFD7ED558CCD) + h[i : i + n]
    return mix(out)


def row_windows(t: Tokens, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word windows inside rows, and the index of each window's first word."""
    first = ragged(t.row_start[:-1], np.maximum(np.diff(t.row_start) - (k - 1), 0))
    return windows(t.hashes, k)[first], first


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of each row's values, as int64; rows may be empty."""
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of each run, one run after another."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    out = np.arange(total, dtype=np.int64)
    ends = np.cumsum(lengths)
    return out + np.repeat(starts - (ends - lengths), lengths)
