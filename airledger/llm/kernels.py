"""Array kernels that run inside Spark tasks: bytes of Arrow batches, word spans, hashes.

Spark partitions and shuffles the rows; these helpers only replace a per-word Python loop by
numpy over one bounded chunk of whole documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one numpy chunk holds at most (a longer document is a chunk of its own).
CHUNK_BYTES = 1 << 20

_U = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser of unsigned 64-bit integers."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def powers(n: int, base: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64; kept for the worker's life, grown by doubling."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(20, (n - 1).bit_length())
        steps = np.full(size, base, dtype=_U)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
        if size > 1 << 23:  # a huge document: do not keep its table
            _powers.pop(base)
    return have[:n]


BYTE_CODE = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))


def byte_set(members: str | bytes | list[int]) -> np.ndarray:
    """A 256-entry table that is true at the given byte values."""
    table = np.zeros(256, dtype=bool)
    table[list(members)] = True
    return table


#: Folds A-Z to a-z and leaves every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, dtype=np.uint8)
    return data, offsets


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [i, j) of at most so many bytes, at least one row each."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_spans(data: np.ndarray, offsets: np.ndarray, in_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each maximal run of word bytes within a row, and the row of each."""
    if not len(data):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    word = in_word[data]
    start = word.copy()
    start[1:] &= ~word[:-1]
    bounds = offsets[:-1]
    bounds = bounds[bounds < len(data)]
    start[bounds] |= word[bounds]
    stop = word.copy()
    stop[:-1] &= ~word[1:]
    last = offsets[1:] - 1
    last = last[(last >= 0) & (offsets[1:] > offsets[:-1])]
    stop[last] |= word[last]
    starts, ends = np.flatnonzero(start), np.flatnonzero(stop) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans: a polynomial over prefix sums, finalised with the length."""
    n = len(data)
    prefix = np.zeros(n + 1, dtype=_U)
    np.cumsum(BYTE_CODE[data] * powers(n, _P), out=prefix[1:])
    h = (prefix[ends] - prefix[starts]) * powers(n + 1, _P_INV)[starts]
    return mix(h + (ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93))


def distinct_per_row(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, value) pairs; rows must be ascending. The values of a row come out sorted."""
    if not len(values):
        return rows, values
    order = np.lexsort((values, rows))
    rows, values = rows[order], values[order]
    keep = np.ones(len(values), dtype=bool)
    keep[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
    return rows[keep], values[keep]


def int_lists(values: np.ndarray, lengths: np.ndarray, kind=np.int64) -> pa.ListArray:
    """A list column from flat values and the length of each row's list."""
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(kind, copy=False)))
