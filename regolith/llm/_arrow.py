"""Words of whole Arrow string columns, with numpy and no loop over rows or words."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

_CHUNK = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_U = np.uint64


def byte_table(separators: bytes) -> np.ndarray:
    """A truth value for each byte: part of a word."""
    table = np.ones(256, bool)
    table[list(separators)] = False
    return table


#: Words `[^\x20\x09-\x0D]+`.
BLANK = byte_table(b" \t\n\x0b\x0c\r")
#: Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, after A-Z have been lower-cased.
PUNCT = byte_table(bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Words(NamedTuple):
    """first, last: row range in the batch. data: the rows' bytes; byte_at: where each row begins in them. start, end: of each word in
    data; word_at: the first word of each row, with the total at the end."""

    first: int
    last: int
    data: np.ndarray
    byte_at: np.ndarray
    start: np.ndarray
    end: np.ndarray
    word_at: np.ndarray


def text_chunks(column: pa.Array, table: np.ndarray, lower: bool = False, size: int = _CHUNK) -> Iterator[Words]:
    """The words of a string column, about `size` bytes of whole rows at a time; a null has none."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    body = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1)
        data = body[offsets[first] : offsets[last]]
        at = offsets[first : last + 1] - offsets[first]
        if lower:
            data = LOWER[data]
        inside = table[data]
        before = np.zeros(len(data), bool)
        before[1:] = inside[:-1]
        before[at[:-1][at[:-1] < len(data)]] = False
        after = np.zeros(len(data), bool)
        after[:-1] = inside[1:]
        after[at[1:][at[1:] > 0] - 1] = False
        start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        yield Words(first, last, data, at, start, end, np.searchsorted(start, at))
        first = last


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base & (2**64 - 1), np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(w: Words) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if not len(w.start):
        return np.zeros(0, np.uint64)
    lengths = w.end - w.start
    ends = np.cumsum(lengths)
    within = np.arange(ends[-1]) - np.repeat(ends - lengths, lengths)
    letters = w.data[np.repeat(w.start, lengths) + within].astype(np.uint64) + _U(1)
    letters *= powers(_BASE, int(lengths.max()))[within]
    return mix(np.add.reduceat(letters, ends - lengths) ^ lengths.astype(np.uint64) * _U(0xD6E8FEB86659FD93))


def rolling(values: np.ndarray, k: int, base: int = 0xD1342543DE82EF95) -> np.ndarray:
    """Rabin-Karp hashes, modulo 2**64, of each k consecutive values."""
    n = len(values)
    if n < k:
        return np.zeros(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * powers(base, n), out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * powers(pow(base, -1, 2**64), n - k + 1))


def sliding_min(values: np.ndarray, k: int) -> np.ndarray:
    """The least of each k consecutive values."""
    out, width = values, 1
    while 2 * width <= k:
        out, width = np.minimum(out[: len(out) - width], out[width:]), 2 * width
    return np.minimum(out[: len(out) - (k - width)], out[k - width :]) if k > width else out


def row_of(at: np.ndarray) -> np.ndarray:
    """The row of each item, from where the rows' items begin."""
    return np.repeat(np.arange(len(at) - 1), np.diff(at))


def list_array(at: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), values)


def flat_list(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Where each row's items begin, and the items; a null is an empty list."""
    sizes = np.asarray(column.value_lengths().fill_null(0), np.int64)
    return np.concatenate([[0], np.cumsum(sizes)]), column.flatten()
