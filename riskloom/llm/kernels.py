"""NumPy kernels over the UTF-8 bytes of a batch of texts."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of text that a kernel takes at once; a single longer text makes a batch of its own, which kernels go through in parts.
SLICE_BYTES = 2 << 20

#: Bytes of which spans are hashed at once.
HASHED = 1 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a string array one after the other, and n + 1 offsets. Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, where, data = column.buffers()
    if len(column) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(where, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in consecutive parts of about ``limit`` bytes of text each."""
    offsets = text_buffer(batch.column(column))[1]
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def class_table(pattern: str) -> np.ndarray:
    """True for the bytes of a class: ``word`` (digits, letters, all of non-ASCII) or ``dark`` (not white space)."""
    table = np.zeros(256, bool)
    if pattern == "word":
        table[0x30:0x3A] = table[0x41:0x5B] = table[0x61:0x7B] = table[0x80:] = True
    else:
        table[:] = True
        table[[0x20, 9, 10, 11, 12, 13]] = False
    return table


@cache
def ascii_lower() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B] += 32
    return table


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
    up, down = np.full(n, _ODD), np.full(n, inverse)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(1 << max(16, int(n).bit_length()))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def tokens(data: np.ndarray, offsets: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of each maximal run of class bytes; runs never cross documents."""
    inside = class_table(kind)[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    begins[edges] = inside[edges]
    stops[edges - 1] = inside[edges - 1]
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(stops) + 1, np.searchsorted(offsets[1:], start, "right")


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each span of bytes, in order of start: by prefix sums of one polynomial over HASHED bytes at a time.

    A span of more than HASHED bytes has the XXH3 of its bytes instead.
    """
    out = np.empty(len(start), np.uint64)
    table, at = ascii_lower() if lower else None, 0
    while at < len(start):
        first = int(start[at])
        past = int(np.searchsorted(end, first + HASHED, "right"))
        if past <= at:
            whole = data[first : int(end[at])]
            out[at] = xxhash.xxh3_64_intdigest((table[whole] if lower else whole).tobytes())
            at += 1
            continue
        some = data[first : int(end[past - 1])]
        up, down = powers(HASHED)
        sums = np.zeros(len(some) + 1, np.uint64)
        np.cumsum(((table[some] if lower else some).astype(np.uint64) + np.uint64(1)) * up[: len(some)], out=sums[1:])
        low, high = start[at:past] - first, end[at:past] - first
        out[at:past] = mix((sums[high] - sums[low]) * down[low] + (high - low).astype(np.uint64))
        at = past
    return out


def gram_hash(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive word hashes."""
    size = max(0, len(words) - n + 1)
    total = np.zeros(size, np.uint64)
    for j, factor in enumerate(gram_factors(n)):
        total += words[j : j + size] * factor
    return mix(total)


def gram_factors(n: int) -> list[np.uint64]:
    return [np.uint64(pow(int(_ODD), j, 1 << 64)) for j in range(n)]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, by doubling."""
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out
