"""Vectorised scanning of Arrow text columns with numpy.

Words are ``[^\\x20\\x09-\\x0D]+`` on UTF-8 bytes. A span's hash takes eight bytes
after another into a 64-bit state and mixes it after each step, so no algebraic
relation between bytes survives; spans of more than ``LONG`` bytes are hashed
by XXH3. Two given different spans collide with a probability near 2**-64.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

LONG = 256
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: keeps the first bytes of a little-endian word of eight
_FIRST = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def slices(column: pa.Array | pa.ChunkedArray, limit: int = 512 << 10) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a text column into runs of rows of at most ``limit`` bytes, or one longer row.

    Yields (first row, row after the last, bytes, offsets into these). Null is
    an empty text.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    _, raw, data = column.buffers()
    offsets = np.frombuffer(raw, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < n:
        stop = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        stop = min(max(stop, row + 1), n)
        yield row, stop, data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        row = stop


def words(buf: np.ndarray, offsets: np.ndarray, outside: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, runs of bytes that aren't ``outside``, and for each row the index of its first word (one entry more than rows)."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~outside[buf]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = offsets[:-1] < offsets[1:]
    first[offsets[:-1][full]] = inside[offsets[:-1][full]]
    last[offsets[1:][full] - 1] = inside[offsets[1:][full] - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def span_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of the bytes of each span."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    padded = np.zeros(len(buf) + 8, dtype=np.uint8)
    padded[: len(buf)] = buf
    eight = np.ndarray((len(buf) + 1,), dtype="<u8", buffer=padded, strides=(1,))  # the eight bytes from each place on
    lengths = ends - starts
    out = mix(mix(lengths.astype(np.uint64) * _STEP + _STEP) ^ (eight[starts] & _FIRST[np.minimum(lengths, 8)]))
    own = np.flatnonzero((lengths > 8) & (lengths <= LONG))
    done = 8
    while len(own):
        left = lengths[own] - done
        out[own] = mix((out[own] + _STEP) ^ (eight[starts[own] + done] & _FIRST[np.minimum(left, 8)]))
        own = own[left > 8]
        done += 8
    for k in np.flatnonzero(lengths > LONG).tolist():
        out[k] = xxhash.xxh3_64_intdigest(buf[starts[k] : ends[k]].tobytes(), seed=0x51ED)
    return out


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` word hashes, ``n`` up to a few dozen; runs that cross rows are the caller's to drop."""
    count = max(len(hashes) - n + 1, 0)
    out = np.zeros(count, dtype=np.uint64)
    for k in range(n):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += hashes[k : k + count]
    return mix(out)


def row_of(bounds: np.ndarray, count: int) -> np.ndarray:
    """For each of ``count`` elements the row that it is in, given the rows' first elements."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[:count]


def seen_twice(keys: np.ndarray) -> np.ndarray:
    """Which elements have an equal elsewhere in ``keys``."""
    order = np.sort(keys)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return np.zeros(len(keys), dtype=bool)
    twice = twice[np.concatenate(([True], twice[1:] != twice[:-1]))]
    at = np.searchsorted(twice, keys)
    at[at == len(twice)] = 0
    return twice[at] == keys
