"""Vectorised word hashing over the byte buffers of Arrow string columns; shared by the operators of this subpackage.

Everything here works on one chunk of documents inside a task.  Chunks are cut by bytes, so memory does not depend on how
many rows Spark puts into an Arrow batch; a single document is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 1 << 64)
_powers = {"n": 0, "up": np.empty(0, np.uint64), "down": np.empty(0, np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def chunks(column: pa.Array | pa.ChunkedArray, max_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Slices ``(first row, strings)`` of at most ``max_bytes`` of text each (one row at least); null becomes empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    sizes = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    lo, n, base = 0, len(column), 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(sizes, base + max_bytes, side="right")))
        yield lo, column.slice(lo, hi - lo)
        lo, base = hi, int(sizes[hi - 1])


def buffer_of(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes, each document followed by a newline, and the documents' offsets (one more than documents)."""
    joined = pc.binary_join_element_wise(strings, *(pa.scalar(x, pa.large_string()) for x in ("", "\n")))
    offsets = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset:joined.offset + len(joined) + 1]
    data = np.frombuffer(joined.buffers()[2], np.uint8)[offsets[0]:offsets[-1]] if len(joined) else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _powers["n"] < n:
        size = max(n, CHUNK_BYTES + 1024)
        for key, base in (("up", _BASE), ("down", _INV)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[key] = np.multiply.accumulate(table)
        _powers["n"] = size
    return _powers["up"][:n], _powers["down"][:n]


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of word bytes, and for each document the index of its first word (with the total last).

    ``is_word`` is a table of 256 booleans; the newline between documents must not be a word byte.
    """
    inside = np.zeros(len(data) + 1, np.int8)
    inside[1:] = is_word[data]
    step = np.diff(inside)
    starts = np.flatnonzero(step == 1)
    ends = np.flatnonzero(step == -1)
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span: a polynomial in the bytes, taken from running sums, then mixed with the length."""
    up, down = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, all other bytes as they are."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table[data]


#: Word bytes of two word rules: anything but white space, and letters, digits or bytes of non-ASCII characters.
NON_SPACE = np.ones(256, bool)
NON_SPACE[[9, 10, 11, 12, 13, 32]] = False
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True
