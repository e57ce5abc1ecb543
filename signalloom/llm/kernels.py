"""Vectorised byte, word and hash kernels over the buffers of Arrow string columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are worked on in blocks of about so many bytes (one text at least), which bounds the temporaries.
BLOCK_BYTES = 2_000_000

U64 = np.uint64
_MULT = 0x9E3779B97F4A7C13  # odd, 3 mod 8: its powers stay apart in the low bits as well


def _table() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


BYTE_HASH = _table()
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes that part words `[^\x20\x09-\x0D]+`.
SPACES = np.zeros(256, bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the odd multiplier and of its inverse, modulo 2**64."""
    if len(_powers.get("p", ())) < n:
        m = max(n, BLOCK_BYTES + 1024)
        inverse = pow(_MULT, -1, 1 << 64)
        for key, base in (("p", _MULT), ("i", inverse)):
            steps = np.full(m, base, U64)
            steps[0] = 1
            _powers[key] = np.cumprod(steps, dtype=U64)
    return _powers["p"][:n], _powers["i"][:n]


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows; nulls count as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("") if column.null_count else column
    n = len(column)
    if not n:
        return
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    off = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + limit, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def word_spans(data: np.ndarray, off: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every maximal run of bytes that are no separators; runs end with their row."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~separator[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    first = off[:-1]
    before[first[first < n]] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    last = off[1:] - 1
    after[last[last >= 0]] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(off, starts, side="right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each span of bytes, from one prefix sum."""
    n = len(data)
    power, inverse = powers(n + 1)
    sums = np.zeros(n + 1, U64)
    np.cumsum(BYTE_HASH[data] * power[:n], out=sums[1:])
    h = (sums[ends] - sums[starts]) * inverse[starts]
    h += (ends - starts).astype(U64) * U64(0xA24BAED4963EE407)
    return mix(h)


def rolling(values: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hash of every window of ``width`` values (Horner steps over shifted views), mixed."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    h = values[:n].copy()
    for j in range(1, width):
        h *= U64(_MULT)
        h += values[j : j + n]
    return mix(h)
