"""Vectorised rolling hashes over Arrow string columns.

A batch of texts is handled as one byte buffer plus document offsets.  Words, word hashes, hashes of runs
of units (bytes or words) and window minimisers come out of prefix sums, so no Python loop runs over
words or bytes.  Hashes are polynomial over random 64-bit letters, modulo 2**64; where equality decides a
result, two independent ones are taken together (128 bits).
"""

from __future__ import annotations

import ctypes
import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Bytes that one vectorised step handles; a longer text is a step of its own.
STEP_BYTES = 1 << 17
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


@functools.lru_cache(maxsize=2)
def _letters(which: int) -> np.ndarray:
    return np.random.default_rng(977 + which).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i < n, kept for later steps of this process."""
    have = _POWERS.get(which)
    if have is None or len(have[0]) < n:
        size = max(n, STEP_BYTES + 4096)
        base = _BASES[which]
        back = pow(base, -1, 1 << 64)
        up, down = np.full(size, base, U), np.full(size, back, U)
        up[0] = down[0] = 1
        have = (np.cumprod(up), np.cumprod(down))
        if n <= STEP_BYTES + 4096:
            _POWERS[which] = have
    return have


def release() -> None:
    """Gives memory that Arrow and numpy keep after a block back to the system; workers idle beside the JVM."""
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
        trim(0)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit over all bits."""
    h = h ^ (h >> U(33))
    h *= U(0xFF51AFD7ED558CCD)
    h ^= h >> U(33)
    h *= U(0xC4CEB9FE1A85EC53)
    h ^= h >> U(33)
    return h


def prefix(values: np.ndarray, which: int = 0) -> np.ndarray:
    """Prefix sums of values[i] * base**i; one longer than the input."""
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * _powers(which, len(values) + 1)[0][: len(values)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, stop: np.ndarray, which: int = 0) -> np.ndarray:
    """Mixed hash of values[start:stop], wherever it stands."""
    return mix((sums[stop] - sums[start]) * _powers(which, len(sums))[1][start])


def all_spans(sums: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """Hashes (not mixed) of every run of `length` values."""
    n = len(sums) - length
    if n <= 0:
        return np.zeros(0, U)
    return (sums[length:] - sums[:n]) * _powers(which, len(sums))[1][:n]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (null: empty) and the offsets of its rows in them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_binary())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def steps(column: pa.Array, limit: int = STEP_BYTES):
    """Yields (first row, end row) of slices of about `limit` bytes."""
    size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(size)
    first, n = 0, len(size)
    while first < n:
        base = ends[first - 1] if first else 0
        stop = max(first + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield first, stop
        first = stop


def separators(raw: np.ndarray) -> np.ndarray:
    """Bytes 0x20 and 0x09-0x0D."""
    return (raw == 32) | ((raw - np.uint8(9)) < 5)


def words(raw: np.ndarray, offsets: np.ndarray, gap: np.ndarray | None = None):
    """(starts, stops, first word of each document and the end): maximal runs of bytes that are no
    separators, never across documents."""
    inside = ~(separators(raw) if gap is None else gap)
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cut = offsets[:-1][offsets[:-1] < n]
    begins[cut] = inside[cut]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    ends[last] = inside[last]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return starts, stops, np.searchsorted(starts, offsets)


def lower(raw: np.ndarray) -> np.ndarray:
    """A-Z in lower case; nothing else changes."""
    return np.where((raw - np.uint8(65)) < 26, raw + np.uint8(32), raw)


def letters(raw: np.ndarray, which: int = 0) -> np.ndarray:
    return _letters(which)[raw]


def word_hashes(raw, starts, stops, which: int = 0) -> np.ndarray:
    return span_hash(prefix(letters(raw, which), which), starts, stops, which)


def minimisers(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each run of `width` hashes, the place of the one with the least leading bits, the leftmost among
    equals.  Which one of a run it is depends on the run's own values alone."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    low = U(31)  # a string has fewer places than that
    best, span = (hashes >> low << low) | np.arange(len(hashes), dtype=U), 1
    while span < width:
        hop = min(span, width - span)
        best = np.minimum(best[:-hop], best[hop:])
        span += hop
    return (best & ((U(1) << low) - U(1))).astype(np.int64)
