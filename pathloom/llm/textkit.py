"""Vectorised text kernels for Arrow batches: words, hashes, shingles. Whole texts, bytes of UTF-8, no row loops."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Multipliers of the splitmix64 finalizer and its increment.
MIX1, MIX2, GOLDEN = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB), U64(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95  # an odd 64-bit multiplier: its powers have inverses modulo 2**64
_BASE_INV = pow(_BASE, -1, 1 << 64)
#: Bytes of text worked on at a time.
CHUNK = 1_000_000


def mix(x: np.ndarray) -> np.ndarray:
    x = x + GOLDEN
    x = (x ^ (x >> U64(30))) * MIX1
    x = (x ^ (x >> U64(27))) * MIX2
    return x ^ (x >> U64(31))


BYTE_SEED = mix(np.arange(256, dtype=U64))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BYTE_SEED_LOWER = BYTE_SEED[LOWER]
#: True for bytes of a word: [^\x20\x09-\x0D].
IN_WORD = np.ones(256, bool)
IN_WORD[[0x20, *range(0x09, 0x0E)]] = False

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    known = _powers.get(base)
    if known is None or len(known) < n:
        size = max(n, 1 << 16)
        steps = np.full(size, base, U64)
        steps[0] = 1
        known = _powers[base] = np.cumprod(steps, dtype=U64)
    return known[:n]


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column, nulls as empty, and the offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    n = len(column)
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and n else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def give_back() -> None:
    """Return freed memory to the system: workers stay after their tasks, and what they keep counts for their executor."""
    for base in [b for b, known in _powers.items() if len(known) > 2 * CHUNK]:
        del _powers[base]
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about limit bytes of text, at least a row each: bounded memory for the kernels."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False)
        total = np.cumsum(sizes)
        at = 0
        while at < n:
            base = total[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(total, base + limit, "right")))
            yield batch.slice(at, to - at)
            at = to
    give_back()


class Words:
    """Words of a chunk: starts and ends (bytes), first word of each row, and each word's hash."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, in_word: np.ndarray = IN_WORD):
        inside = in_word[data]
        before = np.empty_like(inside)
        before[:1] = False
        before[1:] = inside[:-1]
        heads = offsets[:-1][offsets[:-1] < len(data)]
        before[heads] = False
        after = np.empty_like(inside)
        after[-1:] = False
        after[:-1] = inside[1:]
        tails = offsets[1:][offsets[1:] > 0] - 1
        after[tails] = False
        self.data, self.offsets, self._sums = data, offsets, None
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)

    def hashes(self, seeds: np.ndarray = BYTE_SEED_LOWER, prefix: int | None = None) -> np.ndarray:
        """A hash of each word, or of its first prefix bytes."""
        if self._sums is None:
            self._sums = prefix_sums(self.data, seeds)
        return sum_hashes(self._sums, self.start, self.end if prefix is None else np.minimum(self.end, self.start + prefix))


def prefix_sums(data: np.ndarray, seeds: np.ndarray = BYTE_SEED) -> np.ndarray:
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum(seeds[data] * powers(_BASE, len(data)), out=sums[1:])
    return sums


def sum_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span, equal spans equal hashes wherever they stand."""
    inverse = powers(_BASE_INV, len(sums))
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(U64) * GOLDEN)


def shingles(hashes: np.ndarray, first: np.ndarray, k: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's k-word runs and the offsets of the rows. short: a row of fewer words, but not none, has one."""
    n, rows = len(hashes), len(first) - 1
    count = np.diff(first)
    m = max(n - k + 1, 0)
    run = np.zeros(m, U64)
    for j in range(k):
        run = (run + hashes[j : j + m]) * MIX1 + GOLDEN
    run = mix(run)
    own = np.maximum(count - (k - 1), 0)
    few = (count > 0) & (count < k) if short else np.zeros(rows, bool)
    out = np.zeros(rows + 1, np.int64)
    np.cumsum(own + few, out=out[1:])
    got = np.empty(out[-1], U64)
    shift = np.repeat(first[:-1] - out[:-1], own + few)
    if few.any():
        shift[out[:-1][few]] = 0
    at = np.arange(out[-1]) + shift
    if few.any():
        at[out[:-1][few]] = 0
        got[:] = run[at] if m else 0
        for r in np.flatnonzero(few):
            h = np.array([count[r]], U64)
            for x in hashes[first[r] : first[r + 1]]:
                h = mix(h * MIX2 + x)
            got[out[r]] = h[0]
    else:
        got[:] = run[at]
    return got, out


def distinct_sorted(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's values sorted and without repeats, and the new offsets."""
    parts = [np.unique(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    out = np.zeros(len(offsets), np.int64)
    np.cumsum([len(p) for p in parts], out=out[1:])
    return (np.concatenate(parts) if parts else np.zeros(0, U64)), out
