"""Whole columns of text as one byte buffer: words, hashes and windows by array arithmetic.

Helpers of the Arrow functions in this package. A batch is cut into chunks of whole texts of
about ``CHUNK`` bytes, so memory follows the chunk (or the longest single text).
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2^64
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

#: The white space of the contracts: space and 0x09-0x0D.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def give_back() -> None:
    """Hands free memory back to the system, so a worker that waits for its next task keeps only what is in use."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2^64, for i < n at least."""
    if len(_powers[0]) < n:
        size = max(n, CHUNK + 4096)
        for slot, base in enumerate((_BASE, np.uint64(pow(int(_BASE), -1, 1 << 64)))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[slot] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


#: Prime moduli and bases of the span hashes: no text can be built whose powers cancel, as they can modulo 2^64.
PRIMES, BASES = (2147483647, 2147483629), (1103515245, 1664525)
_prime_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def prime_powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo a prime, for i < n at least."""
    held = _prime_powers.get(which)
    if held is None or len(held[0]) < n:
        prime, size = PRIMES[which], max(n, CHUNK + 4096)
        tables = []
        for base in (BASES[which], pow(BASES[which], -1, prime)):
            made = np.ones(1, np.uint64)
            while len(made) < size:  # doubles: base**(i + n) = base**i * base**n
                made = np.concatenate((made, made * np.uint64(pow(base, len(made), prime)) % np.uint64(prime)))
            tables.append(made[:size])
        held = _prime_powers[which] = tables[0], tables[1]
    return held


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Chunk:
    """Texts ``first`` .. ``first + n - 1`` of a batch, as bytes with ``n + 1`` offsets."""

    def __init__(self, first: int, data: np.ndarray, offsets: np.ndarray):
        self.first, self.data, self.offsets, self.n = first, data, offsets, len(offsets) - 1

    def prefix(self, data: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Running polynomial sums modulo two primes, from which any span's hash follows."""
        data = self.data if data is None else data
        digits, sums = data.astype(np.uint64) + np.uint64(1), []
        for which, prime in enumerate(PRIMES):
            total = np.zeros(len(data) + 1, np.uint64)
            # Terms under 2^31 add up below 2^63 for any text that fits a row.
            np.cumsum(digits * prime_powers(which, len(data) + 1)[0][: len(data)] % np.uint64(prime), out=total[1:])
            sums.append(total)
        return sums[0], sums[1]

    def words(self, data: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the words, and ``n + 1`` word offsets of the texts."""
        data = self.data if data is None else data
        inside = ~IS_SPACE[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[self.offsets] = True
        starts, ends = inside.copy(), inside.copy()
        starts[1:] &= ~inside[:-1] | edge[1:-1]
        ends[:-1] &= ~inside[1:] | edge[1:-1]
        starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)

    def lowered(self) -> np.ndarray:
        return LOWER[self.data]


def span_hashes(prefix: tuple[np.ndarray, np.ndarray], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes of spans, wherever they stand."""
    parts = [(sums[ends] - sums[starts]) % np.uint64(prime) * prime_powers(which, len(sums))[1][starts] % np.uint64(prime)
             for which, (sums, prime) in enumerate(zip(prefix, PRIMES))]
    return mix(parts[0] << np.uint64(32) | parts[1])


def chunks(column: pa.Array) -> Iterator[Chunk]:
    """Chunks of a string or binary column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset: column.offset + len(column) + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, "right")) - 1)
        yield Chunk(at, data[offsets[at]: offsets[to]], offsets[at: to + 1] - offsets[at])
        at = to
    # What earlier batches held goes back to the system before the next one arrives.
    pa.default_memory_pool().release_unused()
