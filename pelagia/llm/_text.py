"""numpy kernels over Arrow text columns: words, rolling polynomial hashes, windows.

All hashes are 64-bit; polynomial sums wrap modulo 2**64 and are mixed afterwards. Arrays are built for slices of
about ``SLICE`` bytes, so memory is bounded by the slice or by the longest single text, whichever is larger.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
SLICE = 2_000_000
BASE = U(0x9E3779B97F4A7C15 | 1)
INVERSE = U(pow(int(BASE), -1, 1 << 64))
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[str, np.ndarray] = {}


def powers(n: int, base: U = BASE, name: str = "base") -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; the table is kept and grown by doubling."""
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, 2 * len(have) if have is not None else 1 << 16)
        step = np.full(size, base, U)
        step[0] = 1
        have = np.multiply.accumulate(step)
        _powers[name] = have
    return have[:n]


def inverse_powers(n: int) -> np.ndarray:
    return powers(n, INVERSE, "inverse")


def mix(h: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if not len(offsets):
        offsets = np.zeros(1, np.int64)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about ``limit`` text bytes; every row is in exactly one."""
    _, offsets = buffers(batch.column(column))
    at, n = 0, batch.num_rows
    while at < n:
        stop = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        stop = min(n, max(at + 1, stop))
        yield batch.slice(at, stop - at)
        at = stop


LETTER = np.zeros(256, bool)
LETTER[97:123] = LETTER[65:91] = LETTER[128:] = True


def cut_marks(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True bytes; a text's edge ends a run."""
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cuts = offsets[:-1]
    cuts = cuts[cuts < len(inside)]
    begins[cuts] = inside[cuts]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    last = offsets[1:] - 1
    last = last[last >= 0]
    stops[last] = inside[last]
    return np.flatnonzero(begins), np.flatnonzero(stops) + 1


class Words:
    """Words of a slice of texts: maximal runs of bytes that ``inside`` marks (default ``[^\\x20\\x09-\\x0D]+``).

    starts, ends: byte ranges in ``raw``; first: index of each text's first word (one more entry than texts);
    hashes: a mixed 64-bit hash of each word's bytes; ``prefixes`` adds hashes of the first n bytes of longer words.
    """

    def __init__(self, column: pa.Array, lower: bool = False, inside: np.ndarray = ~SPACE, prefixes: tuple = ()):
        self.raw, self.offsets = buffers(column)
        self.starts, self.ends = cut_marks(inside[self.raw], self.offsets)
        self.first = np.searchsorted(self.starts, self.offsets)
        self.hashes = np.zeros(len(self.starts), U)
        self.prefix = {k: np.zeros(len(self.starts), U) for k in prefixes}
        step = 1 << 20
        at = np.unique(np.append(np.searchsorted(self.starts, np.arange(0, len(self.raw), step)), len(self.starts)))
        for a, b in zip(at[:-1], at[1:], strict=True):  # a piece ends where a word ends
            lo, hi = self.starts[a], self.ends[b - 1]
            raw = self.raw[lo:hi]
            raw = LOWER[raw] if lower else raw
            sums = np.zeros(hi - lo + 1, U)
            np.cumsum(raw.astype(U) * powers(hi - lo), out=sums[1:])
            start, size = self.starts[a:b] - lo, self.ends[a:b] - self.starts[a:b]
            down, before = inverse_powers(hi - lo + 1)[start], sums[start]
            self.hashes[a:b] = mix((sums[start + size] - before) * down + size.astype(U) * U(0xD6E8FEB86659FD93))
            for k, out in self.prefix.items():
                longer = size > k
                ends = np.minimum(start + k, hi - lo)
                h = mix((sums[ends] - before) * down + U(k * 0xA24BAED4963EE407 & 0xFFFFFFFFFFFFFFFF))
                out[a:b] = np.where(longer, h, U(0))

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def windows(values: np.ndarray, k: int) -> np.ndarray:
    """Rabin-Karp hash of every k consecutive values (one array, texts not yet told apart)."""
    n = len(values)
    if n < k:
        return np.zeros(0, U)
    sums = np.zeros(n + 1, U)
    np.cumsum(values * powers(n), out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * inverse_powers(n)[: n - k + 1] + U(k))


def sliding_min(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values, by doubling."""
    out, have = values, 1
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def spans(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenated aranges [first[i], first[i] + counts[i])."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total) + np.repeat(first - (ends - counts), counts)
