"""Texts of an Arrow column as one byte buffer, and word hashes over it, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are taken together up to about so many bytes; a longer one is taken alone.
LOT_BYTES = 1 << 19

LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
SPACES = np.zeros(256, bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True
_RNG = np.random.default_rng(20240)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def lots(column: pa.Array, limit: int = LOT_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first, last, bytes, offsets)`` for consecutive rows; null is the empty text."""
    data = column.cast(pa.large_string()).fill_null("")
    if not len(data):
        return
    offsets = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
    whole = np.frombuffer(data.buffers()[2], np.uint8) if data.buffers()[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(data):
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), len(data))
        yield first, last, whole[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit over all 64."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Powers:
    up = _powers(_BASE, 1 << 12)
    down = _powers(_INVERSE, 1 << 12)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_Powers.up) <= n:
        _Powers.up, _Powers.down = _powers(_BASE, 2 * n), _powers(_INVERSE, 2 * n)
    return _Powers.up, _Powers.down


def span_hashes(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the spans of a sequence of 64-bit symbols; equal spans have equal hashes wherever they are."""
    up, down = powers(len(symbols) + 1)
    sums = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(symbols * up[: len(symbols)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def words(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(hashes, starts, ends, first)``: the words of all texts, and the number of the first word of each text and the end.

    ``table`` maps bytes; where ``gap`` is set for the mapped byte, words are parted.
    """
    mapped = table[raw]
    inside = ~gap[mapped]
    before = np.empty_like(inside)
    if len(inside):
        before[0], before[1:] = False, inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(raw)]
    before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.ones_like(inside)
    if len(inside):
        after[:-1] = ~inside[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = True
    ends = np.flatnonzero(inside & after) + 1
    return span_hashes(_BYTE[mapped], starts, ends), starts, ends, np.searchsorted(starts, offsets)


def shingles(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width`` consecutive words at each word, and whether all of them are in one text."""
    n = len(hashes)
    owner_end = np.repeat(first[1:], np.diff(first))
    at = np.arange(n)
    whole = at + width <= owner_end
    return span_hashes(hashes, at, np.minimum(at + width, n)), whole


def minimisers(values: np.ndarray, width: int) -> np.ndarray:
    """Which values are the least of some ``width`` consecutive ones (or of all, if they are fewer)."""
    width = min(width, len(values))
    if width <= 1:
        return np.ones(len(values), bool)
    least = sliding(values, width, np.minimum)
    top = np.uint64(0)
    padded = np.concatenate([np.full(width - 1, top), least, np.full(width - 1, top)])
    return values == sliding(padded, width, np.maximum)


def sliding(values: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """``best`` over each ``width`` consecutive values."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = best(out[:-step], out[step:])
        have += step
    return out
