"""64-bit hashes of the words of many texts at once, straight from Arrow's text buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE, _FAR = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_NEAR_BITS = 12
SLICE_BYTES = 1 << 21
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_FOLD = np.arange(256, dtype=np.uint64) + 1
_FOLD[65:91] += 32  # A-Z as a-z
_FOLD[_SEPARATOR] = 0


def _powers(base: int, n: int) -> np.ndarray:
    factors = np.full(n, base, np.uint64)
    factors[0] = 1
    return np.cumprod(factors, dtype=np.uint64)


_NEAR = _powers(_BASE, 1 << _NEAR_BITS)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def _span_hashes(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of `data` and how many lie before each of `begins`, which also end words."""
    gap = _SEPARATOR[data]
    first = ~gap
    first[1:] &= gap[:-1]
    inner = begins[(begins > 0) & (begins < len(data))]
    first[inner] = ~gap[inner]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(begins), np.int64)
    nth = np.arange(starts[0], len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
    value = _FOLD[data[starts[0] :]] * _NEAR[nth & ((1 << _NEAR_BITS) - 1)]
    far = nth >> _NEAR_BITS
    if far.any():
        value *= _powers(_FAR, int(far.max()) + 1)[far]
    return _mix(np.add.reduceat(value, starts - starts[0])), np.searchsorted(starts, begins)


def word_hashes(texts: pa.Array) -> Iterator[np.ndarray]:
    """For each text, the hashes of its words in order, with A-Z as a-z; null texts have none.

    Works on spans of about SLICE_BYTES, so a very long text needs little more memory than its words' hashes.
    """
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, side="right")) - 1)
        low, high = int(offsets[row]), int(offsets[end])
        if high - low <= 2 * SLICE_BYTES:
            begins = offsets[row:end] - low
            hashes, before = _span_hashes(data[low:high], begins)
            yield from np.split(hashes, before[1:])
        else:  # one long text, in spans that end at separators
            parts = []
            while low < high:
                stop = min(low + SLICE_BYTES, high)
                while stop < high:
                    gaps = np.flatnonzero(_SEPARATOR[data[stop : min(stop + SLICE_BYTES, high)]])
                    if len(gaps):
                        stop += int(gaps[0])
                        break
                    stop = min(stop + SLICE_BYTES, high)
                parts.append(_span_hashes(data[low:stop], np.zeros(1, np.int64))[0])
                low = stop
            yield np.concatenate(parts)
        row = end
