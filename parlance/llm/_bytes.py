"""Words of many texts at once, on their UTF-8 bytes, with numpy.

A word is a run of bytes other than space and 9 to 13, as ``[^\\x20\\x09-\\x0D]+``
says. Words become 64-bit fingerprints, equal on every machine and in every run.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of strings, and where each text starts (one more at the end); null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = texts.buffers()
    starts = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return flat[starts[0] : starts[-1]], starts - starts[0]


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z; other bytes stay."""
    return _LOWER[data]


def words(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each word starts and ends, and how many words each text has."""
    gap = _SPACE[data]
    inner = np.ones(len(data) + 1, bool)
    inner[starts] = False  # a text's first byte starts a word, whatever came before
    before = np.ones(len(data), bool)
    before[1:] = gap[:-1]
    before |= ~inner[:-1]
    first = np.flatnonzero(~gap & before)
    after = np.ones(len(data), bool)
    after[:-1] = gap[1:]
    after |= ~inner[1:]
    last = np.flatnonzero(~gap & after) + 1
    return first, last, np.diff(np.searchsorted(first, starts))


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64 bits (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least n of each."""
    size = 1 << max(16, int(n).bit_length())
    if size not in _powers:
        _powers.clear()
        up, down = np.full(size, _BASE), np.full(size, np.uint64(pow(int(_BASE), -1, 1 << 64)))
        up[0] = down[0] = 1
        _powers[size] = (np.cumprod(up), np.cumprod(down))
    return _powers[size]


def prints(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint of each span of bytes."""
    if not len(first):
        return np.empty(0, np.uint64)
    up, down = _power(len(data) + 1)
    upto = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=upto[1:])
    return mix((upto[last] - upto[first]) * down[first] + (last - first).astype(np.uint64))
