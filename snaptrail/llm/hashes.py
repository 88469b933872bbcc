"""Hashes of words and of runs of words, for many texts at once, alike on every machine."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
WORD_BYTE = np.ones(256, bool)
WORD_BYTE[[32, *range(9, 14)]] = False
FIRST, SECOND = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _STEP, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def lower_words(texts: pa.Array) -> pa.Array:
    """Lower case, with one space for each run that is neither letter nor digit."""
    return pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\p{L}\p{N}]+", " ")


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts (runs without space, tab, line or page breaks), and how many each text has."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or bounds[-1] == bounds[0]:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    b = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    inside = WORD_BYTE[b]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edge = bounds[:-1][bounds[:-1] < len(b)]
    begins[edge] = inside[edge]
    start = np.flatnonzero(begins)
    sizes = np.diff(np.searchsorted(start, bounds))
    if not len(start):
        return np.zeros(0, np.uint64), sizes
    own = b[inside]
    place = np.cumsum(inside) - 1
    first = place[start]
    lengths = np.diff(np.append(first, len(own)))
    at = np.arange(len(own)) - np.repeat(first, lengths)
    h = np.add.reduceat(_BYTE[own] * _powers(int(lengths.max()))[at], first)
    return mix(h + lengths.astype(np.uint64) * _STEP), sizes


def runs(h: np.ndarray, n: int, base: np.uint64 = FIRST) -> np.ndarray:
    """Hashes of all runs of n words (the last n-1 places give none)."""
    out, have, power = None, 0, int(base)
    part, size = h, 1
    while True:
        if n & size:
            if out is None:
                out, have = part, size
            else:
                k = len(h) - have - size + 1
                if k <= 0:
                    return np.zeros(0, np.uint64)
                scale = np.uint64(pow(int(base), have, 1 << 64))
                out, have = out[:k] + scale * part[have : have + k], have + size
        if have == n:
            return mix(out)
        if len(part) <= size:
            return np.zeros(0, np.uint64)
        part = part[:-size] + np.uint64(power) * part[size:]
        power, size = power * power % (1 << 64), size * 2


def of_texts(sizes: np.ndarray, n: int) -> np.ndarray:
    """Which places of ``runs`` lie inside one text."""
    text = np.repeat(np.arange(len(sizes)), sizes)
    return text[: len(text) - n + 1] == text[n - 1 :] if len(text) >= n else np.zeros(0, bool)
