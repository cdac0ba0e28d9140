"""Word shingles of a text as 64-bit numbers, and their min-hash signatures, in numpy."""

from __future__ import annotations

import numpy as np

from prepflow.llm.common import mixed

BASE = np.uint64(0x9E3779B97F4A7C15)
CAPITAL = np.zeros(256, bool)
CAPITAL[65:91] = True
BLANK = np.zeros(256, bool)
BLANK[[32, *range(9, 14)]] = True

#: Shingles hashed by all functions at a time.
SLICE = 2048


def folded(text: str | None) -> np.ndarray:
    """UTF-8 bytes with A-Z lower-cased."""
    return np.frombuffer((text or "").encode().lower(), np.uint8)


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs without blanks."""
    blank = BLANK[data]
    edges = np.diff(np.concatenate(([True], blank, [True])).astype(np.int8))
    return np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)


def word_hashes(data: np.ndarray) -> np.ndarray:
    """One number a word: its bytes mixed with their places, summed and mixed again."""
    starts, ends = word_bounds(data)
    if not len(starts):
        return np.zeros(0, np.uint64)
    place = np.arange(len(data), dtype=np.int64)
    first = np.zeros(len(data), np.int64)
    first[starts] = starts
    place -= np.maximum.accumulate(first)
    value = mixed(data.astype(np.uint64) * BASE + place.astype(np.uint64))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)))
    return mixed(sums[ends] - sums[starts] + (ends - starts).astype(np.uint64))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct shingles of ``size`` words; a shorter text is one shingle, one without words has none."""
    words = word_hashes(folded(text))
    if not len(words):
        return words
    size = min(size, len(words))
    rolled = np.zeros(len(words) - size + 1, np.uint64)
    for k in range(size):
        rolled = mixed(rolled * BASE + words[k : k + len(rolled)] + np.uint64(size))
    return np.unique(rolled)


def factors(count: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and offsets of ``count`` hash functions."""
    rng = np.random.default_rng(seed)
    return (
        rng.integers(1 << 32, size=count, dtype=np.uint32) | np.uint32(1),
        rng.integers(1 << 32, size=count, dtype=np.uint32),
    )


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """16 bits of the smallest hash under each function."""
    low, high = (shingles & np.uint64(0xFFFFFFFF)).astype(np.uint32), (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(shingles), SLICE):
        hashed = low[at : at + SLICE, None] * a + (high[at : at + SLICE, None] ^ b)
        hashed ^= hashed >> np.uint32(15)
        hashed *= np.uint32(0x2C1B3C6D)
        np.minimum(least, hashed.min(0), out=least)
    return (least ^ (least >> np.uint32(16))).astype(np.uint16)
