"""Word and window hashes of whole texts, vectorised over bytes."""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SPAN = 64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix64's finish)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def coefficients(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit numbers."""
    return np.random.default_rng(seed).integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)


def words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends): the text as numbers, and the spans of its words, the maximal runs of other than ASCII white space."""
    buf = np.frombuffer(data, np.uint8)
    space = np.ones(len(buf) + 2, bool)
    space[1:-1] = _SPACE[buf]
    edges = np.flatnonzero(space[1:] != space[:-1])
    return buf, edges[0::2], edges[1::2]


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, *seeds: int) -> list[np.ndarray]:
    """A 64-bit hash of each word for each seed: bytes times coefficients by their place, summed and mixed."""
    if not len(starts):
        return [np.empty(0, np.uint64) for _ in seeds]
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    total = int(lengths.sum())
    place = np.arange(total) - np.repeat(first, lengths)
    body = buf[np.repeat(starts, lengths) + place].astype(np.uint64) + np.uint64(1)
    if int(lengths.max()) > _SPAN:  # places beyond the table get other odd multiples
        body *= (2 * (place // _SPAN) + 1).astype(np.uint64)
        place %= _SPAN
    return [mix(np.add.reduceat(body * coefficients(_SPAN, s)[place], first) + lengths.astype(np.uint64)) for s in seeds]


def window_hashes(hashes: np.ndarray, width: int, seed: int) -> np.ndarray:
    """A 64-bit hash of every run of ``width`` words; none for fewer words."""
    n = len(hashes) - width + 1
    if n < 1:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k, c in enumerate(coefficients(width, seed)):
        out += hashes[k:k + n] * c
    return mix(out)
