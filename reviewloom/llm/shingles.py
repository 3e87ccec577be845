"""Word shingles as hashes, made from whole texts with array operations."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

WORDS = 5
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = 0x100000001B3


def mix(values: np.ndarray) -> np.ndarray:
    """Hashes of 64-bit numbers whose bits all depend on all bits (public finaliser constants)."""
    x = np.asarray(values, np.uint64) + _BASE
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _folded() -> np.ndarray:
    """A hash of each letter or digit in lower case, 0 for what parts words."""
    table = np.zeros(0x110000, np.uint64)
    inside = [code for code in range(0x110000) if chr(code).isalnum()]
    table[inside] = mix(np.array([ord(chr(code).lower()[0]) for code in inside])) | np.uint64(1)
    return table


@lru_cache(maxsize=4)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64."""
    return tuple(
        np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size, base, np.uint64)]))
        for base in (_STEP, pow(_STEP, -1, 1 << 64))
    )


def word_hashes(text: str) -> np.ndarray:
    """A hash for each word: a longest run of letters and digits, in lower case."""
    values = _folded()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    inside = np.zeros(len(values) + 2, np.int8)
    np.not_equal(values, 0, out=inside[1:-1], casting="unsafe")
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[0::2], edges[1::2]
    up, down = _powers(1 << max(16, len(values).bit_length()))
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingles(text: str | None) -> np.ndarray:
    """Hashes of all runs of five words; of the whole text if it has fewer; none without words."""
    words = word_hashes(text) if text else np.zeros(0, np.uint64)
    if not len(words):
        return words
    width = min(WORDS, len(words))
    out = np.full(len(words) - width + 1, width, np.uint64)
    for k in range(width):
        out = mix(out ^ words[k : len(words) - width + 1 + k])
    return out


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Shared part of two sets given as sorted arrays without repeats."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / max(len(a) + len(b) - shared, 1)
