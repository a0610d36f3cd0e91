"""The perfect binary Golay code [23, 12, 7] as a fuzzy hash of 23-bit words."""

from __future__ import annotations

import functools

import numpy as np

N, K = 23, 12
GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1


def _remainder(words: np.ndarray) -> np.ndarray:
    """Syndromes: the words as polynomials modulo the generator."""
    out = words.astype(np.int64)
    for bit in range(N - 1, N - K - 1, -1):
        out ^= np.where((out >> bit) & 1, GENERATOR << (bit - 11), 0)
    return out


@functools.lru_cache(1)
def _leaders() -> np.ndarray:
    """For each of the 2048 syndromes the one error pattern of weight 3 or less that has it."""
    table = np.zeros(1 << 11, np.int64)
    ones = 1 << np.arange(N, dtype=np.int64)
    errors = [ones[:, None], ones[:, None] ^ ones[None, :], ones[:, None, None] ^ ones[None, :, None] ^ ones[None, None, :]]
    for e in errors:
        e = np.unique(e.ravel())
        e = e[e > 0]
        table[_remainder(e)] = e
    return table


def decode(words: np.ndarray) -> np.ndarray:
    """The index (its 12 information bits) of the codeword within three bits of each word."""
    words = words.astype(np.int64)
    return (words ^ _leaders()[_remainder(words)]) >> (N - K)


def nearby(words: np.ndarray, bits: int = N) -> np.ndarray:
    """Rows of bits + 1 indices: of the word itself (first) and of it with each of its low `bits` bits flipped.

    Two words at distance 2 share a value of their rows; at distance 1 the row of either holds the other's first value.
    """
    flips = np.concatenate([[0], 1 << np.arange(bits, dtype=np.int64)])
    return decode(words[:, None].astype(np.int64) ^ flips[None, :])
