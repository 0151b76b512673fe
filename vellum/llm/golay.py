"""The perfect binary Golay code of length 23 as a fuzzy hash.

Every 23-bit word lies within distance 3 of exactly one of the 4096 codewords. The keys of a word are the
codewords to which the words within distance 1 of it decode: one key if the word lies within distance 2 of
its codeword, else six. Two words at distance 2 or less have a neighbour in common and so share a key; of
two words at distance 1 or less, each decodes to one of the other's keys.
"""

from __future__ import annotations

import functools
from itertools import combinations

import numpy as np

#: Generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
LENGTH = 23


def _remainder(word: int) -> int:
    for bit in range(LENGTH - 1, 10, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - 11)
    return word


@functools.cache
def tables() -> tuple[np.ndarray, np.ndarray]:
    """(syndromes of the upper 12 bits, error pattern by syndrome)."""
    upper = np.array([_remainder(u << 11) for u in range(1 << 12)], dtype=np.uint32)
    errors = np.zeros(1 << 11, dtype=np.uint32)
    for weight in range(1, 4):
        for bits in combinations(range(LENGTH), weight):
            e = sum(1 << b for b in bits)
            errors[_remainder(e)] = e
    return upper, errors


def decode(words: np.ndarray) -> np.ndarray:
    """The index (0 to 4095) of the codeword nearest to each 23-bit word."""
    upper, errors = tables()
    w = words.astype(np.uint32)
    return (w ^ errors[upper[w >> 11] ^ (w & 0x7FF)]) >> 11


def keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): the distinct keys of each word, one or six of them."""
    w = words.astype(np.uint32)
    ball = np.concatenate([w[:, None], w[:, None] ^ (np.uint32(1) << np.arange(LENGTH, dtype=np.uint32))], axis=1)
    found = np.sort(decode(ball.ravel()).reshape(ball.shape), axis=1)
    new = np.ones(found.shape, dtype=bool)
    new[:, 1:] = found[:, 1:] != found[:, :-1]
    row, at = np.nonzero(new)
    return row, found[row, at]
