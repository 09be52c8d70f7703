"""Shingle sets and MinHash values of many texts at once, in numpy.

Defined results: an empty text has an empty set, which has no MinHash values; a very long text is hashed in pieces that
end with white space; repeated shingles count once; equal texts have equal sets, so there are no ties.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np

N = 5
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
U = np.uint64
BASE = U(0x9E3779B97F4A7C15 | 1)
#: Bytes whose prefix sums are held at once.
PIECE = 1 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@functools.lru_cache(maxsize=1)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of BASE and of its inverse modulo 2 ** 64."""
    inverse = pow(int(BASE), -1, 1 << 64)
    one = np.ones(1, U)
    return tuple(np.concatenate([one, np.multiply.accumulate(np.full(n, b, U))]) for b in (BASE, U(inverse)))


def word_hashes(text: bytes) -> np.ndarray:
    """A hash of each word (no ASCII white space in it), ASCII capitals being equal to small letters."""
    data, out, start = np.frombuffer(text.lower(), np.uint8), [], 0
    while start < len(data):
        stop = min(len(data), start + PIECE)
        while stop < len(data) and not SPACE[data[stop - 1]]:  # a piece ends with white space
            more = np.flatnonzero(SPACE[data[stop : stop + PIECE]])
            stop = stop + int(more[0]) + 1 if len(more) else min(len(data), stop + PIECE)
        out.append(piece_hashes(data[start:stop]))
        start = stop
    return np.concatenate(out) if out else np.zeros(0, U)


def piece_hashes(data: np.ndarray) -> np.ndarray:
    edges = np.flatnonzero(np.diff(np.concatenate([[True], SPACE[data], [True]]).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    up, down = powers(max(PIECE, 1 << int(len(data)).bit_length()))
    sums = np.concatenate([np.zeros(1, U), np.cumsum((data.astype(U) + U(1)) * up[: len(data)], dtype=U)])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


def shingles(text: bytes) -> np.ndarray:
    """The set of hashes of the N-word shingles, sorted; a shorter text is one shingle, a text without words none."""
    words = word_hashes(text)
    if not len(words):
        return words
    n = min(N, len(words))
    total = np.zeros(len(words) - n + 1, U)
    for k in range(n):
        total = total * U(0xA0761D6478BD642F) + words[k : len(words) - n + 1 + k]
    return np.unique(mixed(total + U(n)))


def set_key(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


@functools.lru_cache(maxsize=2)
def functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_101)
    return rng.integers(0, 1 << 63, n, dtype=U), rng.integers(0, 1 << 63, n, dtype=U) * U(2) + U(1)


def minhash(hashes: np.ndarray, n: int) -> np.ndarray:
    """n 32-bit MinHash values of a set that isn't empty."""
    xor, times = functions(n)
    out = np.full(n, np.iinfo(U).max, U)
    for start in range(0, len(hashes), 1024):
        np.minimum(out, ((hashes[start : start + 1024, None] ^ xor) * times).min(axis=0), out=out)
    return (out >> U(32)).astype(np.uint32)
