"""Deterministic token vectors and subword hashes; 64-bit arithmetic that wraps, so numpy, never SQL."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_M64 = (1 << 64) - 1


@lru_cache(maxsize=16)
def _steps(dims: int) -> tuple[np.ndarray, np.ndarray]:
    """x -> a*x + b taken 1 to dims times, as factors and summands modulo 2**64."""
    factors, summands, a, b = [], [], 1, 0
    for _ in range(dims):
        a, b = a * 6364136223846793005 & _M64, (b * 6364136223846793005 + 1) & _M64
        factors.append(a), summands.append(b)
    return np.array(factors, np.uint64), np.array(summands, np.uint64)


def _seed(token: str) -> int:
    seed = 0
    for b in token.encode("utf-8", "replace"):
        seed = (seed * 131 + b + 17) & _M64
    return seed


def deterministic_vectors(tokens: list[str], dims: int) -> np.ndarray:
    """A fixed vector in [-1, 1] for each token: a linear congruential sequence seeded by its bytes."""
    factors, summands = _steps(dims)
    state = np.array([_seed(t) for t in tokens], np.uint64)[:, None] * factors + summands
    return (state >> np.uint64(32)).astype(np.float32) / np.float32(0xFFFFFFFF) * np.float32(2) - np.float32(1)


def deterministic_vector(token: str, dims: int) -> np.ndarray:
    return deterministic_vectors([token], dims)[0]


def subword_vector(token: str, dims: int, min_n: int = 3, max_n: int = 5) -> np.ndarray:
    """The mean of the vectors of all character n-grams of <token>; of <token> itself if there are none."""
    word = f"<{token}>"
    grams = [word[i : i + n] for n in range(min_n, max_n + 1) for i in range(len(word) - n + 1)]
    return deterministic_vectors(grams or [word], dims).mean(axis=0, dtype=np.float64)


def subword_vectors(tokens: list[str], dims: int, min_n: int = 3, max_n: int = 5) -> np.ndarray:
    """subword_vector of each token, a row each.

    The seed of an n-gram comes from sums over the bytes up to its end and up to its start, scaled by powers of 131, which is odd and so has an inverse.
    """
    if not tokens:
        return np.zeros((0, dims))
    factors, summands = _steps(dims)
    out = np.zeros((len(tokens), dims))
    for at in range(0, len(tokens), 2048):
        words = [f"<{t}>".encode("utf-8", "replace") for t in tokens[at : at + 2048]]
        data = np.frombuffer(b"".join(words), np.uint8)
        ups, downs = _powers(max(map(len, words)) + 1)
        ends = np.cumsum([len(w) for w in words])
        begins = np.r_[0, ends[:-1]]
        of = np.repeat(np.arange(len(words)), ends - begins)
        place = np.arange(len(data)) - begins[of]
        sums = np.r_[np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(17)) * downs[place])]  # each byte by 131 to the power of minus its place
        first = np.flatnonzero((data & 0xC0) != 0x80)  # of characters
        word = of[first]
        chars = np.bincount(word, minlength=len(words))
        left = np.cumsum(chars)[word] - np.arange(len(first))  # characters from here to the end of the word
        stop = np.r_[first, len(data)]
        starts, stops, owner = [], [], []
        for n in range(min_n, max_n + 1):
            k = np.flatnonzero(left >= n)
            starts.append(first[k]), stops.append(stop[k + n]), owner.append(word[k])
        alone = np.flatnonzero(chars < min_n)
        starts.append(begins[alone]), stops.append(ends[alone]), owner.append(alone)
        start, end, owner = (np.concatenate(c) for c in (starts, stops, owner))
        seeds = (sums[end] - sums[start]) * ups[end - begins[owner] - 1]
        order = np.argsort(owner, kind="stable")
        rows = ((seeds[order, None] * factors + summands) >> np.uint64(32)).astype(np.float32) / np.float32(0xFFFFFFFF) * np.float32(2) - np.float32(1)
        n = np.bincount(owner, minlength=len(words))
        out[at : at + len(words)] = np.add.reduceat(rows.astype(np.float64), np.r_[0, np.cumsum(n)[:-1]], axis=0) / n[:, None]
    return out


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """131 to the powers 0 to n - 1 and 0 to 1 - n, modulo 2**64."""
    with np.errstate(over="ignore"):
        return tuple(np.r_[np.uint64(1), np.cumprod(np.full(n - 1, base, np.uint64))] for base in (131, pow(131, -1, 1 << 64)))


def fnv1a(data: bytes) -> int:
    """32-bit FNV-1a over sign-extended bytes."""
    h = 2166136261
    for b in data:
        h = ((h ^ (b | 0xFFFFFF00 if b > 127 else b)) * 16777619) & 0xFFFFFFFF
    return h


def subword_hashes(word: str, min_n: int, max_n: int, buckets: int, n_words: int) -> list[int]:
    """Rows of a subword matrix for a word: n-grams of <word>, without single boundary marks."""
    if buckets <= 0 or max_n <= 0:
        return []
    chars = f"<{word}>"
    out = []
    for i in range(len(chars)):
        for n in range(1, max_n + 1):
            if i + n > len(chars):
                break
            if n >= min_n and not (n == 1 and (i == 0 or i + n == len(chars))):
                out.append(fnv1a(chars[i : i + n].encode()) % buckets + n_words)
    return out
