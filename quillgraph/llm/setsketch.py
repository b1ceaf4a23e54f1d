"""SetSketch registers: exponentially spaced truncated minima of a set of 64-bit hashes.

Register k is q = floor(1 - log_b x) + SHIFT, where x is the least of the elements' k-th exponential hash values, from 2^-65 to 45. The
shift keeps all of them within 16 bits, so that small sets are not truncated at 0 and do not meet there. Sketches of parts merge by
the register-wise maximum. Two sets' registers agree with probability close to their Jaccard similarity (b is near 1), so tuples of
registers are locality-sensitive; with both sizes known, the numbers of smaller, equal and larger registers give the most likely
similarity.
"""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash

BASE, REGISTERS, BANDS, ROWS = 1.001, 160, 40, 4
TOP, SHIFT = 65535, 4096
#: Odd multipliers, one a register, from a digest of its number.
MULTIPLIERS = np.array([int.from_bytes(hashlib.sha256(b"register%d" % k).digest()[:8], "little") | 1 for k in range(REGISTERS)], np.uint64)
#: Odd multipliers, one a place of a shingle.
PLACES = np.array([int.from_bytes(hashlib.sha256(b"place%d" % k).digest()[:8], "little") | 1 for k in range(8)], np.uint64)
WORDS = 5


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingles(text: str | None, n: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of a text's n-word shingles, A-Z lower-cased; with fewer words the whole sequence is one."""
    words = (text or "").encode().lower().split()  # of bytes: ASCII letters and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < n:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), 1)], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = len(h) - n + 1
    total = h[:size] * PLACES[0]
    for k in range(1, n):
        total += h[k : size + k] * PLACES[k]
    return np.unique(mixed(total))


def minima(hashes: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """The least k-th hash value for each k."""
    out = np.full(registers, 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), 384):
        np.minimum(out, np.multiply.outer(hashes[at : at + 384], MULTIPLIERS[:registers]).min(axis=0), out=out)
    return out


def registers_of(least: np.ndarray) -> np.ndarray:
    """Truncated exponents of the minima, as 16-bit numbers."""
    x = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64 * (1 - 1e-16))
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)) + SHIFT, 0, TOP).astype(np.uint16)


def sketch(hashes: np.ndarray) -> np.ndarray:
    return registers_of(minima(hashes))


def merged(*sketches: np.ndarray) -> np.ndarray:
    return np.maximum.reduce(sketches)


def band_keys(registers: np.ndarray) -> np.ndarray:
    """A signed 64-bit key for each band of each row of registers: the band's four registers, mixed with its number."""
    bands = np.ascontiguousarray(np.atleast_2d(registers)[:, : BANDS * ROWS]).view(np.uint64)
    return mixed(bands + mixed(np.arange(BANDS, dtype=np.uint64))).view(np.int64)


def _apart(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)


def likely(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """The most likely Jaccard similarity of each row of registers a with the same row of b, by ternary search."""
    a, b = np.atleast_2d(a), np.atleast_2d(b)
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - more - less
    total = size_a + size_b
    u, v = size_a / total, size_b / total
    low, high = np.zeros(len(a)), np.minimum(size_a, size_b) / np.maximum(size_a, size_b)

    def value(j: np.ndarray) -> np.ndarray:
        p, q = _apart(np.maximum(u - v * j, 1e-12)), _apart(np.maximum(v - u * j, 1e-12))
        return more * np.log(p) + less * np.log(q) + same * np.log(np.maximum(1 - p - q, 1e-12))

    for _ in range(40):
        third = (high - low) / 3
        left = value(low + third) < value(high - third)
        low, high = np.where(left, low + third, low), np.where(left, high, high - third)
    return (low + high) / 2
