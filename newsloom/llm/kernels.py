"""Vectorised text kernels that the Arrow stages of this subpackage share.

Everything here is plain Python/numpy without Spark, so that it can be tested
alone and shipped to the workers.  A *word* is a maximal run of letters and
digits of any script, lower-cased; hashes are 64 bits wide.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import xxhash

_WORD = re.compile(r"[^\W_]+")
_M1 = np.uint64(0x9E3779B97F4A7C15)
_M2 = np.uint64(0xC2B2AE3D27D4EB4F)
_M3 = np.uint64(0x165667B19E3779F9)
_MASK = (1 << 64) - 1
#: The word-hash memo is emptied beyond this many entries: it is a cache only.
_MEMO_LIMIT = 1_000_000


def words(text: str | None) -> list[str]:
    """The words of a text; a null has none."""
    if not text:
        return []
    if "İ" in text:  # its lower case holds a combining mark, which is no letter
        return [w.lower() for w in _WORD.findall(text)]
    return _WORD.findall(text.lower())


class WordHash(dict):
    """word -> 64-bit hash, memoised."""

    def __missing__(self, word: str) -> int:
        if len(self) > _MEMO_LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, ws: list[str]) -> np.ndarray:
        return np.array([self[w] for w in ws], dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that the smallest hashes are a fair sample."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_hashes(word_hashes: np.ndarray, size: int = 3) -> np.ndarray:
    """One hash for every run of ``size`` words, in text order."""
    n = len(word_hashes) - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    acc = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        acc = (acc + word_hashes[k : k + n]) * (_M1 if k % 2 == 0 else _M2) + _M3
    return mix(acc)


def shingle_set(text: str | None, memo: WordHash, size: int = 3) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    return np.unique(shingle_hashes(memo.of(words(text)), size))


class MinHash:
    """``n`` minima of multiply-xor hash functions over 32 bits."""

    def __init__(self, n: int, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.a = rng.integers(1, 1 << 32, n, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
        self.x = rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        h = (hashes >> np.uint64(16)).astype(np.uint32)
        v = (h[None, :] ^ self.x[:, None]) * self.a[:, None]
        v ^= v >> np.uint32(15)
        v *= np.uint32(0x2C1B3C6D)
        return v.min(axis=1)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sorted distinct arrays; two empty ones have none."""
    if not len(a) or not len(b):
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` neighbours (block prefix/suffix minima)."""
    n = len(v)
    if n < w:
        return np.empty(0, dtype=v.dtype)
    blocks = -(-n // w)
    pad = np.full(blocks * w, np.iinfo(v.dtype).max, dtype=v.dtype)
    pad[:n] = v
    m = pad.reshape(blocks, w)
    left = np.minimum.accumulate(m, axis=1).ravel()
    right = np.minimum.accumulate(m[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


_POW: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(12, (n - 1).bit_length())
    if size not in _POW:
        tables = []
        for b in (_BASE, _INVERSE):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            tables.append(np.multiply.accumulate(p))
        _POW[size] = tuple(tables)
    return _POW[size]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def window_hashes(points: np.ndarray, k: int) -> np.ndarray:
    """A hash of every ``k`` consecutive code points, by prefix sums mod 2**64."""
    n = len(points)
    if n < k:
        return np.empty(0, dtype=np.uint64)
    up, down = _powers(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * _M2 * up[:n], out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * down[: n - k + 1])


def rolling_word_hashes(word_hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of every run of ``n`` words, by prefix sums mod 2**64."""
    m = len(word_hashes)
    if m < n:
        return np.empty(0, dtype=np.uint64)
    up, down = _powers(m + 1)
    sums = np.zeros(m + 1, dtype=np.uint64)
    np.cumsum(word_hashes * up[:m], out=sums[1:])
    return mix((sums[n:] - sums[:-n]) * down[: m - n + 1])


def set_digest(hashes: np.ndarray) -> int:
    """A signed 64-bit name of a set of hashes."""
    d = xxhash.xxh64_intdigest(np.ascontiguousarray(hashes).tobytes())
    return d - (1 << 64) if d >> 63 else d


def batches(it: Iterable, column: str) -> Iterator[tuple[object, list]]:
    """Arrow batches with one column as a Python list."""
    for batch in it:
        yield batch, batch.column(column).to_pylist()
