"""Word and shingle hashes of UTF-8 texts, in numpy: the helper of the operators on shingles."""

from __future__ import annotations

import hashlib

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1
CHUNK = 1 << 20
#: Eight bytes each, of words hashed without a digest.
LANES = 8
_U = np.uint64
_ALL = _U(0xFFFFFFFFFFFFFFFF)
_IS_WHITE = np.zeros(256, bool)
_IS_WHITE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64, for i < n."""
    if len(_powers[0]) < n:
        n = max(n, 1 << 16)
        for k, b in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            p = np.full(n, b, _U)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def text_bytes(text: str | None, lower: bool = True) -> np.ndarray:
    b = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    return _LOWER[b] if lower else b


def prefix_sums(b: np.ndarray) -> np.ndarray:
    """p with: the hash of b[i:j] is (p[j] - p[i]) * inverse[i]."""
    p = np.zeros(len(b) + 1, _U)
    np.cumsum((b.astype(_U) + _U(1)) * powers(len(b))[0][: len(b)], out=p[1:])
    return p


def word_spans(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = np.diff(np.concatenate(([False], ~_IS_WHITE[b], [False])).astype(np.int8))
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)


def word_hashes(b: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word: eight bytes at a time go through the finalizer; words over LANES times eight bytes have a BLAKE2 digest.

    Long texts go in pieces that end between words, so memory follows the piece, not the text.
    """
    starts, ends = word_spans(b)
    out = np.empty(len(starts), _U)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + CHUNK, "right")))
        lo, hi = starts[i], ends[j - 1]
        piece = np.zeros(hi - lo + 8, np.uint8)
        piece[:-8] = b[lo:hi]
        lanes = np.ndarray(len(piece) - 7, "<u8", piece, 0, (1,))
        at, n = starts[i:j] - lo, ends[i:j] - starts[i:j]
        h = mix(n.astype(_U) * _U(BASE) + _U(seed))
        some = np.arange(len(at))
        for k in range(LANES):
            left = n[some] - 8 * k
            some, left = some[left > 0], left[left > 0]
            if not len(some):
                break
            x = lanes[at[some] + 8 * k] & (_ALL >> ((8 - np.minimum(left, 8)) * 8).astype(_U))
            h[some] = mix((h[some] ^ x) * _U(BASE) + _U(k + 1))
        for w in np.flatnonzero(n > 8 * LANES).tolist():
            word = piece[at[w] : at[w] + n[w]].tobytes()
            h[w] = int.from_bytes(hashlib.blake2b(word, digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "little")
        out[i:j] = h
        i = j
    return out


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k words; of the whole sequence where there are fewer; none without words."""
    k = min(k, len(h))
    if not k:
        return h[:0]
    n = len(h) - k + 1
    out = np.zeros(n, _U)
    for i in range(k):
        out = mix(out * _U(3) + h[i : i + n] + _U(i + 1))
    return out
