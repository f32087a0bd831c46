"""Word shingles of texts as 64-bit hashes, a batch of texts at a time.

Texts are lower-cased (A-Z only) and cut into words at space and the controls 9
to 13; a shingle is `n` words in a row, or all words of a text that has fewer.
A shingle's hash is that of its words joined by one space: a polynomial over
the bytes, from prefix sums, mixed and with the length taken in.
"""

from __future__ import annotations

import numpy as np

N = 5
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_PI = np.uint64(pow(int(_P), -1, 2**64))
_pow = np.ones(1, np.uint64)
_inv = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        m = max(n, 2 * len(_pow))
        with np.errstate(over="ignore"):
            a, b = np.full(m, _P), np.full(m, _PI)
            a[0] = b[0] = 1
            _pow, _inv = np.multiply.accumulate(a), np.multiply.accumulate(b)
    return _pow[:n], _inv[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def normalised(text: str | None) -> bytes:
    """The words of a text, lower-cased and joined by one space."""
    return b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())


def shingle_hashes(norm: bytes, n: int = N) -> np.ndarray:
    """The sorted distinct shingle hashes of a normalised text."""
    if not norm:
        return np.empty(0, np.uint64)
    raw = np.frombuffer(norm, np.uint8)
    power, inverse = _powers(len(raw) + 1)
    prefix = np.empty(len(raw) + 1, np.uint64)
    prefix[0] = 0
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[:-1], out=prefix[1:])
    gaps = np.flatnonzero(raw == 32)
    starts = np.concatenate(([0], gaps + 1))
    ends = np.concatenate((gaps, [len(raw)]))
    if len(starts) > n:
        starts, ends = starts[: len(starts) - n + 1], ends[n - 1 :]
    elif len(starts) < n or len(starts) == n:
        starts, ends = starts[:1], ends[-1:]
    span = (prefix[ends] - prefix[starts]) * inverse[starts]
    return np.unique(mix64(span ^ mix64((ends - starts).astype(np.uint64))))


def common(a: np.ndarray, b: np.ndarray) -> int:
    """How many values two sorted distinct arrays share."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int((b[at] == a).sum())
