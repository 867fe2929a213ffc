"""Vectorised word hashing of batches of texts."""

from __future__ import annotations

import numpy as np

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64: every input bit reaches every output bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_WORD = np.zeros(256, dtype=bool)
for _c in b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ_":
    _WORD[_c] = True
_WORD[128:] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    got = _powers.get(base)
    if got is None or len(got) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        got = np.full(size, base, dtype=_U)
        got[0] = 1
        _powers[base] = got = np.cumprod(got, dtype=_U)
    return got[:n]


def power_sums(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the slices [begin, end) of values, by differences of running sums weighted with powers."""
    total = np.concatenate((np.zeros(1, _U), np.cumsum(values * _power(_BASE, len(values)), dtype=_U)))
    return mix((total[end] - total[begin]) * _power(_INVERSE, len(values))[begin] + (end - begin).astype(_U))


def spans(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of the texts (a zero byte ends each), where words begin and end in them, the words' 64-bit hashes, and
    where each text's bytes begin (one more entry than texts).

    A word is a maximal run of ASCII letters, digits, "_" and non-ASCII characters; lower case is up to the caller.
    """
    coded = [x.encode("utf-8", "surrogatepass") for x in texts]
    raw = np.frombuffer(b"\0".join(coded) + b"\0", dtype=np.uint8)
    inside = _WORD[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside)).view(np.int8)))
    begin, end = edge[::2], edge[1::2]
    hashes = power_sums(_BYTE[raw], begin, end)
    at = np.concatenate(([0], np.cumsum([len(x) + 1 for x in coded], dtype=np.int64)))
    return raw, begin, end, hashes, at


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, text by text, and each text's first index (one more entry than texts)."""
    _, begin, _, hashes, at = spans(texts)
    return hashes, np.searchsorted(begin, at)


def shingles(hashes: np.ndarray, first: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of n words and each text's first index. A text of 1 to n - 1 words is one window."""
    count = np.diff(first)
    windows = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    at = np.concatenate(([0], windows.cumsum()))
    doc = np.repeat(np.arange(len(count)), windows)
    start = first[:-1][doc] + np.arange(at[-1]) - at[:-1][doc]
    out = np.zeros(len(doc), dtype=_U)
    for k in range(n):
        here = start + k
        ok = here < first[1:][doc]
        out = mix(out * _U(3) + np.where(ok, hashes[np.minimum(here, max(len(hashes) - 1, 0))], _U(k + 1)) if len(hashes) else out)
    return out, at
