"""Hashed word shingles of whole texts, vectorised over batches of texts."""

from __future__ import annotations

import numpy as np

#: Bytes that stand between words: space and U+0009 to U+000D (fixed values).
_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z become a-z; all other bytes stay, and all get a value over 0.
_FOLD = np.arange(256, dtype=np.uint64) + np.uint64(1)
_FOLD[65:91] += np.uint64(32)
_BASE = 0x9E3779B97F4A7C15 | 1
_UNBASE = pow(_BASE, -1, 1 << 64)
#: Bytes hashed at a time (more if one word is longer).
SEGMENT = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2^64."""
    if _powers[0].size < n:
        for i, base in enumerate((_BASE, _UNBASE)):
            step = np.full(n, base, np.uint64)
            step[0] = 1
            _powers[i] = np.cumprod(step)
    return _powers[0][:n], _powers[1][:n]


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word of a buffer."""
    gap = _GAP[data]
    edge = np.flatnonzero(np.diff(gap.astype(np.int8), prepend=1, append=1))
    starts, ends = edge[0::2], edge[1::2]
    up, down = powers(data.size + 1)
    total = np.zeros(data.size + 1, np.uint64)
    np.cumsum(_FOLD[data] * up[:-1], out=total[1:])
    return starts, mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, one text after another, and each text's number of words."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    hashes, counts, at = [], np.zeros(len(texts), np.int64), 0
    while at < data.size:
        stop, reach = data.size, SEGMENT
        while at + reach < data.size:
            gaps = np.flatnonzero(_GAP[data[at + reach // 2 : at + reach]])
            if gaps.size:
                stop = at + reach // 2 + int(gaps[-1]) + 1
                break
            reach *= 2
        starts, h = _words(data[at:stop])
        counts += np.bincount(np.searchsorted(ends, starts + at, side="right"), minlength=len(texts))
        hashes.append(h)
        at = stop
    return np.concatenate(hashes), counts


def shingle_sets(texts: list[bytes], words: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text with fewer words has its whole sequence as one, one without words none."""
    if not texts:
        return []
    h, counts = word_hashes(texts)
    weights = [np.uint64(pow(_BASE, 3 + 2 * j, 1 << 64) | 1) for j in range(words)]
    first = np.cumsum(counts) - counts
    if h.size >= words:
        n = h.size - words + 1
        rows = np.zeros(n, np.uint64)
        for j, w in enumerate(weights):
            rows += h[j : j + n] * w
        rows = mix(rows + np.uint64(words))
    out = []
    for at, n in zip(first.tolist(), counts.tolist(), strict=True):
        if n >= words:
            out.append(np.unique(rows[at : at + n - words + 1]))
        elif n:
            few = h[at : at + n] * np.array(weights[:n], np.uint64)
            out.append(mix(few.sum(dtype=np.uint64, keepdims=True) + np.uint64(n)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
