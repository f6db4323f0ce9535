"""Linear scores over hashed byte n-grams, each document's counts taken as shares."""

from __future__ import annotations

import numpy as np

BITS = 14
SIZE = 1 << BITS
#: Positions worked on at once.
BLOCK = 1 << 20


def _numbers(data: np.ndarray, inside: np.ndarray, width: int) -> np.ndarray:
    n = len(inside)
    x = data[:n].astype(np.uint64)
    for k in range(1, width):
        x = (x << np.uint64(8)) | data[k : k + n]
    x = (x + np.uint64(width)) * np.uint64(0x9E3779B97F4A7C15)
    return (x >> np.uint64(64 - BITS)).astype(np.int64)[inside]


def blocks(data: np.ndarray, offsets: np.ndarray):
    """Feature numbers of byte pairs and triples with their documents, for a block of positions at a time."""
    for lo in range(0, len(data), BLOCK):
        hi = min(len(data), lo + BLOCK)
        first, last = np.searchsorted(offsets, [lo, hi - 1], "right") - 1
        ends = offsets[first + 1 : last + 2]
        sizes = np.diff(np.concatenate([[lo], np.minimum(ends, hi)]))
        doc = np.repeat(np.arange(first, last + 1), sizes)
        end = np.repeat(ends, sizes)
        for width in (2, 3):
            n = min(hi, len(data) - width + 1) - lo
            if n > 0:
                inside = np.arange(lo, lo + n) + width <= end[:n]
                yield _numbers(data[lo : lo + n + width - 1], inside, width), doc[:n][inside]


def counts(offsets: np.ndarray) -> np.ndarray:
    """How many features each document has, at least 1."""
    sizes = np.diff(offsets)
    return np.maximum(1, np.maximum(0, sizes - 1) + np.maximum(0, sizes - 2))


def dense(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Shares of all features by document: for samples."""
    n = len(offsets) - 1
    out = np.zeros((n, SIZE), np.float32)
    for i in range(n):
        for feature, _ in blocks(data[offsets[i] : offsets[i + 1]], np.array([0, offsets[i + 1] - offsets[i]])):
            out[i] += np.bincount(feature, minlength=SIZE)
    return out / counts(offsets)[:, None]


def scores(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Shares times ``weights`` (features by columns), a row for each document."""
    n = len(offsets) - 1
    out = np.zeros((n, weights.shape[1]))
    for feature, doc in blocks(data, offsets):
        if len(doc):
            lo, hi = doc[0], doc[-1] + 1
            for c in range(weights.shape[1]):
                out[lo:hi, c] += np.bincount(doc - lo, weights=weights[feature, c], minlength=hi - lo)
    return out / counts(offsets)[:, None]


def scales(shares: np.ndarray) -> np.ndarray:
    """What to multiply features by before fitting; those seen nowhere get 0."""
    spread = shares.std(axis=0)
    return np.where(spread > 0, 1 / (spread + spread.max() * 0.02 + 1e-12), 0).astype(np.float32)
