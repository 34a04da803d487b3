"""Hashed character n-gram features of whole texts, computed for batches of texts with numpy."""

from __future__ import annotations

import numpy as np

#: Length of the feature vector.
DIMENSION = 1 << 16
_MULTIPLIERS = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917))


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points of all texts, each text led and closed by a space, and where each text begins."""
    parts = [f" {t.lower()} " for t in texts]
    points = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), "<u4")
    starts = np.cumsum([0, *map(len, parts)])[:-1]
    letterless = points < 65  # digits, marks and white space count as one and the same break
    return np.where(letterless, np.uint32(32), points), starts


def ngram_buckets(points: np.ndarray, n: int, dimension: int = DIMENSION) -> np.ndarray:
    """The bucket of the n-gram that begins at each place; places in the last n - 1 are missing."""
    h = points[: len(points) - n + 1] * _MULTIPLIERS[0] + np.uint32(n)
    for k in range(1, n):
        h = (h ^ (h >> np.uint32(15))) * _MULTIPLIERS[k % 3] + points[k : len(points) - n + 1 + k] * _MULTIPLIERS[(k + 1) % 3]
    h ^= h >> np.uint32(16)
    return (h % np.uint32(dimension)).astype(np.int32)


def linear_scores(texts: list[str], weights: np.ndarray, sizes: tuple[int, ...]) -> np.ndarray:
    """(texts, columns): sums of weights (dimension, columns) over the n-grams of each text, divided by their number."""
    points, starts = code_points(texts)
    out = np.zeros((len(texts), weights.shape[1]))
    lengths = np.diff(np.append(starts, len(points)))
    total = np.zeros(len(texts))
    for n in sizes:
        buckets = ngram_buckets(points, n)
        if not len(buckets):
            continue
        # An n-gram that crosses from one text into the next is not counted.
        counted = np.maximum(lengths - n + 1, 0)
        ends = starts + counted
        for c in range(weights.shape[1]):
            sums = np.concatenate(([0.0], np.cumsum(weights[buckets, c].astype(np.float64))))
            out[:, c] += sums[np.minimum(ends, len(buckets))] - sums[np.minimum(starts, len(buckets))]
        total += counted
    return out / np.maximum(total, 1)[:, None]


def count_rows(texts: list[str], sizes: tuple[int, ...], dimension: int = DIMENSION):
    """For each text the buckets of its n-grams and their shares."""
    for t in texts:
        found, counts = bucket_counts(t, sizes, dimension)
        yield found, counts / max(1, counts.sum())


def bucket_counts(text: str, sizes: tuple[int, ...], dimension: int = DIMENSION) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of the text's n-grams and how many fall into each."""
    points, _ = code_points([text])
    buckets = np.concatenate([ngram_buckets(points, n, dimension) for n in sizes if len(points) >= n] or [np.zeros(0, np.int32)])
    return np.unique(buckets, return_counts=True)
