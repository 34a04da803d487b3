"""Shingle sets and minwise signatures of whole texts, in numpy."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np

#: A signature is CHUNKS chunks of WIDTH symbols of 16 bits.
CHUNKS, WIDTH = 16, 5
SYMBOLS = CHUNKS * WIDTH
#: By the pigeonhole principle a pair with at most this many unequal symbols has a chunk with at most one.
DISTANCE = 2 * CHUNKS - 1

_BASE = 0x9E3779B97F4A7C15
_WHITE = np.zeros(256, bool)
_WHITE[[32, *range(9, 14)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every bit depends on every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _BASE modulo 2**64 and of its inverse."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.ones(1, np.uint64)
        while len(p) < n:
            p = np.concatenate([p, p * np.uint64(pow(base, len(p), 1 << 64))])
        out.append(p)
    return out[0], out[1]


def shingle_sets(texts: list[str], words: int):
    """The sorted distinct 64-bit shingle hashes of each text. Words end at ASCII white space, A-Z are lower-cased; a text
    of fewer words is one shingle, one without words has none."""
    raw = [t.encode("utf-8", "replace").lower() for t in texts]
    data = np.frombuffer(b"\n" + b"\n".join(raw) + b"\n", np.uint8)
    white = _WHITE[data]
    starts = np.flatnonzero(white[:-1] & ~white[1:]) + 1
    ends = np.flatnonzero(~white[:-1] & white[1:]) + 1
    size = 1 << max(16, (len(data) - 1).bit_length())
    power, inverse = _powers(size)
    sums = np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)])
    hashes = mix((sums[ends - 1] - sums[starts - 1]) * inverse[starts]) if len(starts) else np.zeros(0, np.uint64)
    bounds = np.searchsorted(starts, np.cumsum([1, *(len(r) + 1 for r in raw)]))
    count = max(0, len(hashes) - words + 1)
    rolled = np.zeros(count, np.uint64)
    for k in range(words):
        rolled = rolled * np.uint64(_BASE) + hashes[k : k + count]
    rolled = mix(rolled)
    for a, b in zip(bounds, bounds[1:], strict=False):
        if b - a >= words:
            yield np.unique(rolled[a : b - words + 1])
        elif b > a:
            whole = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for h in hashes[a:b]:
                    whole = whole * np.uint64(_BASE) + h
            yield mix(np.array([whole]))
        else:
            yield np.zeros(0, np.uint64)


@lru_cache(maxsize=1)
def _multipliers() -> np.ndarray:
    return mix(np.arange(1, SYMBOLS + 1, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)


def signature(shingles: np.ndarray) -> np.ndarray:
    """SYMBOLS symbols: 16 bits of the smallest of the shingles under as many hash functions."""
    least = np.full(SYMBOLS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2048):
        np.minimum(least, (shingles[at : at + 2048, None] * _multipliers()[None, :]).min(0), out=least)
    return (mix(least) >> np.uint64(48)).astype("<u2")


#: 64-bit words of a parity bitmap.
WORDS_OF_BITS = 32


def parity_bitmap(shingles: np.ndarray) -> np.ndarray:
    """Each shingle flips one of 2048 bits: two sets differ in at least as many shingles as their bitmaps in bits."""
    at = (shingles * np.uint64(_BASE)) >> np.uint64(64 - 11)
    odd = np.bincount(at.astype(np.int64), minlength=64 * WORDS_OF_BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def set_digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def chunk_keys(symbols: np.ndarray) -> np.ndarray:
    """(rows, SYMBOLS): for each chunk of each row the keys that leave one of its symbols out, so that two chunks which
    differ in at most one symbol share a key."""
    s = symbols.astype(np.uint64).reshape(len(symbols), CHUNKS, WIDTH)
    keys = np.empty((len(symbols), CHUNKS, WIDTH), np.uint64)
    for out in range(WIDTH):
        left = [k for k in range(WIDTH) if k != out]
        packed = np.zeros(s.shape[:2], np.uint64)
        for k in left:
            packed = (packed << np.uint64(16)) | s[:, :, k]
        seeds = mix((np.arange(CHUNKS, dtype=np.uint64) * np.uint64(WIDTH) + np.uint64(out + 1)) * np.uint64(_BASE))
        keys[:, :, out] = mix(packed ^ seeds[None, :])
    return keys.reshape(len(symbols), SYMBOLS)
