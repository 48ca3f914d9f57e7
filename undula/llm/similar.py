"""Similarity of shingle sets: hashes, bounds from small sketches, prefixes in a common order, exact comparison.

A text is the set of the hashes of its runs of words. An odd sketch keeps, for each of its bits, the parity of the number of shingles
that fall on it: the sketches of two sets differ in at most as many bits as there are shingles in just one of them, so a pair with too
many differing bits can't be similar, and no similar pair is lost. Two sets of which the similarity reaches t have one of the first
n - ceil(t n) + 1 shingles of each in common, whatever the common order is; common shingles come last in it, which only saves work.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np

#: Bits of a sketch: about twice as many as the set has members, within these.
LEAST_BITS, MOST_BITS = 512, 1 << 17


def shingle_hashes(ws: list[bytes], size: int, seed: int) -> np.ndarray:
    """XXH64 of every run of `size` words, joined by spaces, in order; of all words if they are fewer; nothing without words."""
    from xxhash import xxh64_intdigest

    if not ws:
        return np.zeros(0, dtype=np.uint64)
    if len(ws) <= size:
        return np.array([xxh64_intdigest(b" ".join(ws), seed)], dtype=np.uint64)
    if size == 3:
        shingles = map(b"%b %b %b".__mod__, zip(ws, ws[1:], ws[2:], strict=False))
    else:
        shingles = map(b" ".join, zip(*(ws[i:] for i in range(size)), strict=False))
    return np.fromiter((xxh64_intdigest(s, seed) for s in shingles), dtype=np.uint64, count=len(ws) - size + 1)


def odd_sketch(h: np.ndarray) -> bytes:
    """Of distinct hashes."""
    bits = min(MOST_BITS, max(LEAST_BITS, 2 << max(0, len(h) - 1).bit_length()))
    counts = np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def differing(a: bytes, b: bytes) -> int:
    """Bits in which two sketches differ; the longer one is folded to the length of the other."""
    x, y = sorted((np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64)), key=len)
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def may_be_similar(apart: int, na: int, nb: int, t: Fraction) -> bool:
    """Whether sets of na and nb members of which at least `apart` are in one only can reach the similarity."""
    return apart * (t.denominator + t.numerator) <= (t.denominator - t.numerator) * (na + nb)


def similar(a: np.ndarray, b: np.ndarray, t: Fraction) -> bool:
    """Of sorted distinct hashes."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * t.denominator >= t.numerator * (len(a) + len(b) - both)


def prefix(h: np.ndarray, common: np.ndarray, rank: np.ndarray, t: Fraction) -> np.ndarray:
    """The first shingles in the common order, of which similar sets share one. `common` is sorted, with its rank beside it."""
    n = len(h)
    place = np.zeros(n, dtype=np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, h), len(common) - 1)
        place = np.where(common[at] == h, rank[at], 0)
    return h[np.lexsort((h, place))][: n - -(-t.numerator * n // t.denominator) + 1]
