"""A hierarchical index over 64-bit fingerprints in Gray order, with numpy.

Fingerprints of a bucket are sorted by Gray rank, so that neighbours share many bits. Every FAN consecutive entries make a
node; a node keeps the bits on which all its entries agree (mask and value), and its parent factors out what all its
children share. A self-join walks pairs of nodes from the top: the differing bits among those that both nodes fix are
accumulated downward, and a pair of nodes, with all that lies below it, is pruned once they exceed the limit. All buckets
are walked at once; pairs are expanded in slabs, so memory is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

FAN = 8
MOST_PAIRS = 1 << 20
U = np.uint64
ALL = U(0xFFFFFFFFFFFFFFFF)


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The position of each word in the reflected Gray code."""
    x = x.astype(U)
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> U(s))
    return x


class _Level:
    def __init__(self, mask: np.ndarray, value: np.ndarray, bucket: np.ndarray, first: np.ndarray | None, n: np.ndarray | None):
        self.mask, self.value, self.bucket, self.first, self.n = mask, value, bucket, first, n


def build(bucket: np.ndarray, words: np.ndarray) -> list[_Level]:
    """Levels from the entries up to one node a bucket; entries are sorted by bucket and Gray rank."""
    levels = [_Level(np.full(len(words), ALL), words, bucket, None, None)]
    while True:
        low = levels[-1]
        new = np.flatnonzero(np.r_[True, low.bucket[1:] != low.bucket[:-1]])
        if len(levels) > 1 and len(new) == len(low.bucket):
            return levels
        inside = np.arange(len(low.bucket)) - np.repeat(new, np.diff(np.r_[new, len(low.bucket)]))
        first = np.flatnonzero(inside % FAN == 0)
        ones = np.bitwise_and.reduceat(low.value & low.mask, first)
        zeros = np.bitwise_and.reduceat(~low.value & low.mask, first)
        levels.append(_Level(ones | zeros, ones, low.bucket[first], first, np.diff(np.r_[first, len(low.bucket)])))


def close_pairs(bucket: np.ndarray, words: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i < j) of all pairs within a bucket that differ in at most `limit` bits, slab by slab."""
    if not len(words):
        return
    levels = build(bucket, words)
    top = np.arange(len(levels[-1].bucket))
    stack = [(len(levels) - 1, top, top, np.zeros(len(top), np.int16), levels[-1].mask)]
    while stack:
        k, p, q, acc, common = stack.pop()
        if k == 0:
            keep = p < q
            if keep.any():
                yield p[keep], q[keep]
            continue
        low, size = levels[k - 1], levels[k].n[p] * levels[k].n[q]
        if len(p) > 1 and size.sum() > MOST_PAIRS:
            half = len(p) // 2
            stack += [(k, *(x[half:] for x in (p, q, acc, common))), (k, *(x[:half] for x in (p, q, acc, common)))]
            continue
        of = np.repeat(np.arange(len(p)), size)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
        c = levels[k].first[p][of] + nth // levels[k].n[q][of]
        d = levels[k].first[q][of] + nth % levels[k].n[q][of]
        keep = c <= d if k > 1 else c < d
        of, c, d = of[keep], c[keep], d[keep]
        both = low.mask[c] & low.mask[d]
        now = acc[of] + np.bitwise_count((low.value[c] ^ low.value[d]) & both & ~common[of]).astype(np.int16)
        keep = now <= limit
        if keep.any():
            stack.append((k - 1, c[keep], d[keep], now[keep], both[keep]))


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of n entries the smallest entry that it can reach over the pairs."""
    root = np.arange(n)
    for a, b in pairs:
        while True:
            ra, rb = root[a], root[b]
            if (ra == rb).all():
                break
            low = np.minimum(ra, rb)
            np.minimum.at(root, ra, low)
            np.minimum.at(root, rb, low)
            while (nxt := root[root]).tobytes() != root.tobytes():
                root = nxt
    return root
