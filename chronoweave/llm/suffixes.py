"""Suffix arrays of byte strings by two-stage sorting, and adjacent common prefixes.

A suffix that is smaller than its successor is sorted directly; every other suffix is induced: in one scan over the buckets of
first bytes, from small to large, each placed suffix places the one that starts a byte earlier.  Comparisons stop at ``depth``
bytes, so suffixes with equal prefixes of that length are neighbours in no fixed order.
"""

from __future__ import annotations

import numpy as np


def words(t: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as a big-endian number, zeros beyond the end."""
    padded = np.concatenate([t, np.zeros(8, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(t), np.uint64)
    for i in range(8):
        out = (out << np.uint64(8)) | padded[i : i + len(t)]
    return out


def _at(w: np.ndarray, i: np.ndarray) -> np.ndarray:
    """Words at positions, zero beyond the end."""
    inside = i < len(w)
    return np.where(inside, w[np.minimum(i, len(w) - 1)], np.uint64(0))


def smaller_than_next(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the suffix one byte later; the last one is not."""
    n = len(t)
    ends = np.flatnonzero(np.append(t[1:] != t[:-1], True))  # last position of each run of equal bytes
    rises = np.zeros(len(ends), bool)
    rises[:-1] = t[np.minimum(ends[:-1] + 1, n - 1)] > t[ends[:-1]]
    return np.repeat(rises, np.diff(ends, prepend=-1))


def sort_directly(positions: np.ndarray, w: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of their suffixes' first ``depth`` bytes: words are compared only while suffixes tie."""
    order = positions[np.argsort(w[positions], kind="stable")]
    key = w[order]
    tied = np.arange(len(order))
    group = np.zeros(len(order), np.int64)
    group[1:] = np.cumsum(key[1:] != key[:-1])
    for offset in range(8, depth, 8):
        size = np.bincount(group)
        keep = size[group] > 1
        tied, group = tied[keep], group[keep]
        if not len(tied):
            break
        here = order[tied]
        key = _at(w, here + offset)
        # ties of two, as two copies of a text make them, stand side by side and are swapped or not; only larger ones are sorted
        by = np.arange(len(tied))
        two = size[size > 1][np.cumsum(np.append(0, group[1:] != group[:-1]))] == 2
        a = np.flatnonzero(two)[::2]
        a = a[key[a] > key[a + 1]]
        by[a], by[a + 1] = a + 1, a
        more = np.flatnonzero(~two)
        by[more] = more[np.lexsort((key[more], group[more]))]
        order[tied], key, group = here[by], key[by], group[by]
        new = np.zeros(len(tied), np.int64)
        new[1:] = np.cumsum((key[1:] != key[:-1]) | (group[1:] != group[:-1]))
        group = new
    return order


def suffix_array(t: np.ndarray, depth: int = 100, w: np.ndarray | None = None) -> np.ndarray:
    """Start positions in the order of the suffixes, exact to ``depth`` bytes."""
    n = len(t)
    if not n:
        return np.zeros(0, np.int64)
    w = words(t) if w is None else w
    direct = smaller_than_next(t)
    placed = sort_directly(np.flatnonzero(direct), w, depth)
    first = t[placed]
    cuts = np.searchsorted(first, np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    induced[t[n - 1]].append(np.array([n - 1]))  # from the empty suffix, the smallest of all
    out = []
    for c in range(256):
        parts = induced[c]
        front = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        own = [front]
        while len(front):  # runs of one byte place suffixes into the bucket being scanned
            front = front[front > 0] - 1
            front = front[(t[front] == c) & ~direct[front]]
            own.append(front)
        bucket = np.concatenate([*own, placed[cuts[c] : cuts[c + 1]]])
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[~direct[before] & (t[before] > c)]
        if len(before):
            goes = t[before]
            by = np.argsort(goes, kind="stable")
            goes, before = goes[by], before[by]
            starts = np.flatnonzero(np.append(True, goes[1:] != goes[:-1]))
            for a, b in zip(starts, [*starts[1:], len(goes)]):
                induced[goes[a]].append(before[a:b])
    return np.concatenate(out)


def adjacent_prefixes(w: np.ndarray, order: np.ndarray, depth: int = 100) -> np.ndarray:
    """Common prefix of each suffix in ``order`` with the one before it, at most ``depth`` bytes; 0 for the first."""
    out = np.zeros(len(order), np.int64)
    if len(order) < 2:
        return out
    live = np.arange(1, len(order))
    for offset in range(0, depth, 8):
        x = _at(w, order[live] + offset) ^ _at(w, order[live - 1] + offset)
        same = x == 0
        # equal leading bytes of the first word that differs
        rest, differs = live[~same], x[~same]
        bits = np.frexp((differs >> np.uint64(32)).astype(np.float64))[1]
        low = np.frexp((differs & np.uint64(0xFFFFFFFF)).astype(np.float64))[1]
        out[rest] = offset + (64 - np.where(bits > 0, bits + 32, low)) // 8
        live = live[same]
        if not len(live):
            break
    out[live] = depth
    return np.minimum(out, depth)
