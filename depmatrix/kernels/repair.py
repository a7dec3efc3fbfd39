"""Bringing a partition within limits: size from below, size from above, fewer clusters, more clusters, in this order."""

from __future__ import annotations

import math

import numpy as np

from depmatrix.kernels.cost import compact
from depmatrix.kernels.spectral import spectral_cluster


def _order_of_sight(labels: np.ndarray) -> list[int]:
    _, first = np.unique(labels, return_index=True)
    return [int(labels[k]) for k in sorted(first)]


def grow_small(a: np.ndarray, labels, least: int) -> list[int]:
    """Elements of undersized clusters join the large one that they depend on most."""
    labels = np.asarray(labels, int)
    for _ in range(len(labels)):
        counts = np.bincount(labels, minlength=labels.max(initial=-1) + 1)
        large = [c for c in _order_of_sight(labels) if counts[c] >= least]
        small = np.flatnonzero(counts[labels] < least)
        if not len(small) or not large:
            break
        pull = np.array([a[:, labels == c].sum(axis=1) for c in large])
        labels = labels.copy()
        labels[small] = np.array(large)[pull[:, small].argmax(axis=0)]
    return compact(labels)


def _parts(a: np.ndarray, members: np.ndarray, k: int, chunks: list[int]) -> list[int]:
    try:
        got, _ = spectral_cluster(a[np.ix_(members, members)], k=k, low=2, high=k)
    except np.linalg.LinAlgError:
        return chunks
    return got if len(set(got)) > 1 else chunks


def split_large(a: np.ndarray, labels, most: int) -> list[int]:
    """Oversized clusters are split, the lowest id first; a part may be split again. most <= 0: no limit."""
    labels = np.asarray(labels, int)
    if most <= 0 or not len(labels):
        return compact(labels)
    free = int(labels.max()) + 1
    for _ in range(len(labels)):
        counts = np.bincount(labels)
        over = np.flatnonzero(counts > most)
        if not len(over):
            break
        members = np.flatnonzero(labels == over[0])
        n, k = len(members), max(2, math.ceil(len(members) / most))
        part = np.array(_parts(a, members, k, [min(t * k // n, k - 1) for t in range(n)]))
        labels = labels.copy()
        labels[members[part > 0]] = free + part[part > 0] - 1
        free += k - 1
    return compact(labels)


def merge_many(a: np.ndarray, labels, k: int, most: int) -> tuple[list[int], int]:
    """Merges the pair with most weight between it until k are left; pairs within the size limit come first, but the limit yields."""
    labels, both, merges = np.asarray(labels, int), a + a.T, 0
    while len(ids := np.unique(labels)) > max(1, k):
        member = (labels[:, None] == ids).astype(float)
        weight, size = member.T @ both @ member, member.sum(axis=0)
        pairs = [
            (bool(most > 0 and size[x] + size[y] > most), -weight[x, y], x, y) for x in range(len(ids)) for y in range(x + 1, len(ids))
        ]
        _, _, x, y = min(pairs)
        labels = np.where(labels == ids[y], ids[x], labels)
        merges += 1
    return compact(labels), merges


def split_few(a: np.ndarray, labels, k: int, least: int) -> tuple[list[int], int]:
    """Halves the largest cluster that can be until k exist; halves that keep the least size come first."""
    labels, splits = np.asarray(labels, int), 0
    free = int(labels.max(initial=-1)) + 1
    while len(set(labels.tolist())) < k:
        counts = {c: int((labels == c).sum()) for c in _order_of_sight(labels)}
        ranked = sorted(counts, key=lambda c: -counts[c])
        pick = next((c for c in ranked if counts[c] >= max(2, 2 * least)), next((c for c in ranked if counts[c] >= 2), None))
        if pick is None:
            break
        members = np.flatnonzero(labels == pick)
        half = math.ceil(len(members) / 2)
        part = np.array(_parts(a, members, 2, [0] * half + [1] * (len(members) - half)))
        labels = labels.copy()
        labels[members[part == 1]] = free
        free, splits = free + 1, splits + 1
    return compact(labels), splits


def within_limits(a: np.ndarray, labels, min_size: int, max_size: int, min_k: int, max_k: int) -> tuple[list[int], int, int]:
    """(labels, merges, splits). An empty matrix stays empty."""
    if not len(labels):
        return [], 0, 0
    out, merges = merge_many(a, split_large(a, grow_small(a, labels, min_size), max_size), max_k, max_size)
    out, splits = split_few(a, out, min_k, min_size)
    return out, merges, splits
