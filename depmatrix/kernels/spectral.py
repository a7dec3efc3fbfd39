"""Spectral clustering and the Fiedler vector of one matrix."""

from __future__ import annotations

import numpy as np


def laplacian(a: np.ndarray) -> np.ndarray:
    """Normalised Laplacian of the symmetrised matrix; degrees are at least 1e-10."""
    s = (a + a.T) / 2
    np.fill_diagonal(s, 0)
    r = 1 / np.sqrt(np.maximum(s.sum(axis=1), 1e-10))
    return np.eye(len(s)) - s * np.outer(r, r)


def eigengap(values: np.ndarray, low: int, high: int) -> int:
    """The number of clusters before the widest gap among the eigenvalues after the first."""
    gaps = np.diff(values[1 : high + 2])
    return int(np.argmax(gaps)) + 2 if len(gaps) else low


def kmeans(x: np.ndarray, k: int, seed: int = 42, restarts: int = 20, rounds: int = 300) -> np.ndarray:
    """Labels of the best of several k-means++ starts."""
    rng, best, labels = np.random.default_rng(seed), np.inf, np.zeros(len(x), int)
    for _ in range(restarts):
        centre = x[[rng.integers(len(x))]]
        while len(centre) < k:
            d = ((x[:, None] - centre) ** 2).sum(axis=2).min(axis=1)
            p = d / d.sum() if d.sum() > 0 else None
            centre = np.vstack([centre, x[rng.choice(len(x), p=p)]])
        for _ in range(rounds):
            d = ((x[:, None] - centre) ** 2).sum(axis=2)
            now = d.argmin(axis=1)
            new = np.array([x[now == c].mean(axis=0) if (now == c).any() else x[d.min(axis=1).argmax()] for c in range(k)])
            if np.allclose(new, centre, atol=1e-10):
                break
            centre = new
        if (inertia := d.min(axis=1).sum()) < best - 1e-12:
            best, labels = inertia, now
    return np.unique(labels, return_inverse=True)[1]


def spectral_cluster(a: np.ndarray, k: int | None = None, low: int = 2, high: int = 10, seed: int = 42) -> tuple[list[int], np.ndarray]:
    """(labels, eigenvalues). k None: by eigengap; always within low..high and the matrix's size."""
    n = len(a)
    if n < 2:
        return [0] * n, np.zeros(n)
    low = max(2, min(low, n - 1))
    high = max(low, min(high, n - 1))
    values, vectors = np.linalg.eigh(laplacian(a))
    k = max(low, min(high, k if k else eigengap(values, low, high)))
    x = vectors[:, :k]
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-10)
    return kmeans(x, min(k, n), seed).tolist(), values


def fiedler(a: np.ndarray) -> np.ndarray:
    """The second eigenvector, its sign such that the positive part is at least as strong as the negative one."""
    if len(a) < 2:
        return np.zeros(len(a))
    v = np.linalg.eigh(laplacian(a))[1][:, 1]
    return -v if (v[v < 0] ** 2).sum() > (v[v > 0] ** 2).sum() else v
