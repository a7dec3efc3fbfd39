"""Markov clustering of one directed matrix."""

from __future__ import annotations

import numpy as np

INFLATIONS = (1.4, 1.8, 2.2, 3.0, 4.0)


def _columns(m: np.ndarray) -> np.ndarray:
    s = m.sum(axis=0)
    return m / np.where(s == 0, 1, s)


def mcl(a: np.ndarray, expansion: int = 2, inflation: float = 2.0, rounds: int = 100, tolerance: float = 1e-6) -> list[int]:
    """Labels. Self-loops of 1 whatever the weights' scale, no pruning."""
    m = np.array(a, float)
    np.fill_diagonal(m, 1.0)
    m = _columns(m)
    for _ in range(rounds):
        new = _columns(np.linalg.matrix_power(m, expansion) ** inflation)
        moved = np.abs(new - m).max(initial=0)
        m = new
        if moved < tolerance:
            break
    return attracted(m)


def attracted(m: np.ndarray) -> list[int]:
    """Each node goes to the first attractor (positive diagonal) that holds some of it, else to the strongest."""
    if not len(m):
        return []
    pulls = np.flatnonzero(np.diag(m) > 0)
    if not len(pulls):
        pulls = np.unique(m.argmax(axis=0))
    held = m[pulls] > 0
    owner = np.where(held.any(axis=0), held.argmax(axis=0), m[pulls].argmax(axis=0))
    return np.unique(pulls[owner], return_inverse=True)[1].tolist()
