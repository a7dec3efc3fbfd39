"""Coordination cost of one matrix."""

from __future__ import annotations

import numpy as np


def cost(a: np.ndarray, labels, pow_cc: float = 1.0) -> float:
    labels = np.asarray(labels)
    if not len(labels):
        return 0.0
    w = np.where(a > 0, a, 0.0)
    np.fill_diagonal(w, 0)
    same = labels[:, None] == labels
    size = np.bincount(labels)[labels].astype(float)
    return float((w * np.where(same, (size**pow_cc)[:, None], float(len(a)) ** pow_cc)).sum())


def external_ratio(a: np.ndarray, labels) -> float:
    labels = np.asarray(labels)
    off = a - np.diag(np.diag(a))
    total = off.sum()
    return float((off * (labels[:, None] != labels)).sum() / total) if total else 0.0


def compact(labels) -> list[int]:
    """0..k-1 in the order of the old ids."""
    return np.unique(np.asarray(labels, int), return_inverse=True)[1].tolist() if len(labels) else []
