"""Order within a block, strong components, tearing."""

from __future__ import annotations

import math
import random

import numpy as np

from depmatrix.kernels.bridges import largest_after


def feedback(a: np.ndarray, order=None) -> float:
    """Weight above the diagonal in the given order."""
    m = a if order is None else a[np.ix_(order, order)]
    return float(np.triu(m, 1).sum())


def anneal(a: np.ndarray, members: list[int], steps: int = 8000, seed: int | None = None) -> list[int]:
    """Members in an order of less feedback. A swap's effect is found from the two rows and columns, not from the whole matrix."""
    n = len(members)
    if n <= 2:
        return list(members)
    rng, m = random.Random(seed), a[np.ix_(members, members)].astype(float)
    skew = m - m.T  # what (x before y) adds against (y before x)
    order, now = np.arange(n), feedback(m)
    best, kept = now, order.copy()
    for step in range(steps):
        heat = 0.001 ** (step / steps)
        i, j = sorted(rng.sample(range(n), 2))
        x, y, mid = order[i], order[j], order[i + 1 : j]
        delta = skew[y, x] + skew[y, mid].sum() + skew[mid, x].sum()
        if delta < 0 or rng.random() < math.exp(-min(delta / max(heat, 1e-12), 700)):
            order[i], order[j] = y, x
            now += delta
            if now < best - 1e-12:
                best, kept = now, order.copy()
    return [members[k] for k in kept]


def anneal_links(n: int, source: np.ndarray, target: np.ndarray, w: np.ndarray, steps: int = 8000, seed: int | None = None) -> list[int]:
    """anneal() of elements 0..n-1 from their dependencies (distinct, none of an element on itself): the same draws and the same swaps. A step takes time in proportion to the
    dependencies of the two elements, and memory is that of the dependencies."""
    if n <= 2:
        return list(range(n))
    rng = random.Random(seed)
    ends, others, skew = np.concatenate((source, target)), np.concatenate((target, source)), np.concatenate((w, -w)).astype(float)
    by = np.argsort(ends, kind="stable")
    bounds = np.append(0, np.cumsum(np.bincount(ends, minlength=n))).tolist()
    others, skew = others[by], skew[by]
    order, place = list(range(n)), np.arange(n)
    now = best = 0.0
    kept = order.copy()
    for step in range(steps):
        heat = 0.001 ** (step / steps)
        i, j = sorted(rng.sample(range(n), 2))
        x, y = order[i], order[j]
        of_x, of_y = slice(bounds[x], bounds[x + 1]), slice(bounds[y], bounds[y + 1])
        at_x, at_y = place[others[of_x]], place[others[of_y]]
        delta = float(skew[of_y][(at_y >= i) & (at_y < j)].sum() - skew[of_x][(at_x > i) & (at_x < j)].sum())
        if delta < 0 or rng.random() < math.exp(-min(delta / max(heat, 1e-12), 700)):
            order[i], order[j] = y, x
            place[x], place[y] = j, i
            now += delta
            if now < best - 1e-12:
                best, kept = now, order.copy()
    return kept


def components_of(after: list[list[int]]) -> list[list[int]]:
    """Strong components of 0..n-1, after[v] being what v depends on; those that one depends on come before it, members sorted.

    Two stacks and counters, no recursion (Gabow, 2000): time in proportion to elements and dependencies."""
    n = len(after)
    number, place, done, clock = [0] * n, [0] * n, [False] * n, 0
    path: list[int] = []
    bounds: list[int] = []
    out: list[list[int]] = []
    for root in range(n):
        if number[root]:
            continue
        work = []
        enter = [root]
        while work or enter:
            if enter:
                v = enter.pop()
                clock += 1
                number[v], place[v] = clock, len(path)
                path.append(v)
                bounds.append(v)
                work.append((v, iter(after[v])))
            v, rest = work[-1]
            for u in rest:
                if not number[u]:
                    enter.append(u)
                    break
                if not done[u]:
                    while number[bounds[-1]] > number[u]:
                        bounds.pop()
            else:
                work.pop()
                if bounds[-1] == v:
                    bounds.pop()
                    group = path[place[v] :]
                    del path[place[v] :]
                    for u in group:
                        done[u] = True
                    out.append(sorted(group))
    return out


def strong_components(a: np.ndarray) -> list[list[int]]:
    """components_of() a matrix."""
    links = (np.asarray(a) > 0) & ~np.eye(len(a), dtype=bool)
    return components_of([np.flatnonzero(row).tolist() for row in links])


def block_levels(a: np.ndarray, blocks: list[list[int]]) -> list[int]:
    """Longest chain of blocks that each depends on; blocks stand with dependencies first."""
    of = {v: b for b, members in enumerate(blocks) for v in members}
    out = [0] * len(blocks)
    for b, members in enumerate(blocks):
        deps = {of[int(j)] for i in members for j in np.flatnonzero(a[i] > 0)} - {b}
        out[b] = max((out[d] + 1 for d in deps), default=0)
    return out


def tears(a: np.ndarray, members: list[int], top: int = 5) -> list[dict]:
    """members: a strong component. Single dependencies whose removal shrinks the loop most: impact first, then the lighter."""
    m, n = np.asarray(a, float)[np.ix_(members, members)], len(members)
    cells = np.argwhere((m > 0) & ~np.eye(n, dtype=bool))
    left = largest_after(n, *cells.T).tolist() if len(cells) else []
    found = [
        {"i": members[i], "j": members[j], "w": float(m[i, j]), "impact": n - x, "largest_loop_after": x, "fully_resolves": x == 1}
        for (i, j), x in zip(cells.tolist(), left, strict=True)
    ]
    return sorted(found, key=lambda t: (-t["impact"], t["w"]))[:top]
