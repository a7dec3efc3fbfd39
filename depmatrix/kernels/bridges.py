"""What single dependencies hold a loop together: in time in proportion to its dependencies, not a search for each of them.

From one element, taken as a root, a dependency (u, v) is the only way to what v dominates if nothing else enters v from outside of that. Taking it out leaves of the loop: what neither v
dominates nor, all dependencies turned round, u does, which stays one component; and the components inside these two sets. Those are sub-trees of a nesting of loops (the
elements that reach w and are reached from it through elements met after w by a search in depth), so the largest in a set is the largest sub-tree of any of its elements.
(Georgiadis, Italiano and Parotsidis, 2017, have the theory of what one failing edge leaves of a component.)
"""

from __future__ import annotations

import numpy as np


def _adjacency(n: int, source: np.ndarray, target: np.ndarray) -> list[list[int]]:
    order = np.argsort(source, kind="stable")
    return [a.tolist() for a in np.split(target[order], np.cumsum(np.bincount(source, minlength=n))[:-1])]


def _search(after: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Elements in the order in which a search in depth from 0 meets them, and for each place the place of the one it was met from."""
    n = len(after)
    met, order, parent = [-1] * n, [0], [0]
    met[0] = 0
    work = [(0, iter(after[0]))]
    while work:
        v, rest = work[-1]
        for u in rest:
            if met[u] < 0:
                met[u] = len(order)
                order.append(u)
                parent.append(met[v])
                work.append((u, iter(after[u])))
                break
        else:
            work.pop()
    return np.array(order), np.array(parent)


def _dominators(before: list[list[int]], parent: list[int]) -> np.ndarray:
    """Immediate dominators by semi-dominators and nearest common ancestors; elements are numbered as the search met them."""
    n = len(parent)
    semi, label, above = list(range(n)), list(range(n)), [-1] * n
    for w in range(n - 1, 0, -1):
        least = w
        for v in before[w]:
            if above[v] >= 0:
                path, x = [], v
                while above[above[x]] >= 0:
                    path.append(x)
                    x = above[x]
                for y in reversed(path):
                    up = above[y]
                    if semi[label[up]] < semi[label[y]]:
                        label[y] = label[up]
                    above[y] = above[up]
            least = min(least, semi[label[v]])
        semi[w] = least
        above[w] = parent[w]
    over = [0] * n
    for w in range(1, n):
        d = parent[w]
        while d > semi[w]:
            d = over[d]
        over[w] = d
    return np.array(over)


def _common(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Nearest common ancestors of pairs a < b: the least parent of the places a + 1 .. b."""
    table = [parent]
    while 2 << len(table) - 1 <= len(parent):
        step, last = 1 << len(table) - 1, table[-1]
        table.append(np.minimum(last[:-step], last[step:]))
    size = b - a
    level = np.floor(np.log2(size)).astype(np.int64)
    out = np.empty(len(a), np.int64)
    for k, row in enumerate(table):
        which = np.flatnonzero(level == k)
        out[which] = np.minimum(row[a[which] + 1], row[b[which] + 1 - (1 << k)])
    return out


def _nested(n: int, source: np.ndarray, target: np.ndarray, parent: np.ndarray, last: np.ndarray) -> np.ndarray:
    """For each w the number of elements that reach it and are reached from it through elements of its search tree alone."""
    back = (target <= source) & (source <= last[target])
    closing = _adjacency(n, target[back], source[back])
    s, t = source[~back], target[~back]
    joint = _common(parent, np.minimum(s, t), np.maximum(s, t)) if len(s) else s
    order = np.argsort(joint, kind="stable")
    at = np.searchsorted(joint[order], np.arange(n + 1)).tolist()
    s, t = s[order].tolist(), t[order].tolist()
    root, entering, size = list(range(n)), [[] for _ in range(n)], [1] * n

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for w in range(n - 1, -1, -1):
        for k in range(at[w], at[w + 1]):  # from here on both ends are in the tree of what is looked at
            entering[find(t[k])].append(s[k])
        body, todo = set(), [find(x) for x in closing[w]]
        while todo:
            y = todo.pop()
            if y != w and y not in body:
                body.add(y)
                todo.extend(map(find, entering[y]))
        for y in body:
            root[y] = w
            size[w] += size[y]
            entering[y] = []
        if body:
            entering[w] = [x for x in entering[w] if find(x) != w]
    return np.array(size)


def _side(n: int, source: np.ndarray, target: np.ndarray):
    """For one direction: whether each dependency is the only way into what its target dominates; by element the place in the tree of dominators, how many it dominates, and the
    largest component inside that."""
    order, parent = _search(_adjacency(n, source, target))
    number = np.empty(n, np.int64)
    number[order] = np.arange(n)
    s, t = number[source], number[target]
    size = np.ones(n, np.int64)
    for w in range(n - 1, 0, -1):
        size[parent[w]] += size[w]
    nested = _nested(n, s, t, parent, np.arange(n) + size - 1)
    over = _dominators(_adjacency(n, t, s), parent.tolist()).tolist()
    held, largest = [1] * n, nested.tolist()
    for w in range(n - 1, 0, -1):
        held[over[w]] += held[w]
        largest[over[w]] = max(largest[over[w]], largest[w])
    place, free = [0] * n, [1] * n
    for w in range(1, n):
        place[w] = free[over[w]]
        free[over[w]] += held[w]
        free[w] = place[w] + 1
    place, held = np.array(place), np.array(held)
    outside = (place[s] < place[t]) | (place[s] >= place[t] + held[t])
    entries = np.bincount(t[outside], minlength=n)
    return outside & (entries[t] == 1), place[number], held[number], np.array(largest)[number]


def _in_both(first: np.ndarray, second: np.ndarray, a: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_size: np.ndarray) -> np.ndarray:
    """How many elements lie at places a..a + a_size - 1 of one order and b..b + b_size - 1 of the other: counts by a wavelet matrix, all queries at once."""
    n = len(first)
    row = np.empty(n, np.int64)
    row[first] = second
    bits = max(1, int(n).bit_length())

    def below(low: np.ndarray, high: np.ndarray, least: np.ndarray) -> np.ndarray:
        out, low, high = np.zeros(len(low), np.int64), low.copy(), high.copy()
        for ones_before, zeros, k in levels:
            l1, h1 = ones_before[low], ones_before[high]
            up = (least >> k) & 1 == 1
            out += np.where(up, (high - low) - (h1 - l1), 0)
            low, high = np.where(up, zeros + l1, low - l1), np.where(up, zeros + h1, high - h1)
        return out

    levels, now = [], row
    for k in range(bits - 1, -1, -1):
        bit = (now >> k) & 1
        levels.append((np.append(0, np.cumsum(bit)), int(n - bit.sum()), k))
        now = np.concatenate((now[bit == 0], now[bit == 1]))
    return below(a, a + a_size, b + b_size) - below(a, a + a_size, b)


def largest_after(n: int, source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """For each dependency of a loop of elements 0..n-1 the size of the largest strong component when that one is taken out. Dependencies are distinct, none is of an element on itself."""
    source, target = np.asarray(source, np.int64), np.asarray(target, np.int64)
    out = np.full(len(source), n, np.int64)
    if n < 2:
        return out
    into, at, held, inner = _side(n, source, target)
    back, at_r, held_r, inner_r = _side(n, target, source)
    lost = np.zeros(len(source), np.int64)
    lost[into] += held[target[into]]
    lost[back] += held_r[source[back]]
    both = np.flatnonzero(into & back)
    if len(both):
        v, u = target[both], source[both]
        lost[both] -= _in_both(at, at_r, at[v], held[v], at_r[u], held_r[u])
    out -= lost
    out[into] = np.maximum(out[into], inner[target[into]])
    out[back] = np.maximum(out[back], inner_r[source[back]])
    return out
