from __future__ import annotations

import numpy as np
import pytest
from fixtures import loop_process, planted_blocks, two_cliques, weight_pull

from depmatrix.kernels.bridges import largest_after
from depmatrix.kernels.cost import cost, external_ratio
from depmatrix.kernels.louvain import Graph, _moved, louvain, modularity
from depmatrix.kernels.mcl import mcl
from depmatrix.kernels.repair import grow_small, merge_many, split_few, split_large, within_limits
from depmatrix.kernels.sequence import anneal, block_levels, feedback, strong_components, tears
from depmatrix.kernels.spectral import fiedler, spectral_cluster
from depmatrix.kernels.thebeau import thebeau


def recovered(labels, size=5) -> int:
    labels = np.asarray(labels)
    return sum(np.bincount(labels[b : b + size]).max() >= size - 1 for b in range(0, len(labels), size))


@pytest.mark.parametrize(
    "run",
    [lambda a: spectral_cluster(a, k=4)[0], lambda a: louvain(a, seed=5), lambda a: thebeau(a, seed=5), lambda a: mcl(a, inflation=2.2)],
)
def test_planted_blocks_are_recovered(run):
    assert recovered(run(planted_blocks())) >= 3


def test_costs_of_known_partitions():
    assert cost(two_cliques(), [0] * 5 + [1] * 5) == 200
    assert cost(two_cliques(), range(10)) == 400
    assert cost(planted_blocks(), np.arange(20) // 5) == 395
    assert round(external_ratio(planted_blocks(), np.arange(20) // 5), 6) == 0.042857
    a = weight_pull()
    assert [cost(a, [0, 0, 0, 1, 1, 1, c]) for c in (0, 2, 1)] == [564, 618, 654]  # with those it is drawn to, alone, with the others


def test_weights_pull_the_element():
    for run in (lambda a: thebeau(a, seed=1), lambda a: louvain(a, seed=1)):
        got = run(weight_pull())
        assert got[6] == got[0] != got[3]


def test_cliques_and_degenerate_inputs():
    got = louvain(two_cliques(), seed=0)
    assert len(set(got)) == 2 and len(set(got[:5])) == 1
    assert set(thebeau(two_cliques(), seed=0)[:5]).isdisjoint(thebeau(two_cliques(), seed=0)[5:])
    assert louvain(np.zeros((4, 4))) == [0] * 4 and thebeau(np.zeros((4, 4)), seed=0) == [0, 1, 2, 3]
    tiny = np.array([[0, 1], [1, 0.0]])
    assert len(spectral_cluster(tiny, low=2, high=2)[0]) == 2 and louvain(tiny) == thebeau(tiny) == [0, 0]
    assert spectral_cluster(np.zeros((1, 1)))[0] == [0]


def test_seeds_decide():
    a = planted_blocks(seed=3)
    assert thebeau(a, seed=9) == thebeau(a, seed=9) and louvain(a, seed=9) == louvain(a, seed=9)


def test_loops_and_levels():
    a = loop_process()
    blocks = strong_components(a)
    assert [0, 1, 2] in blocks and len(blocks) == 5
    levels = block_levels(a, blocks)
    place = {tuple(b): k for k, b in enumerate(blocks)}
    assert place[(3,)] > place[(0, 1, 2)] and place[(6,)] < place[(5,)]
    assert levels[place[(3,)]] == 1 and levels[place[(5,)]] == 1


def test_components_come_after_what_they_depend_on():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n = int(rng.integers(1, 12))
        a = (rng.random((n, n)) < 0.2).astype(float)
        reach = np.linalg.matrix_power(np.eye(n) + (a > 0), n) > 0
        blocks = strong_components(a)
        assert sorted(v for b in blocks for v in b) == list(range(n))
        for b in blocks:
            assert b == [v for v in range(n) if reach[b[0], v] and reach[v, b[0]]]
        place = {v: k for k, b in enumerate(blocks) for v in b}
        assert all(place[j] <= place[i] for i, j in np.argwhere(a > 0))


def test_louvain_gains_modularity():
    rng = np.random.default_rng(4)
    for k in range(20):
        a = (rng.random((24, 24)) < 0.15) * rng.integers(1, 5, (24, 24))
        got = louvain(a, seed=k)
        assert sorted(set(got)) == list(range(len(set(got)))) and modularity(a, got) >= modularity(a, [0] * 24) - 1e-12
        assert modularity(a, got) > modularity(a, np.arange(24) % 6) and louvain(a, seed=k) == got
    assert modularity(planted_blocks(), louvain(planted_blocks(), seed=1)) >= modularity(planted_blocks(), np.arange(20) // 5) - 1e-9
    # by hand: two cliques of five, all weight inside, halves of it each
    assert modularity(two_cliques(), [0] * 5 + [1] * 5) == pytest.approx(0.5)


def test_local_moves_agree_with_a_recount():
    rng = np.random.default_rng(6)
    a = np.triu((rng.random((15, 15)) < 0.3) * rng.integers(1, 4, (15, 15)), 1).astype(float)
    a += a.T
    i, j = np.nonzero(a)
    g = Graph.of(15, i, j, a[i, j])
    found = _moved(g, rng.permutation(15), 1.0, True)
    best = modularity(a, found)
    for v in range(15):  # no single move into a neighbour's community gains
        for c in {int(found[u]) for u in np.flatnonzero(a[v])}:
            trial = found.copy()
            trial[v] = c
            assert modularity(a, trial) <= best + 1e-9
    small = g.merged(found)
    assert small.degrees.sum() == pytest.approx(a.sum()) and small.loops.sum() == pytest.approx(a[found[:, None] == found].sum())


def loops_of(rng, n, m, ring):
    """The largest strong component of a random graph, renumbered: its size and dependencies."""
    a = np.zeros((n, n))
    a[rng.integers(0, n, m), rng.integers(0, n, m)] = 1
    if ring:
        a[np.arange(n), (np.arange(n) + 1) % n] = 1
    np.fill_diagonal(a, 0)
    members = max(strong_components(a), key=len)
    return a[np.ix_(members, members)]


def left_without_each(a):
    out = []
    for x, y in np.argwhere(a):
        b = a.copy()
        b[x, y] = 0
        out.append(max(len(c) for c in strong_components(b)))
    return out


def test_largest_after_each_dependency_of_many_loops():
    rng, broken = np.random.default_rng(7), 0
    for k in range(500):
        n = int(rng.integers(2, 15))
        a = loops_of(rng, n, int(n * rng.choice((1.2, 1.6, 2.5))), k % 2)
        if len(a) > 1:
            want = left_without_each(a)
            assert largest_after(len(a), *np.argwhere(a).T).tolist() == want
            broken += sum(x < len(a) for x in want)
    assert broken > 1000
    assert largest_after(1, [], []).tolist() == []


def test_largest_after_takes_linear_time():
    n = 60_000
    x = np.arange(n)
    got = largest_after(n, np.append(x, 0), np.append((x + 1) % n, n // 2))
    # a ring and a short cut: before the short cut's end the ring is broken, on the way round it a loop is left
    assert got[-1] == n and got[0] == n // 2 + 1 and got[n // 2] == 1


def test_tears():
    two = np.array([[0, 1.0], [3, 0]])
    got = tears(two, [0, 1])
    assert all(t["fully_resolves"] for t in got) and got[0]["w"] == 1
    eight = np.zeros((3, 3))
    eight[0, 1] = eight[1, 0] = eight[1, 2] = eight[2, 1] = 1
    assert tears(eight, [0, 1, 2])[0]["impact"] >= 1 and tears(eight, [0]) == []


def test_annealing():
    a = np.zeros((3, 3))
    a[0, 1], a[1, 0], a[2, 0] = 9, 1, 1
    got = anneal(a, [0, 1, 2], seed=7)
    assert got.index(1) < got.index(0)
    chain = np.zeros((6, 6))
    for i in range(1, 6):
        chain[i, i - 1] = 1
    chain = chain[::-1, ::-1]
    assert feedback(chain, anneal(chain, list(range(6)), seed=1)) == 0
    rng = np.random.RandomState(0)
    s = np.triu(rng.rand(10, 10) < 0.4, 1).astype(float)
    s += s.T
    assert feedback(s, anneal(s, list(range(10)), seed=1)) == feedback(s)


def test_fiedler_has_both_signs():
    v = fiedler(two_cliques() + 0.01)
    assert (v > 0).any() and (v < 0).any() and len(fiedler(np.zeros((1, 1)))) == 1


def test_limits():
    a = planted_blocks()
    assert min(np.bincount(grow_small(a, [0] + [1] * 19, 2))) >= 2
    assert max(np.bincount(split_large(a, [0] * 20, 6))) <= 6
    assert len(set(merge_many(a, list(range(20)), 4, 20)[0])) == 4
    assert len(set(split_few(a, [0] * 20, 3, 2)[0])) == 3
    got, _, _ = within_limits(np.zeros((11, 11)), [0] * 11, 2, 20, 3, 6)
    assert len(set(got)) >= 3
    assert within_limits(np.zeros((0, 0)), [], 2, 20, 2, 10) == ([], 0, 0)
