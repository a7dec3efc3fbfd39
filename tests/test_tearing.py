"""Tearing in one task a loop and in tables, against finding the components again for each dependency."""

from __future__ import annotations

import numpy as np
from fixtures import dsm_of
from test_kernels import left_without_each, loops_of

from depmatrix.operators import graph, tearing


def many_loops(count):
    rng, out = np.random.default_rng(3), {}
    while len(out) < count:
        n = int(rng.integers(2, 13))
        a = loops_of(rng, n, int(n * rng.choice((1.2, 1.6, 2.5))), len(out) % 2)
        if len(a) > 1:
            out[f"m{len(out)}"] = a * rng.integers(1, 4, a.shape)
    return out


def test_both_forms_on_five_hundred_loops(spark):
    loops = many_loops(500)
    d = dsm_of(spark, **loops)
    sccs = graph.cut(graph.strong_components(d.elements, d.edges))
    want = {}
    for name, a in loops.items():
        for (i, j), left in zip(np.argwhere(a).tolist(), left_without_each(a), strict=True):
            want[name, i, j] = left
    for in_task in (1000, 12):  # all in tasks, the larger ones in tables
        got = {(r["dsm_id"], r["i"], r["j"]): r["largest_loop_after"] for r in tearing.all_tears(d.edges, sccs, in_task).collect()}
        assert got == want
    best = {(r["dsm_id"], r["rank"]): r for r in tearing.tearing(d.edges, sccs, 3).collect()}
    for name, a in loops.items():
        order = sorted((-(len(a) - want[name, i, j]), a[i, j], i, j) for i, j in np.argwhere(a).tolist())[:3]
        assert [(-best[name, k + 1]["impact"], best[name, k + 1]["w"], best[name, k + 1]["i"], best[name, k + 1]["j"]) for k in range(len(order))] == order


def test_a_large_loop_without_a_bound(spark):
    """A ring of 4,000 with ways across it, in one task and, in parts, in tables."""
    n = 4000
    x = np.arange(n)
    jumps = np.arange(0, n - 40, 40)
    edges = np.concatenate((np.stack((x, (x + 1) % n)), np.stack((jumps, jumps + 30))), axis=1).T
    table = spark.createDataFrame([("ring", int(a), int(b), 1.0) for a, b in edges], "dsm_id string, i int, j int, w double")
    elements = spark.range(n).selectExpr("'ring' AS dsm_id", "cast(id AS int) AS idx", "'' AS label")
    sccs = graph.cut(graph.strong_components(elements, table))
    one = {(r["i"], r["j"]): r["largest_loop_after"] for r in tearing.all_tears(table, sccs).collect()}
    assert one[39, 40] == 1 and one[0, 30] == n and one[5, 6] == n - 29
    hub = 60
    star = [("star", 0, k, 1.0) for k in range(1, hub)] + [("star", k, (k + 1) % hub, 1.0) for k in range(1, hub)]
    stars = spark.createDataFrame(star, "dsm_id string, i int, j int, w double")
    spokes = spark.range(hub).selectExpr("'star' AS dsm_id", "cast(id AS int) AS idx", "'' AS label")
    found = graph.cut(graph.strong_components(spokes, stars))
    tabled, tasked = (sorted(map(tuple, tearing.all_tears(stars, found, k).collect())) for k in (0, 1000))
    assert tabled == tasked
