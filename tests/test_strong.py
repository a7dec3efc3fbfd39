"""Strong components and levels: in tasks, by contraction in blocks, and of long rings and chains."""

from __future__ import annotations

import numpy as np
import pytest
from fixtures import dsm_of

from depmatrix.kernels.sequence import block_levels, strong_components
from depmatrix.operators import graph


def random_graphs(count, seed=5):
    rng, out = np.random.default_rng(seed), {}
    for k in range(count):
        n = int(rng.integers(2, 25))
        a = np.zeros((n, n))
        m = int(n * rng.choice((0.6, 1.0, 1.4, 2.5)))
        a[rng.integers(0, n, m), rng.integers(0, n, m)] = 1
        if k % 3 == 0:  # long rows and rings
            row = rng.permutation(n)
            a[row[:-1], row[1:]] = 1
        np.fill_diagonal(a, 0)
        out[f"m{k}"] = a
    return out


@pytest.mark.parametrize("in_task", [1 << 18, 12])
def test_components_and_levels(spark, in_task):
    graphs = random_graphs(50)
    d = dsm_of(spark, **graphs)
    sccs = graph.cut(graph.strong_components(d.elements, d.edges, in_task=in_task))
    got = {(r["dsm_id"], r["idx"]): r["scc"] for r in sccs.collect()}
    level = {(r["dsm_id"], r["scc"]): r["level"] for r in graph.levels(d.edges, sccs, in_task=in_task).collect()}
    for name, a in graphs.items():
        blocks = strong_components(a)
        for members, depth in zip(blocks, block_levels(a, blocks), strict=True):
            assert {got[name, v] for v in members} == {members[0]}, (name, members)
            assert level[name, members[0]] == depth


@pytest.mark.parametrize("in_task", [1 << 18, 20_000])
def test_a_ring_and_a_chain_of_a_hundred_thousand(spark, in_task, monkeypatch):
    n, cuts = 100_000, []
    real = graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: cuts.append(1) or real(df))
    ids = spark.range(n).selectExpr("cast(id AS int) AS idx")
    elements = ids.selectExpr("explode(array('ring', 'chain')) AS dsm_id", "idx")
    edges = elements.selectExpr("dsm_id", "idx AS i", f"cast((idx + 1) % {n} AS int) AS j", "1.0D AS w").filter(f"dsm_id = 'ring' OR i < {n} - 1")
    sccs = real(graph.strong_components(elements, edges, in_task=in_task))
    assert [tuple(r) for r in sccs.groupBy("dsm_id").agg({"scc": "max"}).orderBy("dsm_id").collect()] == [("chain", n - 1), ("ring", 0)]
    level = real(graph.levels(edges, sccs, in_task=in_task))
    assert level.filter(f"dsm_id = 'chain' AND level <> {n} - 1 - scc").count() == 0 and level.count() == n + 1
    assert len(cuts) < 60  # states written, some three a round
