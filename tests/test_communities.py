"""Communities on edge tables: gains, modularity that never falls, planted blocks."""

from __future__ import annotations

import numpy as np
from fixtures import dsm_of, planted_blocks, two_cliques, weight_pull
from pyspark.sql import functions as F
from test_kernels import recovered

from depmatrix.kernels.louvain import louvain, modularity
from depmatrix.operators import communities, graph
from depmatrix.operators.transforms import symmetrise


def labels(found, name):
    return [r["cluster"] for r in found.filter(F.col("dsm_id") == name).orderBy("idx").collect()]


def test_planted_structure_is_found_and_modularity_never_falls(spark):
    none, pair = np.zeros((4, 4)), np.array([[0, 1.0], [0, 0]])
    matrices = {"planted": planted_blocks(), "cliques": two_cliques(), "pull": weight_pull(), "none": none, "pair": pair}
    found, sums = communities.communities(dsm_of(spark, **matrices))
    found = graph.cut(found)
    got = {name: labels(found, name) for name in matrices}
    assert recovered(got["planted"]) >= 3 and len(set(got["cliques"])) == 2 and len(set(got["cliques"][:5])) == 1
    assert got["pull"][6] == got["pull"][0] != got["pull"][3]
    assert got["none"] == [0] * 4 and got["pair"] == [0, 0]
    assert all(b >= a - 1e-9 for a, b in zip(sums, sums[1:], strict=False))
    for name in ("planted", "cliques", "pull"):
        a = matrices[name]
        own = modularity((a + a.T) / 2, np.unique(got[name], return_inverse=True)[1])
        assert own >= 0.95 * modularity((a + a.T) / 2, np.array(louvain(a, seed=1)))


def test_gains_are_differences_of_modularity(spark):
    rng = np.random.default_rng(2)
    a = rng.integers(0, 4, (9, 9)) * (rng.random((9, 9)) < 0.4).astype(float)
    np.fill_diagonal(a, 0)
    w, c = (a + a.T) / 2, np.arange(9) % 3
    d = dsm_of(spark, m=a)
    member = d.elements.select("dsm_id", F.col("idx").alias("v"), (F.col("idx") % 3).alias("c"))
    moves = {r["v"]: (r["to"], r["gain"]) for r in communities.best_moves(symmetrise(d.edges), member).collect()}
    base = modularity(w, c)
    for v in range(9):
        gains = {}
        for to in set(range(3)) - {c[v]}:
            if w[v, c == to].any():
                trial = c.copy()
                trial[v] = to
                gains[to] = modularity(w, trial) - base
        best = max(gains.values(), default=0)
        assert (v in moves) == (best > 1e-12)
        if v in moves:
            assert abs(moves[v][1] - best) < 1e-9 and abs(gains[moves[v][0]] - best) < 1e-9
