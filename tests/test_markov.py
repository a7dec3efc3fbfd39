"""Markov clustering on edge tables against the kernel on whole matrices."""

from __future__ import annotations

import numpy as np
import pytest
from fixtures import dsm_of, loop_process, planted_blocks, two_cliques, weight_pull
from pyspark.sql import functions as F

from depmatrix.kernels.mcl import mcl
from depmatrix.operators import markov
from depmatrix.operators.graph import cut
from depmatrix.schema import EDGES, ELEMENTS, Dsm


def parts(labels):
    groups = {}
    for i, c in enumerate(labels):
        groups.setdefault(c, []).append(i)
    return sorted(groups.values())


def found_of(found, name, inflation):
    rows = found.filter((F.col("dsm_id") == name) & (F.col("inflation") == inflation)).orderBy("idx").collect()
    return parts([r["cluster"] for r in rows])


def matrices():
    rng = np.random.default_rng(5)
    out = {"planted": planted_blocks(), "cliques": two_cliques(), "pull": weight_pull(), "loop": loop_process(), "none": np.zeros((3, 3))}
    for k in range(4):
        a = rng.integers(1, 6, (11, 11)) * (rng.random((11, 11)) < 0.25).astype(float)
        np.fill_diagonal(a, 0)
        out[f"random {k}"] = a
    return out


def test_without_pruning_clusters_are_those_of_the_kernel(spark):
    given = matrices()
    found = cut(markov.attracted(markov.markov(dsm_of(spark, **given), (1.8, 3.0), top=None)))
    for name, a in given.items():
        for inflation in (1.8, 3.0):
            assert found_of(found, name, inflation) == parts(mcl(a, inflation=inflation)), (name, inflation)


def plain(a, inflation, top, rounds):
    m = np.array(a, float)
    np.fill_diagonal(m, 1)

    def pruned(m):
        m = m / m.sum(axis=0)
        for j in range(len(m)):
            order = sorted(range(len(m)), key=lambda i: (-round(m[i, j], 12), i))
            m[order[top:], j] = 0
        return m / m.sum(axis=0)

    m = pruned(m)
    for _ in range(rounds):
        m = pruned(np.linalg.matrix_power(m, 2) ** inflation)
    return m


def test_pruned_rounds_keep_the_largest_of_each_column(spark):
    given = matrices()
    state = cut(markov.markov(dsm_of(spark, **given), (2.0,), top=3, rounds=3, tolerance=0.0))
    cells = markov._cells(state).collect()
    for name, a in given.items():
        got = np.zeros(a.shape)
        for r in cells:
            if r["dsm_id"] == name:
                got[r["i"], r["j"]] = r["w"]
        assert np.allclose(got, plain(a, 2.0, 3, 3), atol=1e-9), name
        assert ((got > 0).sum(axis=0) <= 3).all() and np.allclose(got.sum(axis=0), 1)


def test_hub_columns_are_thinned_in_parts_and_empty_batches_give_no_rows(spark):
    n = 300
    edges = [("hub", i, 0, float(1 + i % 17)) for i in range(1, n)]
    d = Dsm(spark.createDataFrame([("hub", i, "x") for i in range(n)], ELEMENTS), spark.createDataFrame(edges, EDGES))
    whole = {tuple(r) for r in markov._cells(markov._start(d, (2.0,), 5, 4096)).collect()}
    thin = {tuple(r) for r in markov._cells(markov._start(d, (2.0,), 5, 20)).collect()}
    assert whole == thin and sum(1 for r in whole if r[2] == 0) == 5
    none = Dsm(d.elements.limit(0), d.edges.limit(0))
    assert markov.attracted(markov.markov(none, top=4)).count() == 0


def test_sweep_prefers_the_allowed_range_then_cost(spark):
    given = {"planted": planted_blocks(), "cliques": two_cliques()}
    assign, best = markov.markov_sweep(dsm_of(spark, **given), inflations=(2.2, 4.0))
    chosen = {r["dsm_id"]: r for r in best.collect()}
    assert chosen["cliques"]["n_clusters"] == 2 and chosen["cliques"]["external_ratio"] == pytest.approx(0)
    assert all(r["k_in_range"] for r in chosen.values()) and assign.filter("dsm_id = 'cliques'").count() == 10
