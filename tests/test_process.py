"""Process matrices in tables, as for those that no kernel holds, against the kernels."""

from __future__ import annotations

import numpy as np
from fixtures import dsm_of, loop_process, planted_blocks

from depmatrix.kernels.sequence import anneal, anneal_links, feedback
from depmatrix.plans import process
from depmatrix.schema import EDGES, ELEMENTS, Dsm


def rows(df, *leave):
    return sorted(map(tuple, df.drop(*leave).collect()))


def test_annealing_dependencies_makes_the_swaps_of_annealing_a_matrix():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 8, 30):
        a = rng.integers(0, 4, (n, n)) * (rng.random((n, n)) < 0.4)
        np.fill_diagonal(a, 0)
        x, y = np.nonzero(a)
        assert anneal_links(n, x, y, a[x, y], 600, seed=n) == anneal(a, list(range(n)), 600, seed=n)


def test_a_matrix_beyond_the_kernels(spark):
    """Two rings, the second depending on the first, with 5,100 elements in all."""
    n, split = 5100, 40
    edges = [("m", k, (k + 1) % split, 1.0) for k in range(split)]
    edges += [("m", k, k + 1 if k + 1 < n else split, 1.0) for k in range(split, n)] + [("m", 50, 3, 1.0)]
    d = Dsm(spark.createDataFrame([("m", k, "") for k in range(n)], ELEMENTS), spark.createDataFrame(edges, EDGES))
    found = process.partition(d, seed=1)
    placed = found.ordering.collect()
    assert sorted(r["pos"] for r in placed) == sorted(r["idx"] for r in placed) == list(range(n))
    assert {(r["level"], r["idx"] >= split, r["block"]) for r in placed} == {(0, False, 0), (1, True, 1)}
    figures = found.metrics.first()
    assert (figures["n_loops"], figures["largest_loop"], figures["n_levels"], figures["sequential_elements"]) == (2, n - split, 2, 0)
    assert figures["feedback_after"] <= figures["feedback_before"]
    assert [(r["block"], r["rank"], r["i"], r["impact"]) for r in found.tears.orderBy("block", "rank").collect()] == [
        (b, k + 1, first + k, size - 1) for b, first, size in ((0, 0, split), (1, split, n - split)) for k in range(5)
    ]


def test_tables_agree_with_kernels_and_pieces_add_no_feedback(spark):
    given = {"loop": loop_process(), "planted": planted_blocks(), "none": np.zeros((3, 3))}
    d = dsm_of(spark, **given)
    kernel, table = process.partition(d, seed=1), process.partition(d, seed=1, max_n=6, in_task=36)
    assert rows(kernel.tears, "block") == rows(table.tears, "block")
    seeded = ("feedback_after", "marks_resolved")
    assert rows(kernel.metrics, *seeded) == rows(table.metrics, *seeded)
    placed = rows(table.ordering.select("dsm_id", "pos", "idx", "level"))
    assert [(m, i, level) for m, _, i, level in sorted(placed, key=lambda r: (r[0], r[2]))] == rows(kernel.ordering.select("dsm_id", "idx", "level"))
    for name, a in given.items():
        order = [i for m, _, i, _ in placed if m == name]
        assert [p for m, p, _, _ in placed if m == name] == sorted(order) == list(range(len(a)))
    before = feedback(given["planted"])
    assert feedback(given["planted"], [i for m, _, i, _ in placed if m == "planted"]) < before
