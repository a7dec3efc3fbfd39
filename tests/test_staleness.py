"""Every edit makes results stale, another order of rows doesn't."""

from __future__ import annotations

import pytest
from fixtures import dsm_of, loop_process, two_cliques

from depmatrix.operators import graph, staleness, transforms
from depmatrix.schema import Dsm


def test_edits_and_orders(spark):
    d = dsm_of(spark, a=loop_process(), b=two_cliques())
    result = graph.cut(staleness.stamped(graph.loops(graph.strong_components(d.elements, d.edges)), d))
    stale = lambda x: {r["dsm_id"] for r in staleness.checked(result, x).filter("stale").collect()}
    assert stale(d) == set() and stale(Dsm(d.elements.repartition(3, "label"), d.edges.orderBy("w", "j"))) == set()
    edits = [
        transforms.with_edge(d, "a", 4, 5, 2.0),
        transforms.with_edge(d, "a", 0, 1, 0.0),
        transforms.toggle_edge(d, "a", 4, 5),
        transforms.rename(d, "a", 2, "other"),
        transforms.add_element(d, "a", "new"),
        transforms.remove_element(d, "a", 6),
        Dsm(d.elements, d.edges.filter("dsm_id <> 'a'").unionByName(transforms.transpose(d.edges.filter("dsm_id = 'a'")).select("dsm_id", "i", "j", "w"))),
        Dsm(d.elements.filter("dsm_id <> 'a'"), d.edges.filter("dsm_id <> 'a'")),
    ]
    for k, edited in enumerate(edits):
        assert stale(edited) == {"a"}, k
    there_and_back = transforms.with_edge(transforms.with_edge(d, "a", 4, 5, 2.0), "a", 4, 5, 0.0)
    assert stale(there_and_back) == set()
    assert staleness.fresh(result, d).columns == ["dsm_id", "scc", "size"]
    with pytest.raises(ValueError, match="results of a"):
        staleness.fresh(result, edits[0])
