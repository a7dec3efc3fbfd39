from __future__ import annotations

import numpy as np
import pytest
from fixtures import dsm_of, loop_process, planted_blocks, two_cliques
from pyspark.sql import functions as F

from depmatrix.operators import graph, scoring, tearing, transforms, whatif
from depmatrix.params import Constraints
from depmatrix.plans import cluster, process
from depmatrix.schema import Dsm, validate
from depmatrix.sources import dispatch, project, text, workbook


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_batch_of_matrices_stays_apart(spark):
    d = validate(dsm_of(spark, a=loop_process(), b=two_cliques()))
    found = {(r["dsm_id"], r["idx"]): r["scc"] for r in graph.strong_components(d.elements, d.edges).collect()}
    assert [found["a", k] for k in range(7)] == [0, 0, 0, 3, 4, 5, 6]
    assert {found["b", k] for k in range(5)} == {0} and {found["b", k] for k in range(5, 10)} == {5}
    parts = {(r["dsm_id"], r["idx"]): r["component"] for r in graph.components(d).collect()}
    assert parts["a", 3] == 0 and parts["a", 4] == 4 and parts["b", 9] == 5


def test_validation(spark):
    d = dsm_of(spark, a=loop_process())
    bad = Dsm(d.elements, d.edges.withColumn("j", F.when(F.col("j") == 6, 99).otherwise(F.col("j"))))
    with pytest.raises(ValueError, match="edge without element"):
        validate(bad)


def test_bus_and_isolated_elements(spark):
    a = np.zeros((12, 12))
    a[0, 1:] = a[1:, 0] = 3
    d = dsm_of(spark, star=a)
    assert rows(scoring.bus_elements(d, 0.99), "idx") == [(0,)]
    stage = cluster.cluster_stage(d, Constraints(bus_threshold=0.99, min_clusters=3, max_clusters=6, seed=1))
    ordering, figures = cluster.sequence_stage(
        d,
        stage,
        stage.candidates.filter("algo = 'louvain'").select("dsm_id", "algo"),
        Constraints(bus_threshold=0.99, min_clusters=3, max_clusters=6, seed=1),
    )
    assert ordering.count() == 12 and figures.first()["n_clusters"] >= 3
    with pytest.raises(ValueError):
        cluster.sequence_stage(d, stage, stage.candidates.selectExpr("dsm_id", "'none' AS algo"))


def test_whole_run_and_stability(spark):
    d = dsm_of(spark, planted=planted_blocks(noise=2))
    ordering, figures = cluster.run(d, Constraints(seed=5))
    assert sorted(r["idx"] for r in ordering.collect()) == list(range(20))
    assert figures.first()["external_ratio_core"] < 0.5
    co, agree, told = cluster.stability(d, "louvain", 8)
    assert told.first()["mean_consistency"] > 0.75
    assert co.filter("i = j and frac <> 1").count() == 0
    with pytest.raises(ValueError):
        cluster.stability(d, "mcl")


def test_process_agrees_with_tables(spark):
    d = dsm_of(spark, a=loop_process())
    p = process.partition(d, seed=1)
    m = p.metrics.first()
    assert (m["n_loops"], m["largest_loop"], m["n_blocks"], m["coupled_elements"]) == (1, 3, 5, 3)
    sccs = graph.strong_components(d.elements, d.edges)
    level = {r["scc"]: r["level"] for r in graph.levels(d.edges, sccs).collect()}
    assert {(r["idx"]): r["level"] for r in p.ordering.collect()} == {
        i: level[s] for i, s in ((r["idx"], r["scc"]) for r in sccs.collect())
    }
    kernel, plan = (
        rows(p.tears, "i", "j", "impact", "largest_loop_after"),
        rows(tearing.tearing(d.edges, sccs), "i", "j", "impact", "largest_loop_after"),
    )
    assert kernel == plan
    symmetric = dsm_of(spark, s=np.ones((5, 5)) - np.eye(5))
    assert process.partition(symmetric, seed=1).metrics.first()["guidance"] == "symmetric"


def test_editing(spark):
    d = dsm_of(spark, a=loop_process())
    assert transforms.remove_element(d, "a", 0).elements.count() == 6
    assert rows(
        transforms.toggle_edge(transforms.toggle_edge(d, "a", 4, 5), "a", 0, 1).edges, "i", "j"
    ) == [(1, 2), (2, 0), (3, 2), (4, 5), (5, 6)]
    assert transforms.add_element(d, "a", "new").elements.count() == 8
    assert transforms.blank(spark).elements.count() == 5
    moved = whatif.move(d.elements.select("dsm_id", "idx", F.lit(0).alias("cluster")), 3)
    assert rows(moved.filter("idx = 3"), "cluster") == [(1,)]


def test_partitioning_does_not_matter(spark):
    d = dsm_of(spark, a=planted_blocks())
    many = Dsm(d.elements.repartition(7), d.edges.repartition(9))
    assign = d.elements.select("dsm_id", "idx", F.floor(F.col("idx") / 5).cast("int").alias("cluster"))
    one, two = (scoring.scores(x.edges, assign, x.sizes()).first() for x in (d, many))
    assert one == two and one["cost"] == 395


def test_files(spark, tmp_path):
    (tmp_path / "m.csv").write_text("﻿label,A,B,C\nA,,1,0\nB,0,,1\n\nC,1,0,\n")
    d = dispatch.read_dsm(spark, str(tmp_path / "m.csv"), format="matrix")
    assert rows(d.edges, "i", "j", "w") == [(0, 1, 1.0), (1, 2, 1.0), (2, 0, 1.0)]
    assert rows(d.elements, "idx", "label") == [(0, "A"), (1, "B"), (2, "C")]
    flipped = dispatch.read_dsm(spark, str(tmp_path / "m.csv"), format="matrix", convention="IC")
    assert rows(flipped.edges, "j", "i") == rows(d.edges, "i", "j")
    (tmp_path / "e.csv").write_text("from,to,weight\nPump,Valve,2\nMotor,Pump,\nPump,Valve,3\nFan,Fan,1\n")
    e = dispatch.read_dsm(spark, str(tmp_path / "e.csv"))
    assert rows(e.edges, "w") == [(1.0,), (3.0,)] and rows(e.elements, "label") == [("Fan",), ("Motor",), ("Pump",), ("Valve",)]
    assert not text.looks_like_edge_list(["a,b,c,d", "e,f,g,h"])
    (tmp_path / "w.xlsx").write_bytes(workbook.workbook([[0, 1, 0], [0, 0, 2.5], [0, 0, 0]], ["X", "Y", "Z"], "Title"))
    got = workbook.rows((tmp_path / "w.xlsx").read_bytes())
    assert (  # header beside the title, where readers of such files look for it
        got[0] == ["Title", "X", "Y", "Z"] and got[1][:3] == ["X", "", "1"]
    )
    w = dispatch.read_dsm(spark, str(tmp_path / "w.xlsx"))
    assert rows(workbook.list_sheets(spark, str(tmp_path / "w.xlsx")), "sheet") == [("DSM",)]
    assert w.elements.count() == 3
    with pytest.raises(ValueError):
        workbook.parse_matrix([["", "A"]])
    (tmp_path / "p.json").write_text(project.serialize([[0, 2], [0, 0]], ["A", "B"], params={"min_clusters": 2}))
    p = dispatch.read_dsm(spark, str(tmp_path / "p.json"))
    assert rows(p.edges, "i", "j", "w") == [(0, 1, 2.0)]
    with pytest.raises(ValueError):
        project.parse('{"matrix": [[0]]}')
    project.save(d, str(tmp_path / "saved"))
    assert rows(project.load(spark, str(tmp_path / "saved")).edges, "i", "j", "w") == rows(d.edges, "i", "j", "w")
    text.write_matrix_csv(d, str(tmp_path / "out"))
    assert len(list((tmp_path / "out").glob("dsm_id=*/*.txt"))) == 1


def test_components_equal_closure_on_random_graphs(spark):
    rng = np.random.default_rng(3)
    made = {
        f"m{k}": (rng.random((n, n)) < p).astype(float)
        for k, (n, p) in enumerate(((30, 0.03), (30, 0.06), (12, 0.4), (25, 0.02), (40, 0.05)))
    }
    chain = np.zeros((40, 40))
    chain[np.arange(1, 40), np.arange(39)] = 1
    ring = chain.copy()
    ring[0, 39] = 1
    d = dsm_of(spark, chain=chain, ring=ring, none=np.zeros((3, 3)), **made)
    reach = graph.closure(d.edges)
    mutual = reach.join(
        reach.select("dsm_id", F.col("j").alias("i"), F.col("i").alias("j")), ["dsm_id", "i", "j"]
    ).groupBy("dsm_id", F.col("i").alias("idx")).agg(F.min("j").alias("m"))
    want = d.elements.join(mutual, ["dsm_id", "idx"], "left").select("dsm_id", "idx", F.least("idx", F.coalesce("m", "idx")).alias("scc"))
    got = graph.strong_components(d.elements, d.edges)
    assert rows(got, "dsm_id", "idx", "scc") == rows(want, "dsm_id", "idx", "scc")
    assert {
        r["level"] for r in graph.levels(d.edges.filter("dsm_id = 'chain'"), got.filter("dsm_id = 'chain'")).collect()
    } == set(range(40))


def test_numbering_and_levels(spark):
    from depmatrix.operators.numbering import numbered

    frame = spark.createDataFrame([(f"d{n % 3}", (n * 37) % 101) for n in range(100)], "dsm_id string, v int").repartition(7)
    got = numbered(frame, ["v"], "place").collect()
    for d in ("d0", "d1", "d2"):
        own = sorted((r["place"], r["v"]) for r in got if r["dsm_id"] == d)
        assert [p for p, _ in own] == list(range(len(own))) and [v for _, v in own] == sorted(v for _, v in own)
    assert sorted(r["place"] for r in numbered(frame, ["dsm_id", "v"], "place", by=None).collect()) == list(range(100))
    d = dsm_of(spark, a=loop_process())
    placed = process.by_levels(d)
    kernel = {r["idx"]: r["level"] for r in process.partition(d, seed=1).ordering.collect()}
    assert {r["idx"]: r["level"] for r in placed.collect()} == kernel and sorted(r["pos"] for r in placed.collect()) == list(range(7))
    assert process.process_metrics(d, placed).first()["n_loops"] == 1


def test_failing_kernels_leave_a_row(spark):
    from depmatrix.plans import fanout

    def kernel(a, task):
        if task["k"] == 2 and len(a) == 7:
            raise ValueError("no")
        return [{"n": len(a) * task["k"]}]

    found = fanout.fan_out(fanout.packed(dsm_of(spark, a=loop_process(), b=two_cliques())), [{"k": 1}, {"k": 2}], kernel, "n int")
    assert rows(fanout.done(found), "dsm_id", "n") == [("a", 7), ("b", 10), ("b", 20)]
    assert rows(fanout.failures(found), "dsm_id", "status") == [("a", "ValueError: no")]
    with pytest.raises(Exception, match="too large"):
        fanout.packed(dsm_of(spark, a=loop_process()), max_n=3).collect()


def test_small_matrices_are_found(spark):
    d = dsm_of(spark, one=np.zeros((1, 1)))
    with pytest.raises(ValueError, match="fewer than two elements"):
        validate(d)
    with pytest.raises(ValueError, match="fewer than two elements"):
        validate(Dsm(d.elements, dsm_of(spark, gone=two_cliques()).edges))


def test_what_if_leaves_bus_elements_out(spark):
    a = np.zeros((5, 5))
    a[0, 1] = a[2, 3] = a[1, 2] = 1
    a[4, :4] = a[:4, 4] = 1
    d = dsm_of(spark, a=a)
    base = spark.createDataFrame([("a", k, k // 2) for k in range(5)], "dsm_id string, idx int, cluster int")
    bus = spark.createDataFrame([("a", 4)], "dsm_id string, idx int")
    trial = whatif.move(base, 1)
    assert rows(trial.filter("idx = 1"), "cluster") == [(3,)]  # above the bus element's own
    got = whatif.rescore(d.edges, d.sizes(), base, trial, bus=bus).first()
    # before: 2 + 2 inside, 4 between; after: 4 + 4 between, 2 inside
    assert (got["base_cost"], got["cost"], got["verdict"], got["external_verdict"]) == (8.0, 10.0, "worse", "worse")
    order = base.withColumn("pos", F.col("idx"))
    assert whatif.finalise(d, order, "final")[1] == "Optimized DSM - Final (sequenced)"
    for bad in (
        order.filter("idx > 0"), order.union(order.limit(1)), order.withColumn("cluster", F.when(F.col("idx") > 1, F.col("cluster")))
    ):
        with pytest.raises(ValueError, match="element"):
            whatif.finalise(d, bad, "final")
    with pytest.raises(ValueError, match="unknown source"):
        whatif.finalise(d, order, "elsewhere")


def test_reports_and_restored_projects(spark, tmp_path):
    from depmatrix.plans import report

    limits = Constraints(seed=5)
    d = dsm_of(spark, planted=planted_blocks(noise=2))
    stage = cluster.cluster_stage(d, limits)
    assert stage.failures.count() == 0
    chosen = stage.recommended().select("dsm_id", "algo")
    ordering, figures = cluster.sequence_stage(d, stage, chosen, limits)
    made = report.component_report(d, stage, ordering, figures, limits=limits)
    told = {r["algo"]: r for r in made["comparison"].collect()}
    assert set(told) == set(scoring.RANK) and sum(r["recommended"] for r in told.values()) == sum(r["chosen"] for r in told.values()) == 1
    assert made["parameters"].first()["bus_threshold"] == "adaptive" and made["parameters"].first()["seed"] == "5"
    assert sum(r["size"] for r in made["membership"].collect()) == 20 and made["final"].first()["cost"] == figures.first()["cost"]
    p = process.partition(dsm_of(spark, a=loop_process()), seed=1)
    out = report.process_report(dsm_of(spark, a=loop_process()), p)
    assert out["summary"].first()["n_loops"] == 1
    assert rows(out["tears"], "loop", "from_label", "to_label")[0] == (1, "e0", "e1")
    other = dsm_of(spark, planted=planted_blocks())
    assert report.diff_report(d, other).first()["added"] > 0
    # saved and restored: the same candidates without clustering again
    raw = {
        a: [r["cluster"] for r in sorted(stage.assign.filter(F.col("algo") == a).collect(), key=lambda r: r["idx"])] for a in scoring.RANK
    }
    m = planted_blocks(noise=2).tolist()
    saved = {
        "stage1": {a: {"raw_clusters": c} for a, c in raw.items() if c} | {"recommended": "louvain"},
        "params": {"min_clusters": 3},
        "convention": "IC",
        "last_result": {"matrix": m, "labels": [f"e{k}" for k in range(20)], "clusters": [0] * 20, "source": "mcl", "title": "T"},
    }
    (tmp_path / "p.json").write_text(project.serialize(m, [f"e{k}" for k in range(20)], server_state=saved, client_state={"tab": 1}))
    back = project.restore(spark, str(tmp_path / "p.json"))
    assert back.state.first()["convention"] == "IC" and rows(back.params, "name", "value") == [("min_clusters", "3")]
    assert back.result.first()["title"] == "T" and back.client.first()["client_state"] == '{"tab": 1}'
    again = cluster.restored(back.dsm, back.raw, limits)
    assert rows(again.candidates, "algo", "cost") == rows(stage.candidates, "algo", "cost")
    assert cluster.sequence_stage(back.dsm, again, again.recommended().select("dsm_id", "algo"), limits)[0].count() == 20
    book = workbook.workbooks(d, ordering).first()["content"]
    table = workbook.rows(bytes(book))
    labels = [r["label"] for r in sorted(ordering.join(d.elements, ["dsm_id", "idx"]).collect(), key=lambda r: r["pos"])]
    assert table[0] == ["Optimized DSM", *labels] and [r[0] for r in table[1:]] == labels
    assert sum(bool(x) for r in table[1:] for x in r[1:]) == int(planted_blocks(noise=2).sum())
    (tmp_path / "plain.csv").write_text("a,b\n")
    assert workbook.list_sheets(spark, str(tmp_path / "plain.csv")).count() == 0


def test_parameters():
    c = Constraints.of({"min_clusters": "3", "bus_threshold": "", "max_external_ratio": "0.5", "other": 1})
    assert (c.min_clusters, c.bus_threshold, c.max_external_ratio) == (3, None, 0.5)
    assert c.k_range(5) == (3, 4)


def test_entry_works_without_the_training_operators(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_stability_query_makes_all_runs(spark, monkeypatch):
    from depmatrix.plans import cluster, queries

    seen, whole = [], cluster.stability
    monkeypatch.setattr(cluster, "stability", lambda *a, **k: seen.append(whole(*a, **k)) or seen[-1])
    rows = queries.queries()["stability"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 25 and seen[0][2].first()["runs"] == 20


def test_graph_queries_over_the_chains(spark):
    from depmatrix.plans import queries

    known, sf = queries.queries(), "/root/testdata/sf0.01"
    d = queries._chain(spark, sf, "supp")
    edges, n = [(r["i"], r["j"]) for r in d.edges.collect()], d.elements.count()
    reach = np.eye(n, dtype=bool)
    for i, j in edges:
        reach[i, j] = True
    for k in range(n):
        reach |= np.outer(reach[:, k], reach[k])
    want = {i: int(np.flatnonzero(reach[i] & reach[:, i])[0]) for i in range(n)}
    assert {r["idx"]: r["scc"] for r in known["scc_supp_chain"](spark, sf).collect()} == want
    sizes = [list(want.values()).count(c) for c in set(want.values())]
    assert sorted(r["size"] for r in known["loops_supp_chain"](spark, sf).collect()) == sorted(x for x in sizes if x > 1) == [2, 54]
    levels = {r["scc"]: r["level"] for r in known["levels_supp_chain"](spark, sf).collect()}
    assert all(levels[want[i]] > levels[want[j]] for i, j in edges if want[i] != want[j])
    figures = known["process_metrics_supp_chain"](spark, sf).first()
    assert (figures["n_blocks"], figures["largest_loop"], figures["n_levels"]) == (len(sizes), 54, max(levels.values()) + 1)
    assert known["loops_part_chain"](spark, sf).count() == 0
