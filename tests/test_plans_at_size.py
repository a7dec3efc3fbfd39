"""What made large tables slow: rows that were shuffled, exploded or worked out again without need."""

from __future__ import annotations

import numpy as np
from fixtures import dsm_of
from pyspark.sql import functions as F

from depmatrix.operators import graph, markov, tearing
from depmatrix.plans import derive
from depmatrix.schema import Dsm


def plan(df, which="optimizedPlan"):
    return getattr(df._jdf.queryExecution(), which)().toString()


def test_the_strongest_edges_are_not_shuffled_by_matrix(spark):
    rows = spark.range(3000).selectExpr("'m' AS dsm_id", "cast(id AS int) AS i", "cast(id + 1 AS int) AS j", "cast(id % 700 AS double) AS w")
    d = derive.strongest(Dsm(rows.select("dsm_id", F.col("i").alias("idx")), graph.cut(rows)), 0.9)
    told = plan(d.edges, "executedPlan")
    assert "BroadcastHashJoin" in told and "SortMergeJoin" not in told
    weights = sorted(k % 700 for k in range(3000))
    assert sorted(r["w"] for r in d.edges.collect()) == [w for w in weights if w >= weights[2700]]


def test_ways_are_compared_before_they_are_exploded(spark):
    n = 12
    every, ring = np.ones((n, n)) - np.eye(n), np.roll(np.eye(n), 1, axis=1)
    d = dsm_of(spark, every=every, ring=ring)
    sccs = graph.cut(graph.strong_components(d.elements, d.edges))
    links = graph.cut(tearing.inside_loops(d.edges, sccs).select("dsm_id", "scc", F.col("i").alias("a"), F.col("j").alias("b")))
    array = F.expr("CASE WHEN x = 0 THEN array() WHEN dsm_id = 'every' THEN array(x) ELSE sequence(1, x) END").cast("array<int>")
    at = F.expr("CASE WHEN x = 0 THEN -1 WHEN dsm_id = 'every' THEN 0 ELSE x - 1 END")
    tree = sccs.select("dsm_id", "scc", F.col("idx").alias("x")).withColumn("way", array).withColumn("at", at)
    left = tearing._shared(links, tree).groupBy("dsm_id").agg(F.sum(F.size("way")), F.count("*")).collect()
    assert sorted(map(tuple, left)) == [("every", 0, n), ("ring", n * (n - 1) // 2, n)]


def test_entries_of_a_column_are_sorted_once(spark):
    row = spark.sql("SELECT array(named_struct('i', 2, 'w', 1D), named_struct('i', 5, 'w', 3D), named_struct('i', 7, 'w', 1D)) AS entries FROM range(2)")
    found = row.select(markov._normalised(markov._largest(F.col("entries"), 2)).alias("entries"))
    assert plan(found).count("sort_array") == 1
    assert [tuple(e) for e in found.first()["entries"]] == [(5, 0.75), (2, 0.25)]
