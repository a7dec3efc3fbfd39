"""A batch of dependency matrices: an element table and an edge table, dsm_id being the batch axis. w > 0 in (i, j) means that i depends on j."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ELEMENTS = "dsm_id string, idx int, label string"
EDGES = "dsm_id string, i int, j int, w double"
ASSIGN = "dsm_id string, algo string, seed int, idx int, cluster int"
ORDERING = "dsm_id string, pos int, idx int, cluster int, level int"


@dataclass(frozen=True)
class Dsm:
    """elements: dsm_id, idx (0..n-1), label. edges: dsm_id, i, j, w. n comes from elements: isolated ones have no edge."""

    elements: DataFrame
    edges: DataFrame

    def sizes(self) -> DataFrame:
        return self.elements.groupBy("dsm_id").agg(F.count("*").cast("int").alias("n"))


def violations(dsm: Dsm) -> DataFrame:
    """(dsm_id, problem, n): edges without an element, self-edges, weights that aren't positive, gaps or repeats in idx, matrices of fewer than two elements (none, if
    only edges name them)."""
    e, x = dsm.elements.select("dsm_id", "idx"), dsm.edges
    lost = (
        x.select("dsm_id", F.explode(F.array("i", "j")).alias("idx"))
        .join(e, ["dsm_id", "idx"], "left_anti")
        .groupBy("dsm_id")
        .agg(F.lit("edge without element").alias("problem"), F.count("*").alias("n"))
    )
    selfs = x.filter("i = j").groupBy("dsm_id").agg(F.lit("self-edge").alias("problem"), F.count("*").alias("n"))
    weak = x.filter("not coalesce(w > 0, false)").groupBy("dsm_id").agg(
        F.lit("weight not positive").alias("problem"), F.count("*").alias("n")
    )
    gaps = (
        e.groupBy("dsm_id")
        .agg(F.count("*").alias("n"), F.count_distinct("idx").alias("d"), F.min("idx").alias("a"), F.max("idx").alias("b"))
        .filter("n <> d or a <> 0 or b <> n - 1")
        .select("dsm_id", F.lit("idx not 0..n-1").alias("problem"), "n")
    )
    counts = e.groupBy("dsm_id").agg(F.count("*").alias("n"))
    named = e.select("dsm_id").union(x.select("dsm_id")).distinct().join(counts, "dsm_id", "left")
    small = named.select(
        "dsm_id", F.lit("fewer than two elements").alias("problem"), F.coalesce("n", F.lit(0)).cast("long").alias("n")
    ).filter("n < 2")
    return lost.unionByName(selfs).unionByName(weak).unionByName(gaps).unionByName(small)


def validate(dsm: Dsm) -> Dsm:
    """dsm, or ValueError with the first problems."""
    found = violations(dsm).limit(5).collect()
    if found:
        raise ValueError("; ".join(f"{r['dsm_id']}: {r['problem']} ({r['n']})" for r in found))
    return dsm
