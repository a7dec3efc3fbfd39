"""What-if moves on a clustering, and single repair passes that are plain plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from depmatrix.operators.scoring import scores
from depmatrix.operators.transforms import relabel, symmetrise
from depmatrix.schema import Dsm


#: What a result may come from, with its title.
TITLES = {
    "spectral": "Spectral clustering",
    "mcl": "MCL clustering",
    "thebeau": "Thebeau clustering",
    "louvain": "Louvain clustering",
    "final": "Final (sequenced)",
    "process": "Partitioned (sequenced)",
}


def move(assign: DataFrame, idx: int, to: int | None = None) -> DataFrame:
    """assign (dsm_id, idx, cluster) with one element moved to a cluster, or to a new one (largest id + 1, above those of bus elements, which assign holds too)."""
    if to is not None:
        return assign.withColumn("cluster", F.when(F.col("idx") == idx, F.lit(to)).otherwise(F.col("cluster")))
    new = assign.groupBy("dsm_id").agg((F.max("cluster") + 1).alias("new"))
    return assign.join(new, "dsm_id").withColumn(
        "cluster", F.when(F.col("idx") == idx, F.col("new")).otherwise(F.col("cluster"))
    ).drop("new")


def finalise(dsm: Dsm, ordering: DataFrame, source: str) -> tuple[DataFrame, str]:
    """(ordering (dsm_id, pos, idx, cluster), title) if the source is known and the ordering has each element once, with a cluster; else ValueError."""
    if source not in TITLES:
        raise ValueError(f"unknown source {source!r}")
    have, want = ordering.select("dsm_id", "idx", "cluster"), dsm.elements.select("dsm_id", "idx")
    bad = (
        have.groupBy("dsm_id", "idx")
        .agg(F.count("*").alias("n"), F.count("cluster").alias("k"))
        .join(want.withColumn("known", F.lit(True)), ["dsm_id", "idx"], "full_outer")
    )
    first = bad.filter("n is null or n <> 1 or k <> 1 or known is null").first()
    if first:
        raise ValueError(f"the result doesn't match {first['dsm_id']}: element {first['idx']}")
    return ordering, f"Optimized DSM - {TITLES[source]}"


def rescore(
    edges: DataFrame, sizes: DataFrame, base: DataFrame, trial: DataFrame, tolerance: float = 1e-9, bus: DataFrame | None = None
) -> DataFrame:
    """(dsm_id, base_cost, cost, base_external, external, verdict improved/worse/same by cost, external_verdict by external ratio).

    bus (dsm_id, idx): elements that are left out of both, and of the number of elements."""
    if bus is not None:
        without = lambda df: df.join(bus.select("dsm_id", "idx"), ["dsm_id", "idx"], "left_anti")
        base, trial = without(base), without(trial)
        sizes = base.groupBy("dsm_id").agg(F.count("*").cast("int").alias("n"))
    a = scores(edges, base, sizes).select("dsm_id", F.col("cost").alias("base_cost"), F.col("external_ratio").alias("base_external"))
    b = scores(edges, trial, sizes).select("dsm_id", "cost", F.col("external_ratio").alias("external"))
    said = lambda gain: F.when(gain < -tolerance, "improved").when(gain > tolerance, "worse").otherwise("same")
    return (
        a.join(b, "dsm_id")
        .withColumn("verdict", said(F.col("cost") - F.col("base_cost")))
        .withColumn("external_verdict", said(F.col("external") - F.col("base_external")))
    )


def enforce_min_size(edges: DataFrame, assign: DataFrame, least: int = 2) -> DataFrame:
    """Each element of an undersized cluster moves to the large cluster that it depends on most; ties and none: the large cluster that appears first.

    One pass suffices, since elements move to large clusters only. No large cluster: unchanged."""
    sizes = assign.groupBy("dsm_id", "cluster").agg(F.count("*").alias("size"), F.min("idx").alias("first"))
    large = sizes.filter(F.col("size") >= least).select("dsm_id", F.col("cluster").alias("to"), "first")
    small = assign.join(sizes.filter(F.col("size") < least), ["dsm_id", "cluster"], "left_semi").select("dsm_id", "idx")
    target = assign.select("dsm_id", F.col("idx").alias("j"), F.col("cluster").alias("to"))
    pull = (
        small.join(edges, (small["dsm_id"] == edges["dsm_id"]) & (small["idx"] == edges["i"]))
        .select(small["dsm_id"], "idx", "j", "w")
        .join(target, ["dsm_id", "j"])
        .groupBy("dsm_id", "idx", "to")
        .agg(F.sum("w").alias("pull"))
    )
    offers = small.join(large, "dsm_id").join(pull, ["dsm_id", "idx", "to"], "left").withColumn("pull", F.coalesce("pull", F.lit(0.0)))
    best = offers.withColumn(
        "r", F.row_number().over(W.partitionBy("dsm_id", "idx").orderBy(F.desc("pull"), "first"))
    ).filter("r = 1").select("dsm_id", "idx", "to")
    moved = assign.join(best, ["dsm_id", "idx"], "left").select("dsm_id", "idx", F.coalesce("to", "cluster").alias("cluster"))
    return relabel(moved)


def merge_step(edges: DataFrame, assign: DataFrame, max_size: int = 20) -> DataFrame:
    """(dsm_id, keep, gone): the pair of clusters to merge next: fits max_size first, then most weight between them, then lowest ids."""
    sizes = assign.groupBy("dsm_id", "cluster").agg(F.count("*").alias("size"))
    a, b = sizes.toDF("dsm_id", "keep", "sa"), sizes.toDF("dsm_id", "gone", "sb")
    x, y = (
        assign.select("dsm_id", F.col("idx").alias("i"), F.col("cluster").alias("keep")),
        assign.select("dsm_id", F.col("idx").alias("j"), F.col("cluster").alias("gone")),
    )
    weight = (
        symmetrise(edges, 1.0)
        .join(x, ["dsm_id", "i"])
        .join(y, ["dsm_id", "j"])
        .filter("keep < gone")
        .groupBy("dsm_id", "keep", "gone")
        .agg(F.sum("w").alias("w"))
    )
    pairs = a.join(b, "dsm_id").filter("keep < gone").join(weight, ["dsm_id", "keep", "gone"], "left")
    fits = (F.col("sa") + F.col("sb") <= max_size) if max_size > 0 else F.lit(True)
    order = W.partitionBy("dsm_id").orderBy(F.when(fits, 0).otherwise(1), F.desc(F.coalesce("w", F.lit(0.0))), "keep", "gone")
    return pairs.withColumn("r", F.row_number().over(order)).filter("r = 1").select("dsm_id", "keep", "gone")


def aggregate_communities(edges: DataFrame, assign: DataFrame) -> DataFrame:
    """(dsm_id, ci, cj, w): the matrix of communities; weights within one stand on the diagonal."""
    a, b = (
        assign.select("dsm_id", F.col("idx").alias("i"), F.col("cluster").alias("ci")),
        assign.select("dsm_id", F.col("idx").alias("j"), F.col("cluster").alias("cj")),
    )
    return edges.filter("w > 0").join(a, ["dsm_id", "i"]).join(b, ["dsm_id", "j"]).groupBy("dsm_id", "ci", "cj").agg(F.sum("w").alias("w"))
