"""Projections and rearrangements of matrices. Each returns new tables; inputs stay as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from depmatrix.operators.numbering import numbered
from depmatrix.schema import EDGES, Dsm


def transpose(edges: DataFrame) -> DataFrame:
    return edges.select("dsm_id", F.col("j").alias("i"), F.col("i").alias("j"), "w")


def zero_diagonal(edges: DataFrame) -> DataFrame:
    return edges.filter("i <> j")


def symmetrise(edges: DataFrame, factor: float = 0.5) -> DataFrame:
    """(A + A') times factor: 0.5 for modularity and spectra, 1.0 for bids."""
    return zero_diagonal(edges).union(transpose(zero_diagonal(edges))).groupBy("dsm_id", "i", "j").agg((F.sum("w") * factor).alias("w"))


def submatrix(dsm: Dsm, members: DataFrame) -> tuple[Dsm, DataFrame]:
    """(the matrix of the members (dsm_id, idx), numbered anew in their old order; the map dsm_id, old, idx)."""
    kept = dsm.elements.join(members.select("dsm_id", "idx").distinct(), ["dsm_id", "idx"], "left_semi")
    named = numbered(kept.select("dsm_id", F.col("idx").alias("old"), "label"), ["old"], "idx")
    return (
        Dsm(
            named.select("dsm_id", "idx", "label"),
            renumber(dsm.edges, named.select("dsm_id", F.col("old").alias("idx"), F.col("idx").alias("to"))),
        ),
        named.select("dsm_id", "old", "idx"),
    )


def renumber(edges: DataFrame, to: DataFrame) -> DataFrame:
    """Edges with both ends replaced by to (dsm_id, idx, to); edges with an end that isn't in it go."""
    a, b = (
        to.select("dsm_id", F.col("idx").alias("i"), F.col("to").alias("ti")),
        to.select("dsm_id", F.col("idx").alias("j"), F.col("to").alias("tj")),
    )
    return edges.join(a, ["dsm_id", "i"]).join(b, ["dsm_id", "j"]).select("dsm_id", F.col("ti").alias("i"), F.col("tj").alias("j"), "w")


def permute(dsm: Dsm, ordering: DataFrame) -> Dsm:
    """The matrix in the order of ordering (dsm_id, idx, pos)."""
    to = ordering.select("dsm_id", "idx", F.col("pos").alias("to"))
    elements = dsm.elements.join(to, ["dsm_id", "idx"]).select("dsm_id", F.col("to").alias("idx"), "label")
    return Dsm(elements, renumber(dsm.edges, to))


def grouped_order(elements: DataFrame, assign: DataFrame, bus: DataFrame) -> DataFrame:
    """(dsm_id, pos, idx, cluster): core elements by cluster and index, then bus elements, each a cluster of its own."""
    core = (
        elements.select("dsm_id", "idx")
        .join(bus.select("dsm_id", "idx"), ["dsm_id", "idx"], "left_anti")
        .join(assign.select("dsm_id", "idx", "cluster"), ["dsm_id", "idx"])
    )
    k = core.groupBy("dsm_id").agg((F.max("cluster") + 1).alias("k"))
    own = W.partitionBy("dsm_id").orderBy("idx")
    extra = bus.select("dsm_id", "idx").join(k, "dsm_id", "left").select(
        "dsm_id", "idx", (F.coalesce("k", F.lit(0)) + F.row_number().over(own) - 1).alias("cluster")
    )
    both = core.select("dsm_id", "idx", "cluster", F.lit(0).alias("is_bus")).union(extra.select("dsm_id", "idx", "cluster", F.lit(1)))
    return numbered(both, ["is_bus", "cluster", "idx"], "pos").select("dsm_id", "pos", "idx", F.col("cluster").cast("int").alias("cluster"))


def relabel(assign: DataFrame, by: tuple[str, ...] = ("dsm_id",)) -> DataFrame:
    """Cluster ids 0..k-1 in the order of the old ones. Only the ids are ranked, not their members."""
    ids = assign.select(*by, "cluster").distinct()
    new = ids.withColumn("to", (F.row_number().over(W.partitionBy(*by).orderBy("cluster")) - 1).cast("int"))
    return assign.join(new, [*by, "cluster"]).withColumn("cluster", F.col("to")).select(*assign.columns)


def column_normalise(edges: DataFrame) -> DataFrame:
    """Each column divided by its sum. Sums are grouped and joined, so a full column isn't one task."""
    sums = edges.groupBy("dsm_id", "j").agg(F.sum("w").alias("s"))
    return edges.join(sums, ["dsm_id", "j"]).select(
        "dsm_id", "i", "j", F.when(F.col("s") == 0, F.col("w")).otherwise(F.col("w") / F.col("s")).alias("w")
    )


def with_edge(dsm: Dsm, dsm_id: str, i: int, j: int, w: float) -> Dsm:
    """Sets one cell; 0 clears it, the diagonal can't be set."""
    if i == j:
        return dsm
    rest = dsm.edges.filter(~((F.col("dsm_id") == dsm_id) & (F.col("i") == i) & (F.col("j") == j)))
    one = dsm.elements.sparkSession.range(1).select(
        F.lit(dsm_id).alias("dsm_id"), F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(float(w)).alias("w")
    )
    return Dsm(dsm.elements, rest.unionByName(one) if w > 0 else rest)


def toggle_edge(dsm: Dsm, dsm_id: str, i: int, j: int) -> Dsm:
    """A set cell becomes empty, an empty one 1."""
    if i == j:
        return dsm
    here = (F.col("dsm_id") == dsm_id) & (F.col("i") == i) & (F.col("j") == j)
    one = dsm.elements.sparkSession.range(1).select(
        F.lit(dsm_id).alias("dsm_id"), F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(1.0).alias("w")
    )
    return Dsm(
        dsm.elements,
        dsm.edges.filter(~here).unionByName(
            one.join(dsm.edges.filter(here), ["dsm_id", "i", "j"], "left_anti").select("dsm_id", "i", "j", "w")
        ),
    )


def rename(dsm: Dsm, dsm_id: str, idx: int, label: str) -> Dsm:
    here = (F.col("dsm_id") == dsm_id) & (F.col("idx") == idx)
    return Dsm(dsm.elements.withColumn("label", F.when(here, F.lit(label)).otherwise(F.col("label"))), dsm.edges)


def add_element(dsm: Dsm, dsm_id: str, label: str) -> Dsm:
    new = (
        dsm.elements.filter(F.col("dsm_id") == dsm_id)
        .agg(F.coalesce(F.max("idx") + 1, F.lit(0)).cast("int").alias("idx"))
        .select(F.lit(dsm_id).alias("dsm_id"), "idx", F.lit(label).alias("label"))
    )
    return Dsm(dsm.elements.unionByName(new), dsm.edges)


def remove_element(dsm: Dsm, dsm_id: str, idx: int) -> Dsm:
    """Without an element and its edges; later ones move up."""
    here = F.col("dsm_id") == dsm_id
    up = lambda c: (F.col(c) - F.when(here & (F.col(c) > idx), 1).otherwise(0)).cast("int").alias(c)
    gone = lambda c: here & (F.col(c) == idx)
    return Dsm(
        dsm.elements.filter(~gone("idx")).select("dsm_id", up("idx"), "label"),
        dsm.edges.filter(~gone("i") & ~gone("j")).select("dsm_id", up("i"), up("j"), "w"),
    )


def blank(spark: SparkSession, dsm_id: str = "blank", n: int = 5) -> Dsm:
    elements = spark.range(n).select(
        F.lit(dsm_id).alias("dsm_id"), F.col("id").cast("int").alias("idx"), F.concat(F.lit("Element "), F.col("id") + 1).alias("label")
    )
    return Dsm(elements, spark.createDataFrame([], EDGES))
