"""Connected components of an edge table by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depmatrix.llm.shared import split_join, written


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step on (a, b) with a > b. Minima come from grouped aggregation, and a hub's links aren't joined in one task."""
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    upper = F.when(F.col("v") > F.col("u"), 1).otherwise(0)
    least = written(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.sum(upper).alias("n")).withColumnRenamed("u", "_u"))
    large = (
        split_join(both.filter("v > u"), least, [("u", "_u")], "n")
        .select(F.col("v").alias("a"), F.col("m").alias("b"))
        .filter("a > b")
        .distinct()
    )
    roots = large.groupBy("a").agg(F.min("b").alias("m"))  # a node's links go to distinct minima by now, so none has many
    small = large.join(roots, "a").select(F.greatest("b", "m").alias("x"), F.col("m").alias("y")).filter("x > y")
    return small.union(roots).toDF("a", "b").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(a, b), each a link, to (node, root): root is the smallest node reachable. Nodes without links don't show up.

    Each round is written to the shared folder, so lineage stays short. No edges: an empty result. Self-links and repeats are ignored."""
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct())
    mark = None
    for _ in range(max_rounds):
        seen = now.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first()
        if tuple(seen) == mark or not seen[0]:
            break
        mark, now = tuple(seen), written(_stars(now))
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
