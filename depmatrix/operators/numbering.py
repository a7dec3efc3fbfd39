"""Places in a total order, without a window over all rows of a matrix in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from depmatrix.operators.graph import cut


def numbered(df: DataFrame, order: list[str], name: str, by: str | None = "dsm_id") -> DataFrame:
    """df with its place 0, 1, ... in the order of the columns, within each value of `by` (None: in all). The order should be total.

    Rows are divided by ranges and sorted in their tasks; only one count for each task is summed up, and for each value of `by` its first place."""
    columns = [by, *order] if by else list(order)
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged = df.repartitionByRange(*columns).sortWithinPartitions(*columns)
    placed = cut(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_inside", inside))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", before.alias("_before"))  # as many rows as tasks
    out = placed.join(F.broadcast(starts), "_part").withColumn(name, F.col("_before") + F.col("_inside"))
    if by:
        first = out.groupBy(by).agg(F.min(name).alias("_first"))
        out = out.join(first, by).withColumn(name, F.col(name) - F.col("_first")).drop("_first")
    return out.withColumn(name, F.col(name).cast("int")).drop("_part", "_inside", "_before")
