"""Comparison of two versions of a matrix, aligned by label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from depmatrix.schema import Dsm


def labelled_edges(dsm: Dsm) -> DataFrame:
    """(dsm_id, src, dst, w) by label; of elements with one label the last counts."""
    last = W.partitionBy("dsm_id", "label").orderBy(F.desc("idx"))
    e = dsm.elements.withColumn("r", F.row_number().over(last)).filter("r = 1").select("dsm_id", "idx", "label")
    a, b = (
        e.select("dsm_id", F.col("idx").alias("i"), F.col("label").alias("src")),
        e.select("dsm_id", F.col("idx").alias("j"), F.col("label").alias("dst")),
    )
    return dsm.edges.filter("w <> 0 and i <> j").join(a, ["dsm_id", "i"]).join(b, ["dsm_id", "j"]).select("dsm_id", "src", "dst", "w")


def diff(before: Dsm, after: Dsm) -> DataFrame:
    """(dsm_id, src, dst, w_a, w_b, status): 1 same, 2 added, 3 removed, 4 reweighted; cells empty in both have no row."""
    a, b = labelled_edges(before).withColumnRenamed("w", "w_a"), labelled_edges(after).withColumnRenamed("w", "w_b")
    status = F.when(F.col("w_a").isNull(), 2).when(F.col("w_b").isNull(), 3).when(F.col("w_a") == F.col("w_b"), 1).otherwise(4)
    return a.join(b, ["dsm_id", "src", "dst"], "full_outer").withColumn("status", status)


def summary(changes: DataFrame) -> DataFrame:
    return changes.groupBy("dsm_id").agg(
        F.count_if(F.col("status") == 1).alias("same"),
        F.count_if(F.col("status") == 2).alias("added"),
        F.count_if(F.col("status") == 3).alias("removed"),
        F.count_if(F.col("status") == 4).alias("changed"),
    )


def element_changes(before: Dsm, after: Dsm) -> DataFrame:
    """(dsm_id, label, change): new or gone."""
    a, b = before.elements.select("dsm_id", "label").distinct(), after.elements.select("dsm_id", "label").distinct()
    key = ["dsm_id", "label"]
    return (
        b.join(a, key, "left_anti")
        .withColumn("change", F.lit("new"))
        .union(a.join(b, key, "left_anti").withColumn("change", F.lit("gone")))
    )
