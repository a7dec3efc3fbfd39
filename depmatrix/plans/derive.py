"""Dependency matrices out of order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from depmatrix.operators.graph import cut
from depmatrix.operators.numbering import numbered
from depmatrix.schema import Dsm


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nation_trade(spark: SparkSession, sf_dir: str, since: str | None = None, until: str | None = None, dsm_id: str = "nation_trade") -> Dsm:
    """A customer's nation depends on the supplier's nation by the number of line items between them; dates limit the orders."""
    orders = table(spark, sf_dir, "orders")
    if since:
        orders = orders.filter(F.col("o_orderdate") >= F.lit(since).cast("timestamp"))
    if until:
        orders = orders.filter(F.col("o_orderdate") < F.lit(until).cast("timestamp"))
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("i"))
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("j"))
    buyers = orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey").join(customer, "o_custkey").select("l_orderkey", "i")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    edges = (
        lines.join(supplier, "l_suppkey")
        .join(buyers, "l_orderkey")
        .filter("i <> j")
        .groupBy("i", "j")
        .agg(F.count("*").cast("double").alias("w"))
    )
    elements = table(spark, sf_dir, "nation").select(
        F.lit(dsm_id).alias("dsm_id"), F.col("n_nationkey").alias("idx"), F.col("n_name").alias("label")
    )
    return Dsm(elements, edges.select(F.lit(dsm_id).alias("dsm_id"), "i", "j", "w"))


def chain(spark: SparkSession, sf_dir: str, key: str, dsm_id: str) -> Dsm:
    """An item depends on the item of the line before it in the same order. key: l_suppkey or l_partkey; idx is its rank."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    steps = lines.withColumn("before", F.lag(key).over(w)).filter(F.col("before").isNotNull() & (F.col("before") != F.col(key)))
    pairs = steps.groupBy(F.col(key).alias("a"), F.col("before").alias("b")).agg(F.count("*").cast("double").alias("w"))
    name, column = ("supplier", "s_suppkey") if key == "l_suppkey" else ("part", "p_partkey")
    ids = table(spark, sf_dir, name).select(F.col(column).alias("item"), F.col("s_name" if name == "supplier" else "p_name").alias("label"))
    ids = numbered(ids, ["item"], "idx", by=None)
    edges = pairs.join(ids.select(F.col("item").alias("a"), F.col("idx").alias("i")), "a").join(
        ids.select(F.col("item").alias("b"), F.col("idx").alias("j")), "b"
    )
    return Dsm(ids.select(F.lit(dsm_id).alias("dsm_id"), "idx", "label"), edges.select(F.lit(dsm_id).alias("dsm_id"), "i", "j", "w"))


def strongest(dsm: Dsm, share: float) -> Dsm:
    """Edges with at least the weight at sorted place floor(share * edges)."""
    order = W.partitionBy("dsm_id").orderBy("w")
    ranked = dsm.edges.groupBy("dsm_id", "w").agg(F.count("*").alias("c"))
    upto = ranked.withColumn("upto", F.sum("c").over(order.rowsBetween(W.unboundedPreceding, 0)))
    total = dsm.edges.groupBy("dsm_id").agg(F.count("*").alias("n"))
    least = (
        upto.join(total, "dsm_id")
        .filter(F.col("upto") > F.floor(F.lit(share) * F.col("n")))
        .groupBy("dsm_id")
        .agg(F.min("w").alias("least"))
    )
    # a table of its own, a row for each matrix: Spark sees that it is small and broadcasts it, else all edges of a matrix were shuffled to one task
    return Dsm(dsm.elements, dsm.edges.join(cut(least), "dsm_id").filter("w >= least").select("dsm_id", "i", "j", "w"))


def at_least(dsm: Dsm, w: float) -> Dsm:
    return Dsm(dsm.elements, dsm.edges.filter(F.col("w") >= w))


def regions(spark: SparkSession, sf_dir: str, dsm_id: str = "nation_trade") -> DataFrame:
    """(dsm_id, idx, cluster): nations by region."""
    return table(spark, sf_dir, "nation").select(
        F.lit(dsm_id).alias("dsm_id"), F.col("n_nationkey").alias("idx"), F.col("n_regionkey").alias("cluster")
    )


def event_flow(events: DataFrame, dsm_id: str = "event_flow") -> DataFrame:
    """Edges: an event type depends on the type before it of the same user; types in alphabetical order are the elements."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    steps = events.withColumn("before", F.lag("event_type").over(w)).filter("before is not null and before <> event_type")
    return (
        steps.groupBy(F.col("event_type").alias("src"), F.col("before").alias("dst"))
        .agg(F.count("*").cast("double").alias("w"))
        .select(F.lit(dsm_id).alias("dsm_id"), "src", "dst", "w")
    )
