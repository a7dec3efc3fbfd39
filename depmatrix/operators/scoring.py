"""Aggregates and scores, all as grouped aggregation over edges joined with assignments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from depmatrix.functions.scalar import ratio
from depmatrix.operators.graph import cut
from depmatrix.operators.transforms import symmetrise
from depmatrix.schema import Dsm

RANK = ("spectral", "mcl", "thebeau", "louvain")  # who wins a tie


def with_clusters(edges: DataFrame, assign: DataFrame, by: tuple[str, ...] = ("dsm_id",)) -> DataFrame:
    """Edges with ci, cj and the size of i's cluster. by: the key of assign besides idx; dsm_id is shared with edges."""
    sizes = assign.groupBy(*by, "cluster").agg(F.count("*").alias("size"))
    a = assign.join(sizes, [*by, "cluster"]).select(*by, F.col("idx").alias("i"), F.col("cluster").alias("ci"), "size")
    b = assign.select(*by, F.col("idx").alias("j"), F.col("cluster").alias("cj"))
    return edges.join(a, ["dsm_id", "i"]).join(b, [*by, "j"])


def scores(edges: DataFrame, assign: DataFrame, sizes: DataFrame, by: tuple[str, ...] = ("dsm_id",), pow_cc: float = 1.0) -> DataFrame:
    """(by, n_clusters, cost, external_ratio). An edge costs w times its cluster's size, or times n between clusters, each to pow_cc."""
    k = assign.groupBy(*by).agg(F.count_distinct("cluster").alias("n_clusters")).join(sizes, "dsm_id")
    joined = with_clusters(edges.filter("w > 0 and i <> j"), assign, by).join(sizes, "dsm_id")
    same = F.col("ci") == F.col("cj")
    price = F.col("w") * F.pow(F.when(same, F.col("size")).otherwise(F.col("n")).cast("double"), F.lit(pow_cc))
    sums = joined.groupBy(*by).agg(
        F.sum(price).alias("cost"), F.sum(F.when(~same, F.col("w")).otherwise(0.0)).alias("ext"), F.sum("w").alias("total")
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return k.join(sums, list(by), "left").select(
        *by, "n_clusters", zero("cost").alias("cost"), ratio(zero("ext"), zero("total")).alias("external_ratio")
    )


def metrics(edges: DataFrame, assign: DataFrame, elements: DataFrame, bus: DataFrame) -> DataFrame:
    """Final figures: core only for clusters, marks, ratio and cost; total_marks with bus. The ratio's denominator is at least 1; marks are truncated."""
    bus = cut(bus.select("dsm_id", "idx"))  # used twice
    core = cut(assign.select("dsm_id", "idx", "cluster").join(bus, ["dsm_id", "idx"], "left_anti"))
    sizes = core.groupBy("dsm_id").agg(F.count("*").alias("n"))
    k = core.groupBy("dsm_id").agg(F.count_distinct("cluster").alias("n_clusters"))
    joined = with_clusters(edges.filter("w > 0"), core).join(sizes, "dsm_id")
    same = F.col("ci") == F.col("cj")
    sums = joined.groupBy("dsm_id").agg(
        F.sum("w").alias("core"),
        F.sum(F.when(~same, F.col("w")).otherwise(0.0)).alias("ext"),
        F.sum(F.col("w") * F.when(same, F.col("size")).otherwise(F.col("n"))).alias("cost"),
    )
    total = edges.groupBy("dsm_id").agg(F.sum("w").alias("total"))
    out = elements.select("dsm_id").distinct().join(k, "dsm_id", "left").join(sums, "dsm_id", "left").join(total, "dsm_id", "left")
    out = out.join(bus.groupBy("dsm_id").agg(F.count("*").alias("n_bus")), "dsm_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    whole = lambda c: zero(c).cast("long").alias
    return out.select(
        "dsm_id",
        whole("n_clusters")("n_clusters"),
        whole("n_bus")("n_bus"),
        whole("total")("total_marks"),
        whole("core")("core_marks"),
        whole("ext")("external_marks"),
        (zero("ext") / F.greatest(zero("core"), F.lit(1.0))).alias("external_ratio_core"),
        zero("cost").cast("double").alias("cost"),
    )


def feedback(edges: DataFrame, ordering: DataFrame, by: tuple[str, ...] = ("dsm_id",)) -> DataFrame:
    """(by, feedback, feedback_marks): weight from an element to one that comes later; marks truncated."""
    a, b = (
        ordering.select(*by, F.col("idx").alias("i"), F.col("pos").alias("pi")),
        ordering.select(*by, F.col("idx").alias("j"), F.col("pos").alias("pj")),
    )
    got = edges.join(a, ["dsm_id", "i"]).join(b, [*by, "j"]).groupBy(*by).agg(
        F.sum(F.when(F.col("pi") < F.col("pj"), F.col("w")).otherwise(0.0)).alias("f")
    )
    keys = ordering.select(*by).distinct()
    f = F.coalesce("f", F.lit(0.0))
    return keys.join(got, list(by), "left").select(*by, f.alias("feedback"), f.cast("long").alias("feedback_marks"))


def symmetry_ratio(edges: DataFrame) -> DataFrame:
    """Share of edges whose reverse exists."""
    e = edges.filter("w <> 0 and i <> j").select("dsm_id", "i", "j")
    back = e.select("dsm_id", F.col("j").alias("i"), F.col("i").alias("j"), F.lit(1).alias("back"))
    return e.join(back, ["dsm_id", "i", "j"], "left").groupBy("dsm_id").agg(
        F.avg(F.coalesce("back", F.lit(0)).cast("double")).alias("symmetry_ratio")
    )


def connectivity(dsm: Dsm) -> DataFrame:
    """(dsm_id, idx, conn): share of the other elements that one is linked with, either way."""
    degree = symmetrise(dsm.edges.filter("w > 0")).groupBy("dsm_id", F.col("i").alias("idx")).agg(F.count("*").alias("d"))
    conn = F.coalesce("d", F.lit(0)) / F.greatest(F.col("n") - 1, F.lit(1))
    return dsm.elements.join(dsm.sizes(), "dsm_id").join(degree, ["dsm_id", "idx"], "left").select("dsm_id", "idx", conn.alias("conn"))


def bus_elements(dsm: Dsm, threshold: float | None = None) -> DataFrame:
    """(dsm_id, idx, conn, threshold) of elements above the threshold; None: median + 3.5 robust deviations, at least 0.15."""
    conn = connectivity(dsm) if threshold is not None else cut(connectivity(dsm))  # read three times
    if threshold is not None:
        return conn.withColumn("threshold", F.lit(float(threshold))).filter("conn > threshold")
    mid = conn.groupBy("dsm_id").agg(F.median("conn").alias("mid"), F.stddev_pop("conn").alias("sd"))
    apart = conn.join(mid, "dsm_id").groupBy("dsm_id").agg(F.median(F.abs(F.col("conn") - F.col("mid"))).alias("mad"))
    spread = F.when(F.col("mad") > 0, 1.4826 * F.col("mad")).otherwise(F.col("sd"))
    limit = mid.join(apart, "dsm_id").select("dsm_id", F.greatest(F.col("mid") + 3.5 * spread, F.lit(0.15)).alias("threshold"))
    return conn.join(limit, "dsm_id").filter("conn > threshold")


def recommend(candidates: DataFrame) -> DataFrame:
    """The cheapest algorithm of each matrix: (dsm_id, algo, cost); ties by RANK."""
    rank = sum((F.when(F.col("algo") == a, k).otherwise(0) for k, a in enumerate(RANK)), F.lit(0))
    unknown = F.when(F.col("algo").isin(*RANK), rank).otherwise(len(RANK))
    order = W.partitionBy("dsm_id").orderBy("cost", unknown, "algo")
    return candidates.withColumn("r", F.row_number().over(order)).filter("r = 1").select("dsm_id", "algo", "cost")


def k_in_range(candidates: DataFrame, core_sizes: DataFrame, min_clusters: int = 2, max_clusters: int = 10) -> DataFrame:
    low = F.greatest(F.lit(2), F.least(F.lit(min_clusters), F.col("n") - 1))
    high = F.greatest(low, F.least(F.lit(max_clusters), F.col("n") - 1))
    return candidates.join(core_sizes, "dsm_id").withColumn("k_in_range", F.col("n_clusters").between(low, high)).drop("n")


def over_target(scored: DataFrame, limit: float = 0.30, column: str = "external_ratio") -> DataFrame:
    return scored.withColumn("exceeds_target", F.col(column) > limit)


def co_clustering(runs: DataFrame) -> DataFrame:
    """(dsm_id, i, j, frac): share of runs (dsm_id, run, idx, cluster) that put i and j together; pairs never together have no row."""
    n = runs.groupBy("dsm_id").agg(F.count_distinct("run").alias("runs"))
    a, b = runs.withColumnRenamed("idx", "i"), runs.withColumnRenamed("idx", "j")
    pairs = a.join(b, ["dsm_id", "run", "cluster"]).groupBy("dsm_id", "i", "j").agg(F.count("*").alias("c"))
    return pairs.join(n, "dsm_id").select("dsm_id", "i", "j", (F.col("c") / F.col("runs")).alias("frac"))


def consistency(runs: DataFrame, reference: DataFrame) -> DataFrame:
    """(dsm_id, idx, c): mean share of runs with its peers in the reference (dsm_id, idx, cluster); without peers 1.

    Peers aren't paired: those in one cluster of a run are as many as the run's cluster and the reference's have in common."""
    named = reference.select("dsm_id", "idx", F.col("cluster").alias("peers"))
    sizes = named.groupBy("dsm_id", "peers").agg(F.count("*").alias("size"))
    n = runs.groupBy("dsm_id").agg(F.count_distinct("run").alias("runs"))
    placed = runs.select("dsm_id", "run", "idx", "cluster").join(named, ["dsm_id", "idx"])
    common = placed.groupBy("dsm_id", "run", "cluster", "peers").agg((F.count("*") - 1).alias("together"))
    met = placed.join(common, ["dsm_id", "run", "cluster", "peers"]).groupBy("dsm_id", "idx").agg(F.sum("together").alias("met"))
    share = F.coalesce("met", F.lit(0)) / (F.col("runs") * (F.col("size") - 1))
    return (
        named.join(sizes, ["dsm_id", "peers"])
        .join(n, "dsm_id")
        .join(met, ["dsm_id", "idx"], "left")
        .select("dsm_id", "idx", F.when(F.col("size") < 2, F.lit(1.0)).otherwise(share).alias("c"))
    )


def distinct_partitions(runs: DataFrame) -> DataFrame:
    """(dsm_id, distinct_partitions by raw labels, distinct_canonical up to renaming of clusters)."""
    first = runs.groupBy("dsm_id", "run", "cluster").agg(F.min("idx").alias("first"))
    both = runs.join(first, ["dsm_id", "run", "cluster"]).groupBy("dsm_id", "run").agg(
        F.sort_array(F.collect_list(F.struct("idx", "cluster"))).alias("raw"), F.sort_array(F.collect_list(F.struct("idx", "first"))).alias("canonical"))
    return both.groupBy("dsm_id").agg(
        F.count_distinct("raw").alias("distinct_partitions"), F.count_distinct("canonical").alias("distinct_canonical")
    )


def unsettled(consistent: DataFrame, below: float = 0.7) -> DataFrame:
    return consistent.filter(F.col("c") < below)


def members(assign: DataFrame, elements: DataFrame) -> DataFrame:
    """(dsm_id, cluster, labels in the order of idx, joined by a comma)."""
    listed = F.sort_array(F.collect_list(F.struct("idx", "label")))
    return assign.join(elements, ["dsm_id", "idx"]).groupBy("dsm_id", "cluster").agg(
        F.array_join(F.transform(listed, lambda x: x["label"]), ", ").alias("labels")
    )


def guidance(metrics: DataFrame) -> DataFrame:
    """Which view suits a process matrix, from its metrics (symmetry_ratio, largest_loop, n_loops, n_elements)."""
    said: Column = F.when(F.col("symmetry_ratio") >= 0.6, "symmetric").when(
        (F.col("n_loops") >= 1) & (F.col("largest_loop") >= 0.8 * F.col("n_elements")), "giant_loop"
    ).otherwise("process")
    return metrics.withColumn("guidance", said)
