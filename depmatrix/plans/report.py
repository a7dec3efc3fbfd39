"""The tables of a report, one row set for all matrices of a batch: what a reader compares, chooses and finds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depmatrix.operators import diff as D
from depmatrix.operators.numbering import numbered
from depmatrix.operators import scoring
from depmatrix.params import Constraints
from depmatrix.plans.cluster import Stage1
from depmatrix.plans.process import Process
from depmatrix.schema import Dsm


def comparison(stage: Stage1, chosen: DataFrame | None = None) -> DataFrame:
    """(dsm_id, algo, n_clusters, cost, external_ratio, recommended, chosen), a row for each algorithm; those without a result have nulls."""
    algos = F.explode(F.array(*(F.lit(a) for a in scoring.RANK))).alias("algo")
    out = stage.core.elements.select("dsm_id").distinct().select("dsm_id", algos).join(
        stage.candidates.select("dsm_id", "algo", "n_clusters", "cost", "external_ratio"), ["dsm_id", "algo"], "left"
    )
    best = stage.recommended().select("dsm_id", "algo", F.lit(True).alias("recommended"))
    picked = (
        best.withColumnRenamed("recommended", "chosen") if chosen is None else chosen.select("dsm_id", "algo", F.lit(True).alias("chosen"))
    )
    flag = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return out.join(best, ["dsm_id", "algo"], "left").join(picked, ["dsm_id", "algo"], "left").select(
        "dsm_id", "algo", "n_clusters", "cost", "external_ratio", flag("recommended"), flag("chosen")
    )


def parameters(dsm: Dsm, limits: Constraints = Constraints()) -> DataFrame:
    """(dsm_id, k_range, cluster_size, bus_threshold, seed), as a reader is told."""
    said = {
        "k_range": f"{limits.min_clusters}-{limits.max_clusters}",
        "cluster_size": f"{limits.min_cluster_size}-{limits.max_cluster_size}",
        "bus_threshold": "adaptive" if limits.bus_threshold is None else f"{limits.bus_threshold:g}",
        "seed": "none" if limits.seed is None else str(limits.seed),
    }
    return dsm.elements.select("dsm_id").distinct().select("dsm_id", *(F.lit(v).alias(k) for k, v in said.items()))


def membership(ordering: DataFrame, dsm: Dsm) -> DataFrame:
    """(dsm_id, cluster from 1 on, size, members in the final order, joined by a comma)."""
    named = ordering.select("dsm_id", "pos", "idx", "cluster").join(dsm.elements, ["dsm_id", "idx"])
    listed = F.transform(F.sort_array(F.collect_list(F.struct("pos", "label"))), lambda x: x["label"])
    return (
        named.groupBy("dsm_id", "cluster")
        .agg(F.count("*").alias("size"), F.array_join(listed, ", ").alias("members"))
        .withColumn("cluster", F.col("cluster") + 1)
    )


def component_report(
    dsm: Dsm,
    stage: Stage1,
    ordering: DataFrame,
    metrics: DataFrame,
    chosen: DataFrame | None = None,
    limits: Constraints = Constraints(),
    stability: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """comparison, parameters, final (figures of the sequenced clustering), membership, and stability if its figures are given."""
    final = metrics.select("dsm_id", "n_clusters", "external_ratio_core", "cost", "feedback_before", "feedback_after")
    out = {
        "comparison": comparison(stage, chosen),
        "parameters": parameters(dsm, limits),
        "final": final,
        "membership": membership(ordering, dsm),
    }
    return out if stability is None else out | {"stability": stability.select("dsm_id", "runs", "mean_consistency", "distinct_partitions")}


def process_report(dsm: Dsm, found: Process) -> dict[str, DataFrame]:
    """summary (loops, coupled of all tasks, levels, feedback before and after) and tears, with labels: from is what depends, to what it depends on."""
    name = lambda i, label: dsm.elements.select("dsm_id", F.col("idx").alias(i), F.col("label").alias(label))
    loops = found.blocks.filter("is_loop").select("dsm_id", "block")
    number = numbered(loops, ["block"], "place").select("dsm_id", "block", (F.col("place") + 1).cast("long").alias("loop"))
    tears = (
        found.tears.join(number, ["dsm_id", "block"])
        .join(name("i", "from_label"), ["dsm_id", "i"])
        .join(name("j", "to_label"), ["dsm_id", "j"])
    )
    summary = found.metrics.select("dsm_id", "n_loops", "coupled_elements", "n_elements", "n_levels", "feedback_before", "feedback_after")
    return {"summary": summary, "tears": tears.select("dsm_id", "loop", "rank", "from_label", "to_label", "w", "impact", "fully_resolves")}


def diff_report(a: Dsm, b: Dsm) -> DataFrame:
    """(dsm_id, added, removed, changed, new_elements, gone_elements): counts of edges, labels in order, joined by a comma."""
    counts = D.summary(D.diff(a, b)).select("dsm_id", "added", "removed", "changed")
    changes = D.element_changes(a, b)
    listed = lambda kind: F.array_join(
        F.sort_array(F.collect_list(F.when(F.col("change") == kind, F.col("label")))), ", "
    ).alias(f"{kind}_elements")
    labels = changes.groupBy("dsm_id").agg(listed("new"), listed("gone"))
    return counts.join(labels, "dsm_id", "left").fillna("", ["new_elements", "gone_elements"])
