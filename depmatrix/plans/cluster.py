"""Clustering of component matrices: competing algorithms, k sweep, repair and sequencing, stability."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from depmatrix.kernels.louvain import louvain
from depmatrix.kernels.mcl import INFLATIONS, mcl
from depmatrix.kernels.repair import within_limits
from depmatrix.kernels.sequence import anneal, feedback
from depmatrix.kernels.spectral import fiedler, spectral_cluster
from depmatrix.kernels.thebeau import thebeau
from depmatrix.operators import scoring
from depmatrix.operators.graph import component_sizes, components, cut
from depmatrix.operators.transforms import submatrix
from depmatrix.params import Constraints
from depmatrix.plans.fanout import dense, done, failures, fan_out, packed
from depmatrix.schema import Dsm

ALGORITHMS = scoring.RANK


def core_of(dsm: Dsm, limits: Constraints) -> tuple[Dsm, DataFrame, DataFrame]:
    """(the core, the map dsm_id, old, idx, the bus elements)."""
    bus = cut(scoring.bus_elements(dsm, limits.bus_threshold).select("dsm_id", "idx"))
    members = dsm.elements.select("dsm_id", "idx").join(bus, ["dsm_id", "idx"], "left_anti")
    core, names = submatrix(dsm, members)
    return core, names, bus


def _labels(found: list[int], **more) -> list[dict]:
    return [{"idx": i, "cluster": int(c), **more} for i, c in enumerate(found)]


def _run(algo: str, a: np.ndarray, limits: Constraints, seed: int | None, inflation: float = 2.0, k: int | None = None) -> list[int]:
    low, high = limits.k_range(len(a))
    if algo == "spectral":
        try:
            return spectral_cluster(a, k=k, low=k or low, high=k or high, seed=42 if seed is None else seed)[0]
        except np.linalg.LinAlgError:
            parts = k or low
            return [i * parts // max(1, len(a)) for i in range(len(a))]
    if algo == "mcl":
        return mcl(a, inflation=inflation)
    return (thebeau if algo == "thebeau" else louvain)(a, seed=seed)


@dataclass(frozen=True)
class Stage1:
    """candidates: dsm_id, algo, n_clusters, cost, external_ratio, k_in_range. assign: dsm_id, algo, idx (of the core), cluster. failures: dsm_id, task, status."""

    core: Dsm
    names: DataFrame
    bus: DataFrame
    candidates: DataFrame
    assign: DataFrame
    failures: DataFrame | None = None

    def recommended(self) -> DataFrame:
        return scoring.recommend(self.candidates)


def cluster_stage(dsm: Dsm, limits: Constraints = Constraints()) -> Stage1:
    """Bus elements out, four algorithms on the core, scores. Seeds: spectral 42, the others the given one or 0."""
    core, names, bus = core_of(dsm, limits)
    core = Dsm(cut(core.elements), cut(core.edges))
    seed = limits.seed or 0
    tasks = [{"algo": a, "inflation": 0.0} for a in ALGORITHMS if a != "mcl"] + [{"algo": "mcl", "inflation": x} for x in INFLATIONS]

    def kernel(a: np.ndarray, task: dict) -> list[dict]:
        found = _run(task["algo"], a, limits, None if task["algo"] == "spectral" else seed, task["inflation"])
        if task["algo"] == "mcl" and len(set(found)) < 2:
            return []
        return _labels(found, algo=task["algo"], inflation=task["inflation"])

    found = cut(fan_out(packed(core), tasks, kernel, "idx int, cluster int, algo string, inflation double"))
    all_ = done(found)
    sizes = core.sizes()
    scored = scoring.k_in_range(
        scoring.scores(core.edges, all_, sizes, ("dsm_id", "algo", "inflation")), sizes, limits.min_clusters, limits.max_clusters
    )
    # of the inflations one within the range comes first, then the cheapest, then the lowest
    order = W.partitionBy("dsm_id", "algo").orderBy(F.desc("k_in_range"), "cost", "inflation")
    best = cut(scored.withColumn("r", F.row_number().over(order)).filter("r = 1").drop("r"))
    assign = all_.join(best.select("dsm_id", "algo", "inflation"), ["dsm_id", "algo", "inflation"], "left_semi")
    return Stage1(core, names, bus, best, assign.select("dsm_id", "algo", "idx", "cluster"), failures(found))


def restored(dsm: Dsm, raw: DataFrame, limits: Constraints = Constraints()) -> Stage1:
    """The first stage out of saved clusters raw (dsm_id, algo, idx of the core, cluster), scored again but not clustered again."""
    core, names, bus = core_of(dsm, limits)
    core, sizes = Dsm(cut(core.elements), cut(core.edges)), core.sizes()
    assign = cut(raw.select("dsm_id", "algo", "idx", "cluster"))
    lost = assign.join(core.elements.select("dsm_id", "idx"), ["dsm_id", "idx"], "left_anti").first()
    if lost:
        raise ValueError(f"saved clusters don't match the core of {lost['dsm_id']}: element {lost['idx']}")
    scored = scoring.k_in_range(
        scoring.scores(core.edges, assign, sizes, ("dsm_id", "algo")), sizes, limits.min_clusters, limits.max_clusters
    )
    return Stage1(core, names, bus, cut(scored), assign)


def k_sweep(core: Dsm, low: int = 2, high: int | None = None, limits: Constraints = Constraints()) -> DataFrame:
    """(dsm_id, k, n_clusters, external_ratio, cost) of spectral clusterings with k pinned; all points, not only the undominated ones."""

    def kernel(a: np.ndarray, task: dict) -> list[dict]:
        if task["k"] > min(12, len(a)) - 1 and high is None or task["k"] > len(a) - 1:
            return []
        return _labels(spectral_cluster(a, k=task["k"], low=task["k"], high=task["k"])[0], k=task["k"])

    runs = done(fan_out(packed(core), [{"k": k} for k in range(low, (high or 11) + 1)], kernel, "idx int, cluster int, k int"))
    return scoring.scores(core.edges, cut(runs), core.sizes(), ("dsm_id", "k")).select(
        "dsm_id", "k", "n_clusters", "external_ratio", "cost"
    )


def sequence_stage(dsm: Dsm, stage: Stage1, chosen: DataFrame, limits: Constraints = Constraints()) -> tuple[DataFrame, DataFrame]:
    """chosen: (dsm_id, algo). (ordering dsm_id, pos, idx, cluster; metrics with feedback before and after, merges, splits, flag)."""
    known = [r[0] for r in chosen.select("algo").distinct().limit(20).collect()]
    if bad := sorted(set(known) - set(ALGORITHMS)):
        raise ValueError(f"unknown algorithm {bad[0]!r}")
    lost = chosen.join(stage.candidates, ["dsm_id", "algo"], "left_anti").limit(1).collect()
    if lost:
        raise ValueError(f"no valid {lost[0]['algo']} partition of {lost[0]['dsm_id']}")
    picked = stage.assign.join(chosen.select("dsm_id", "algo"), ["dsm_id", "algo"], "left_semi")
    labels = picked.groupBy("dsm_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("idx", "cluster"))), lambda x: x["cluster"]).alias("labels")
    )
    pack = packed(stage.core).join(labels, "dsm_id")

    def run(frame):
        import pandas as pd

        row = frame.to_dict("records")[0]
        a = dense(row)
        low, high = limits.k_range(len(a))
        found, merges, splits = within_limits(
            a, [int(x) for x in row["labels"]], limits.min_cluster_size, limits.max_cluster_size, low, high
        )
        out, before, after = [], 0, 0
        for c in sorted(set(found)):
            own = [i for i, x in enumerate(found) if x == c]
            new = anneal(a, own, seed=None if limits.seed is None else limits.seed + c)
            before, after = before + int(feedback(a, own)), after + int(feedback(a, new))
            out += [(i, c) for i in new]
        return pd.DataFrame(
            [(row["dsm_id"], i, p, c, merges, splits, before, after) for p, (i, c) in enumerate(out)],
            columns=["dsm_id", "core", "place", "cluster", "merges", "splits", "before", "after"],
        )

    placed = cut(
        pack.groupBy("dsm_id").applyInPandas(
            run, "dsm_id string, core int, place int, cluster int, merges int, splits int, before long, after long"
        )
    )
    core = placed.join(
        stage.names.select("dsm_id", F.col("old").alias("idx"), F.col("idx").alias("core")), ["dsm_id", "core"]
    ).select("dsm_id", F.lit(0).alias("is_bus"), "place", "idx", "cluster")
    k = placed.groupBy("dsm_id").agg((F.max("cluster") + 1).alias("k"))
    own = F.row_number().over(W.partitionBy("dsm_id").orderBy("idx")) - 1
    bus = stage.bus.join(k, "dsm_id", "left").select(
        "dsm_id", F.lit(1).alias("is_bus"), own.alias("place"), "idx", (F.coalesce("k", F.lit(0)) + own).cast("int").alias("cluster")
    )
    order = W.partitionBy("dsm_id").orderBy("is_bus", "place")
    ordering = cut(core.union(bus).select("dsm_id", (F.row_number().over(order) - 1).cast("int").alias("pos"), "idx", "cluster"))
    info = placed.groupBy("dsm_id").agg(
        F.max("merges").alias("merges"),
        F.max("splits").alias("splits"),
        F.max("before").alias("feedback_before"),
        F.max("after").alias("feedback_after"),
    )
    figures = scoring.over_target(
        scoring.metrics(dsm.edges, ordering.select("dsm_id", "idx", "cluster"), dsm.elements, stage.bus),
        limits.max_external_ratio,
        "external_ratio_core",
    )
    return ordering, figures.join(info, "dsm_id", "left")


def run(dsm: Dsm, limits: Constraints = Constraints()) -> tuple[DataFrame, DataFrame]:
    """Both stages with the recommended algorithm of each matrix."""
    stage = cluster_stage(dsm, limits)
    return sequence_stage(dsm, stage, cut(stage.recommended().select("dsm_id", "algo")), limits)


def stability(dsm: Dsm, algo: str, runs: int = 20, limits: Constraints = Constraints()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(co-clustering, consistency against the first run, one row of figures for each matrix) over seeds 0..runs-1."""
    if algo == "mcl":
        raise ValueError("mcl has no seed; its result is always the same")
    if algo not in ALGORITHMS:
        raise ValueError(f"unknown algorithm {algo!r}")
    runs = max(1, runs)

    def kernel(a: np.ndarray, task: dict) -> list[dict]:
        return _labels(_run(algo, a, limits, task["seed"]), run=task["seed"])

    found = fan_out(packed(dsm), [{"seed": s} for s in range(runs)], kernel, "idx int, cluster int, run int")
    labels = cut(done(found))
    co = scoring.co_clustering(labels)
    agree = cut(scoring.consistency(labels, labels.filter("run = 0").select("dsm_id", "idx", "cluster")))
    figures = (
        agree.groupBy("dsm_id")
        .agg(F.avg("c").alias("mean_consistency"), F.count_if(F.col("c") < 0.7).alias("unsettled"))
        .join(scoring.distinct_partitions(labels), "dsm_id")
        .withColumn("runs", F.lit(runs))
    )
    return co, agree, figures


def fiedler_profile(core: Dsm) -> DataFrame:
    """(dsm_id, idx, value) of the second eigenvector, over the largest component only where the core isn't connected."""
    found = components(core)
    largest = component_sizes(found).filter("rank = 0").select("dsm_id", "component")
    part, names = submatrix(core, found.join(largest, ["dsm_id", "component"], "left_semi"))
    values = done(
        fan_out(packed(part), [{}], lambda a, _: [{"idx": i, "value": float(v)} for i, v in enumerate(fiedler(a))], "idx int, value double")
    )
    return values.join(names, ["dsm_id", "idx"]).select("dsm_id", F.col("old").alias("idx"), "value")


