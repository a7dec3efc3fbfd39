"""Process matrices: blocks in order of dependency, order within loops, tears, figures."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depmatrix.kernels.sequence import anneal, anneal_links, block_levels, strong_components, tears
from depmatrix.operators import graph, scoring, tearing
from depmatrix.operators.graph import cut
from depmatrix.operators.numbering import numbered
from depmatrix.plans.fanout import MAX_N, done, fan_out, packed
from depmatrix.schema import Dsm

_TEARS = "block int, rank int, i int, j int, w double, impact int, largest_loop_after int, fully_resolves boolean"


@dataclass(frozen=True)
class Process:
    """ordering: dsm_id, pos, idx, block, level. blocks: dsm_id, block, level, is_loop, members. metrics: a row for each matrix. tears: dsm_id, block, rank, i, j, w, ..., found when
    they are asked for."""

    ordering: DataFrame
    blocks: DataFrame
    metrics: DataFrame
    cuts: Callable[[], DataFrame]

    @cached_property
    def tears(self) -> DataFrame:
        return self.cuts()


def partition(dsm: Dsm, seed: int | None = None, suggestions: int = 5, max_n: int = MAX_N, in_task: int = graph.IN_TASK) -> Process:
    """Matrices of at most max_n elements go to kernels, larger ones stay in tables, where blocks are numbered by level and smallest element."""
    sizes = dsm.sizes()
    least, most = sizes.agg(F.min("n"), F.max("n")).first()
    parts = []
    if most is None or least <= max_n:
        parts.append(_in_kernels(dsm if most is None or most <= max_n else _of(dsm, sizes.filter(F.col("n") <= max_n)), seed, suggestions))
    if most is not None and most > max_n:
        parts.append(_in_tables(dsm if least > max_n else _of(dsm, sizes.filter(F.col("n") > max_n)), seed, suggestions, in_task))
    placed = reduce(DataFrame.unionByName, (p for p, _ in parts))
    blocks = placed.groupBy("dsm_id", "block").agg(
        F.max("level").alias("level"), (F.max("size") > 1).alias("is_loop"), F.sort_array(F.collect_list("idx")).alias("members")
    )
    return Process(placed.drop("size"), blocks, process_metrics(dsm, placed), lambda: reduce(DataFrame.unionByName, (cuts() for _, cuts in parts)))


def _of(dsm: Dsm, which: DataFrame) -> Dsm:
    return Dsm(dsm.elements.join(which.select("dsm_id"), "dsm_id", "left_semi"), dsm.edges.join(which.select("dsm_id"), "dsm_id", "left_semi"))


def _in_kernels(dsm: Dsm, seed: int | None, suggestions: int) -> tuple[DataFrame, Callable[[], DataFrame]]:
    """(placed, as by_levels(), and what finds the tears)."""
    pack = packed(dsm)

    def order(a: np.ndarray, _: dict) -> list[dict]:
        blocks, out = strong_components(a), []
        levels = block_levels(a, blocks)
        for b, members in enumerate(blocks):
            for i in anneal(a, members, seed=None if seed is None else seed + b):
                out.append({"pos": len(out), "idx": i, "block": b, "level": levels[b], "size": len(members)})
        return out

    def cuts(a: np.ndarray, _: dict) -> list[dict]:
        return [
            {"block": b, "rank": r + 1, **t}
            for b, m in enumerate(strong_components(a))
            if len(m) > 1
            for r, t in enumerate(tears(a, m, suggestions))
        ]

    placed = cut(done(fan_out(pack, [{}], order, "pos int, idx int, block int, level int, size int")))
    return placed, lambda: done(fan_out(pack, [{}], cuts, _TEARS))


def _in_tables(dsm: Dsm, seed: int | None, suggestions: int, in_task: int) -> tuple[DataFrame, Callable[[], DataFrame]]:
    """As _in_kernels(), for matrices that no task holds."""
    sccs = cut(graph.strong_components(dsm.elements, dsm.edges))
    placed = cut(by_levels(dsm, sccs))
    placed = _arranged(placed, dsm.edges, seed, in_task)

    def cuts() -> DataFrame:
        blocks = placed.groupBy("dsm_id", "block").agg(F.min("idx").alias("scc"))
        found = tearing.tearing(dsm.edges, sccs, suggestions).join(blocks, ["dsm_id", "scc"])
        whole = [F.col(c).cast("int").alias(c) for c in ("impact", "largest_loop_after")]
        return found.select("dsm_id", "block", "rank", "i", "j", "w", *whole, "fully_resolves")

    return placed, cuts


def _arranged(placed: DataFrame, edges: DataFrame, seed: int | None, in_task: int) -> DataFrame:
    """placed with the elements of each loop in an order of less feedback.

    A loop of at most in_task dependencies is annealed in one task. A larger one is annealed in pieces of its order, all at once, then in pieces with their borders where the middles were:
    what is swapped inside a piece leaves the order to all others as it is, so no piece adds feedback. A piece has at most in_task dependencies, whatever its elements depend on."""
    size = math.isqrt(in_task)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        places, at = np.unique(frame[["x", "y"]].to_numpy().ravel(), return_inverse=True)
        x, y = at.reshape(-1, 2).T
        at_block, piece = int(frame["block"].iloc[0]), int(frame["piece"].iloc[0])
        order = anneal_links(len(places), x, y, frame["w"].to_numpy(), seed=None if seed is None else seed + at_block + piece)
        return pd.DataFrame({"dsm_id": frame["dsm_id"].iloc[0], "pos": places[order], "to": places})

    starts = placed.filter("size > 2").groupBy("dsm_id", "block").agg(F.min("pos").alias("start"))
    pieced = None
    for shift in (0, size // 2):
        at = placed.join(starts, ["dsm_id", "block"]).select("dsm_id", "block", "idx", "pos", (F.col("pos") - F.col("start") + shift).alias("place"))
        a = at.select("dsm_id", "block", F.col("idx").alias("i"), F.col("pos").alias("x"), F.col("place").alias("px"))
        b = at.select("dsm_id", "block", F.col("idx").alias("j"), F.col("pos").alias("y"), F.col("place").alias("py"))
        inner = edges.filter("i <> j").groupBy("dsm_id", "i", "j").agg(F.sum("w").alias("w"))
        inner = cut(inner.join(a, ["dsm_id", "i"]).join(b, ["dsm_id", "block", "j"]).select("dsm_id", "block", "x", "y", "px", "py", "w"))
        if pieced is None:
            pieced = cut(inner.groupBy("dsm_id", "block").agg(F.count("*").alias("m")).filter(F.col("m") > in_task).select("dsm_id", "block"))
        parts = inner.join(pieced, ["dsm_id", "block"], "left_semi").withColumn("piece", F.floor(F.col("px") / size).cast("int"))
        parts = parts.filter(F.col("piece") == F.floor(F.col("py") / size))
        if not shift:
            parts = parts.unionByName(inner.join(pieced, ["dsm_id", "block"], "left_anti").withColumn("piece", F.lit(0)))
        moved = parts.groupBy("dsm_id", "block", "piece").applyInPandas(run, "dsm_id string, pos int, to int")
        placed = cut(placed.join(moved, ["dsm_id", "pos"], "left").withColumn("pos", F.coalesce("to", "pos")).drop("to").select(placed.columns))
        if pieced.isEmpty():
            break
    return placed


def process_metrics(dsm: Dsm, placed: DataFrame) -> DataFrame:
    """placed: dsm_id, pos, idx, block, level, size (of the block)."""
    each = placed.groupBy("dsm_id", "block").agg(F.max("size").alias("size"), F.max("level").alias("level"))
    loop = F.when(F.col("size") > 1, F.col("size"))
    shape = each.groupBy("dsm_id").agg(
        F.sum("size").alias("n_elements"),
        F.count("*").alias("n_blocks"),
        F.count(loop).alias("n_loops"),
        F.coalesce(F.max(loop), F.lit(1)).alias("largest_loop"),
        F.coalesce(F.sum(loop), F.lit(0)).alias("coupled_elements"),
        (F.max("level") + 1).alias("n_levels"),
    )
    start = dsm.elements.select("dsm_id", "idx", F.col("idx").alias("pos"))
    before = scoring.feedback(dsm.edges, start).select("dsm_id", F.col("feedback_marks").alias("feedback_before"))
    after = scoring.feedback(dsm.edges, placed).select("dsm_id", F.col("feedback_marks").alias("feedback_after"))
    out = shape.join(before, "dsm_id").join(after, "dsm_id").join(scoring.symmetry_ratio(dsm.edges), "dsm_id", "left")
    return scoring.guidance(
        out.withColumn("symmetry_ratio", F.coalesce("symmetry_ratio", F.lit(0.0)))
        .withColumn("sequential_elements", F.col("n_elements") - F.col("coupled_elements"))
        .withColumn("marks_resolved", F.col("feedback_before") - F.col("feedback_after"))
    )


def by_levels(dsm: Dsm, sccs: DataFrame | None = None) -> DataFrame:
    """(dsm_id, pos, idx, block, level, size): the order by level, loop and index, for matrices of any size, in tables alone. Elements of a loop aren't arranged among themselves."""
    sccs = sccs if sccs is not None else cut(graph.strong_components(dsm.elements, dsm.edges))
    blocks = (
        sccs.groupBy("dsm_id", "scc")
        .agg(F.count("*").cast("int").alias("size"))
        .join(graph.levels(dsm.edges, sccs), ["dsm_id", "scc"])
    )
    blocks = numbered(blocks, ["level", "scc"], "block")
    return numbered(sccs.join(blocks, ["dsm_id", "scc"]), ["block", "idx"], "pos").select("dsm_id", "pos", "idx", "block", "level", "size")


def banded(placed: DataFrame) -> DataFrame:
    """Elements by level, for drawing: (dsm_id, level, elements)."""
    return placed.groupBy("dsm_id", "level").agg(F.count("*").alias("elements"))
