"""Tearing: what is left of a loop when one of its dependencies is taken out, for every dependency.

Only a dependency that is the only way from one part of a loop to another breaks it. A loop of at most `in_task` dependencies is one row of work, done in time in proportion to these
(kernels.bridges). A larger one never comes together in one place: from the loop's smallest element each element gets a way, in a search by levels; the dependencies of that way
that all other ways use too are found by striking out the rest, round by round, a count over an element's dependencies each time. Elements behind the same dependency, and, all turned
round, those before it, are what it cuts off; the components inside these sets are those of all sets at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from depmatrix.operators.graph import cut, loops, strong_components

#: Dependencies of a loop that go to one task; those of larger loops stay in tables.
IN_TASK = 1 << 18
_LOOP = ["dsm_id", "scc"]
_LEFT = "dsm_id string, scc int, i int, j int, w double, n long, largest_loop_after long"


def inside_loops(edges: DataFrame, sccs: DataFrame) -> DataFrame:
    """(dsm_id, scc, i, j, w): dependencies whose ends are in the same loop."""
    a = sccs.select("dsm_id", F.col("idx").alias("i"), "scc")
    b = sccs.select("dsm_id", F.col("idx").alias("j"), F.col("scc").alias("s2"))
    inner = edges.filter("w > 0 and i <> j").join(a, ["dsm_id", "i"]).join(b, ["dsm_id", "j"]).filter("scc = s2")
    return inner.groupBy(*_LOOP, "i", "j").agg(F.sum("w").alias("w"))


def _in_task(inner: DataFrame) -> DataFrame:
    """inner: with n, the loop's elements."""

    def run(frame):
        import numpy as np

        from depmatrix.kernels.bridges import largest_after

        names, at = np.unique(frame[["i", "j"]].to_numpy().ravel(), return_inverse=True)
        x, y = at.reshape(-1, 2).T
        return frame.assign(largest_loop_after=largest_after(len(names), x, y))

    return inner.groupBy(*_LOOP).applyInPandas(run, _LEFT)


def _ways(inner: DataFrame, turned: bool) -> DataFrame:
    """(dsm_id, scc, x, by, at): the tree dependencies (by is the end that they lead to, at the one that they come from) which all ways from the loop's smallest element to x use.

    turned: ways to that element instead, along dependencies from their end to their start."""
    a, b = ("j", "i") if turned else ("i", "j")
    links = cut(inner.select(*_LOOP, F.col(a).alias("a"), F.col(b).alias("b")))
    front = cut(links.select(*_LOOP).distinct().select(*_LOOP, F.col("scc").alias("x"), F.array().cast("array<int>").alias("way"), F.lit(-1).alias("at")))
    tree = front
    while True:
        near = links.join(front.select(*_LOOP, F.col("x").alias("a"), "way"), [*_LOOP, "a"])
        first = near.groupBy(*_LOOP, F.col("b").alias("x")).agg(F.min_by(F.struct("a", "way"), "a").alias("f"))
        front = cut(
            first.join(tree.select(*_LOOP, "x"), [*_LOOP, "x"], "left_anti").select(
                *_LOOP, "x", F.concat("f.way", F.array("x")).alias("way"), F.col("f.a").alias("at")
            )
        )
        if front.isEmpty():
            break
        tree = cut(tree.unionByName(front))
    parent = cut(tree.select(*_LOOP, "x", "at"))
    degree = links.groupBy(*_LOOP, F.col("b").alias("x")).agg(F.count("*").alias("degree"))
    used = cut(_shared(links, tree).select(*_LOOP, "x", F.explode("way").alias("by")))
    size = used.count()
    while True:
        # by stays with x if all dependencies into x come from where by is used too, or are by itself
        through = links.join(used.select(*_LOOP, F.col("x").alias("a"), "by"), [*_LOOP, "a"]).select(*_LOOP, F.col("b").alias("x"), "by")
        itself = parent.filter("at >= 0").select(*_LOOP, "x", F.col("x").alias("by"))
        through = through.unionByName(itself)
        whole = through.groupBy(*_LOOP, "x", "by").agg(F.count("*").alias("c")).join(degree, [*_LOOP, "x"]).filter("c = degree")
        used = cut(used.join(whole, [*_LOOP, "x", "by"], "left_semi"))
        left = used.count()
        if left == size:
            break
        size = left
    return used.join(parent.select(*_LOOP, F.col("x").alias("by"), "at"), [*_LOOP, "by"]).select(*_LOOP, "x", "by", "at")


def _shared(links: DataFrame, tree: DataFrame) -> DataFrame:
    """(dsm_id, scc, x, way) of tree: of each way what the ways to two of the elements that lead to x have too, the first and the last one, before all of them are counted: a row for
    each element, not one for each dependency and each element of a way."""
    out = tree.select(*_LOOP, "x", "way", "at").join(links.groupBy(*_LOOP, F.col("b").alias("x")).agg(F.min("a").alias("first"), F.max("a").alias("last")), [*_LOOP, "x"])
    for end in ("first", "last"):
        other = tree.select(*_LOOP, F.col("x").alias(end), F.col("way").alias("other"))
        out = out.join(other, [*_LOOP, end]).withColumn("way", F.when(F.col(end) == F.col("at"), F.col("way")).otherwise(F.array_intersect("way", "other"))).drop("other")
    return out


def _in_tables(inner: DataFrame) -> DataFrame:
    """inner: with n. As _in_task(), in tables alone; as many rows as elements times the dependencies that all ways to them share."""
    inner = cut(inner)
    links = inner.select(*_LOOP, F.col("i").alias("x"), F.col("j").alias("y"))
    parts = []
    for turned in (False, True):
        ways = _ways(inner, turned)
        start, end = ("by", "at") if turned else ("at", "by")
        parts.append(ways.select(*_LOOP, F.col(start).alias("ti"), F.col(end).alias("tj"), F.lit(turned).alias("turned"), "x"))
    sets = cut(parts[0].unionByName(parts[1]))
    torn = [*_LOOP, "ti", "tj"]
    key = [*torn, "turned"]
    lost = sets.groupBy(*torn).agg(F.count_distinct("x").alias("lost"))
    kept = links.join(sets, [*_LOOP, "x"]).join(sets.withColumnRenamed("x", "y"), [*key, "y"])
    within = strong_components(
        sets.withColumnRenamed("x", "idx").withColumnRenamed("scc", "lp"),
        kept.select(*key, F.col("x").alias("i"), F.col("y").alias("j"), F.lit(1.0).alias("w")).withColumnRenamed("scc", "lp"),
        ("dsm_id", "lp", "ti", "tj", "turned"),
    )
    sizes = within.groupBy("dsm_id", "lp", "ti", "tj", "turned", "scc").agg(F.count("*").alias("inside")).drop("scc").withColumnRenamed("lp", "scc")
    largest = sizes.groupBy(*torn).agg(F.max("inside").alias("inside"))
    effect = lost.join(largest, torn).withColumnRenamed("ti", "i").withColumnRenamed("tj", "j")
    after = F.greatest(F.col("n") - F.coalesce("lost", F.lit(0)), F.coalesce("inside", F.lit(0)))
    return inner.join(effect, [*_LOOP, "i", "j"], "left").select(*_LOOP, "i", "j", "w", "n", after.alias("largest_loop_after"))


def all_tears(edges: DataFrame, sccs: DataFrame, in_task: int = IN_TASK) -> DataFrame:
    """(dsm_id, scc, i, j, w, n, largest_loop_after): each dependency inside a loop of n elements, and the largest loop (1: none) that is left of it without that one."""
    sccs = cut(sccs.select("dsm_id", "idx", "scc"))
    size = loops(sccs).withColumnRenamed("size", "n")
    inner = cut(inside_loops(edges, sccs))
    counts = inner.groupBy(*_LOOP).agg(F.count("*").alias("m"))
    inner = cut(inner.join(size, _LOOP).join(counts, _LOOP))
    small, large = inner.filter(F.col("m") <= in_task).drop("m"), inner.filter(F.col("m") > in_task).drop("m")
    found = _in_task(small)
    return found if large.isEmpty() else found.unionByName(_in_tables(large))


def tearing(edges: DataFrame, sccs: DataFrame, top: int = 5, in_task: int = IN_TASK) -> DataFrame:
    """(dsm_id, scc, rank, i, j, w, impact, largest_loop_after, fully_resolves): the `top` dependencies of each loop whose removal shrinks it most, then the lighter ones."""
    found = all_tears(edges, sccs, in_task).withColumn("impact", F.col("n") - F.col("largest_loop_after"))
    order = W.partitionBy(*_LOOP).orderBy(F.desc("impact"), "w", "i", "j")
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return best.select(*_LOOP, "i", "j", "w", "impact", "largest_loop_after", (F.col("largest_loop_after") == 1).alias("fully_resolves"), "rank")
