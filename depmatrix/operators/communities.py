"""Communities of high modularity on edge tables, for matrices of any size: moves of elements by gain, then the same over communities.

Elements propose to move to the neighbouring community that gains most, one hash class of them at a time; gains are sums over their edges. All of a class moving at once can lose what
each alone would gain, so the modularity is counted again, and where it would fall only those move that are the best of their old and of their new community: these don't touch one
another, so their gains add up. Modularity never falls. When no class gains, communities become elements, and their weights sums over the edges between them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depmatrix.operators.graph import cut
from depmatrix.operators.transforms import symmetrise
from depmatrix.schema import Dsm

_NODE = ["dsm_id", "v"]
_GROUP = ["dsm_id", "c"]


def _degrees(links: DataFrame) -> DataFrame:
    return links.groupBy("dsm_id", F.col("i").alias("v")).agg(F.sum("w").alias("k"))


def modularity(links: DataFrame, member: DataFrame, resolution: float = 1.0) -> DataFrame:
    """(dsm_id, q). links: dsm_id, i, j, w in both directions, an element's weight on itself once; member: dsm_id, v, c."""
    a = member.select("dsm_id", F.col("v").alias("i"), F.col("c").alias("ci"))
    b = member.select("dsm_id", F.col("v").alias("j"), F.col("c").alias("cj"))
    per = links.join(a, ["dsm_id", "i"]).join(b, ["dsm_id", "j"]).groupBy("dsm_id", F.col("ci").alias("c")).agg(
        F.sum(F.when(F.col("ci") == F.col("cj"), F.col("w")).otherwise(0.0)).alias("inner"), F.sum("w").alias("k")
    )
    total = links.groupBy("dsm_id").agg(F.sum("w").alias("all"))
    share = F.col("k") / F.col("all")
    return per.join(total, "dsm_id").groupBy("dsm_id").agg(F.sum(F.col("inner") / F.col("all") - resolution * share * share).alias("q"))


def best_moves(links: DataFrame, member: DataFrame, resolution: float = 1.0, least: float = 1e-12) -> DataFrame:
    """(dsm_id, v, c, to, gain): for each element the neighbouring community that raises modularity most if the element alone moves there (ties: the smaller), if one does."""
    degree = _degrees(links)
    held = member.join(degree, _NODE)
    weight = held.groupBy(*_GROUP).agg(F.sum("k").alias("kc"))
    total = links.groupBy("dsm_id").agg(F.sum("w").alias("all"))
    near = (
        links.filter("i <> j")
        .join(member.select("dsm_id", F.col("v").alias("j"), F.col("c").alias("to")), ["dsm_id", "j"])
        .groupBy("dsm_id", F.col("i").alias("v"), "to")
        .agg(F.sum("w").alias("l"))
    )
    at_home = near.select("dsm_id", "v", F.col("to").alias("c"), F.col("l").alias("home"))
    base = held.join(weight, _GROUP).join(at_home, [*_NODE, "c"], "left")
    there = weight.select("dsm_id", F.col("c").alias("to"), F.col("kc").alias("kt"))
    moves = near.join(base, _NODE).filter("to <> c").join(there, ["dsm_id", "to"]).join(total, "dsm_id")
    pull = 2 * (F.col("l") - F.coalesce("home", F.lit(0.0))) / F.col("all")
    push = 2 * resolution * F.col("k") * (F.col("kt") - F.col("kc") + F.col("k")) / (F.col("all") * F.col("all"))
    gains = moves.withColumn("gain", pull - push).filter(F.col("gain") > least)
    best = gains.groupBy(*_NODE, "c").agg(F.max_by(F.struct("to", "gain"), F.struct("gain", -F.col("to"))).alias("b"))
    return best.select(*_NODE, "c", "b.to", "b.gain")


def _moved(member: DataFrame, moves: DataFrame) -> DataFrame:
    return member.join(moves.select(*_NODE, "to"), _NODE, "left").select(*_NODE, F.coalesce("to", "c").alias("c"))


def _apart(moves: DataFrame) -> DataFrame:
    """Moves that are the best of all that touch their two communities."""
    touched = moves.select("dsm_id", F.explode(F.array("c", "to")).alias("g"), "gain", "v")
    top = touched.groupBy("dsm_id", "g").agg(F.max_by("v", F.struct("gain", -F.col("v"))).alias("v"))
    won = top.groupBy(*_NODE).agg(F.count("*").alias("n")).filter("n = 2")
    return moves.join(won, _NODE, "left_semi")


def local_moves(links: DataFrame, member: DataFrame, classes: int = 2, resolution: float = 1.0, enough: float = 1e-4) -> tuple[DataFrame, list[float]]:
    """member after moves until a round of all classes raises the modularity of no matrix by more than `enough`; and the sum of modularities over the matrices, round by round."""
    now = cut(modularity(links, member, resolution))
    sums = [now.agg(F.sum("q")).first()[0] or 0.0]
    while True:
        began = sums[-1]
        for k in range(classes):
            own = (F.xxhash64(F.lit(len(sums) // classes), "v") % classes + classes) % classes == k
            moves = cut(best_moves(links, member, resolution).filter(own))
            if moves.isEmpty():
                sums.append(sums[-1])
                continue
            tried = _moved(member, moves)
            after = cut(modularity(links, tried, resolution).withColumnRenamed("q", "tried").join(now, "dsm_id"))
            fallen = after.filter("tried < q").select("dsm_id")
            if not fallen.isEmpty():
                good = moves.join(fallen, "dsm_id", "left_anti")
                moves = good.unionByName(_apart(moves.join(fallen, "dsm_id", "left_semi")))
            member = cut(_moved(member, moves))
            now = cut(modularity(links, member, resolution))
            sums.append(now.agg(F.sum("q")).first()[0])
        if sums[-1] - began <= enough:
            return member, sums


def communities(dsm: Dsm, classes: int = 2, resolution: float = 1.0, max_levels: int = 10) -> tuple[DataFrame, list[float]]:
    """((dsm_id, idx, cluster), the sum of modularities round by round): cluster is its smallest element. Matrices of two elements or fewer, or without weight, are one cluster."""
    links = cut(symmetrise(dsm.edges.filter("w > 0 and i <> j")).select("dsm_id", "i", "j", "w"))
    place = cut(dsm.elements.select("dsm_id", F.col("idx").alias("v"), F.col("idx").alias("c")))
    sums: list[float] = []
    for _ in range(max_levels):
        nodes = cut(place.select("dsm_id", F.col("c").alias("v")).distinct().withColumn("c", F.col("v")))
        found, more = local_moves(links, nodes, classes, resolution)
        sums += more
        named = cut(found.join(found.groupBy(*_GROUP).agg(F.min("v").alias("least")), _GROUP).select("dsm_id", F.col("v").alias("c"), "least"))
        place = cut(place.join(named, _GROUP).select(*_NODE, F.col("least").alias("c")))
        if named.filter("c <> least").isEmpty():
            break
        a, b = (named.select("dsm_id", F.col("c").alias(x), F.col("least").alias(f"_{x}")) for x in ("i", "j"))
        joined = links.join(a, ["dsm_id", "i"]).join(b, ["dsm_id", "j"])
        links = cut(joined.groupBy("dsm_id", F.col("_i").alias("i"), F.col("_j").alias("j")).agg(F.sum("w").alias("w")))
    weighty = dsm.edges.filter("w > 0 and i <> j").select("dsm_id").distinct()
    sizes = dsm.sizes().join(weighty.withColumn("has", F.lit(True)), "dsm_id", "left")
    one = (F.col("n") <= 2) | F.col("has").isNull()
    lowest = dsm.elements.groupBy("dsm_id").agg(F.min("idx").alias("low"))
    out = place.join(sizes, "dsm_id").join(lowest, "dsm_id")
    return out.select("dsm_id", F.col("v").alias("idx"), F.when(one, F.col("low")).otherwise(F.col("c")).alias("cluster")), sums
