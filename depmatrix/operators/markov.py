"""Markov clustering to convergence on edge tables, for many matrices and inflations at once.

The state has one row a column of the matrix: its entries, at most `top` of them, as an array. A round sends each column to the columns that hold an entry in its row, adds up, raises to
the inflation, normalises and keeps the largest entries. A column's products are at most top squared, so they meet in one task, in one shuffle after the join. Matrices that no longer
move leave the loop; only the others go round again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from depmatrix.kernels.mcl import INFLATIONS
from depmatrix.operators import scoring
from depmatrix.operators.graph import cut, drop
from depmatrix.params import Constraints
from depmatrix.schema import Dsm

_KEY = ["dsm_id", "inflation"]
_COLUMN = [*_KEY, "j"]
#: Entries of a column that are sorted in one row.
AT_ONCE = 4096
ENTRIES = "array<struct<i:int,w:double>>"


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), the value worked out once, wherever it stands: what a lambda names outside of it is worked out again for each entry."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _with_total(entries: Column, each: Callable[[Column, Column], Column]) -> Column:
    """each(entry, sum of the weights) for all entries."""
    return F.aggregate(entries, F.lit(0.0), lambda a, e: a + e["w"], lambda total: F.transform(entries, lambda e: each(e, total)))


def _largest(entries: Column, top: int | None) -> Column:
    """The top largest of an array of (i, w), ties to the smaller i; weights that differ by less than 1e-12 of their sum are ties, so that the order of additions decides nothing."""
    if top is None:
        return entries
    key = lambda e, total: F.struct((-F.round(e["w"] / total, 12)).alias("o"), e["i"].alias("i"), e["w"].alias("w"))
    order = _once(entries, lambda es: _with_total(es, key))
    return F.transform(F.slice(F.sort_array(order), 1, top), lambda e: F.struct(e["i"], e["w"])).cast(ENTRIES)


def _normalised(entries: Column) -> Column:
    return _once(entries, lambda es: _with_total(es, lambda e, total: F.struct(e["i"], e["w"] / total))).cast(ENTRIES)


def _thinned(cells: DataFrame, top: int | None, at_once: int) -> DataFrame:
    """cells without what can't be among its column's top entries, until no column has more than at_once of them: columns are divided by hash, each part keeps its own top."""
    while top is not None:
        sizes = cells.groupBy("dsm_id", "j").agg(F.count("*").alias("n")).filter(F.col("n") > at_once)
        sizes = cut(sizes.select("dsm_id", "j", F.ceil(F.col("n") / at_once).alias("parts")))
        if sizes.isEmpty():
            break
        part = F.pmod(F.xxhash64("i"), F.col("parts")).alias("part")
        parts = cells.join(sizes, ["dsm_id", "j"]).select("dsm_id", "j", part, F.struct("i", "w").alias("e"))
        kept = parts.groupBy("dsm_id", "j", "part").agg(F.collect_list("e").alias("es"))
        # the shares within a part don't matter here, only the order of its weights
        order = F.transform("es", lambda e: F.struct((-e["w"]).alias("o"), e["i"].alias("i"), e["w"].alias("w")))
        kept = kept.select("dsm_id", "j", F.explode(F.slice(F.sort_array(order), 1, top)).alias("e")).select("dsm_id", "e.i", "j", "e.w")
        cells = cut(cells.join(sizes, ["dsm_id", "j"], "left_anti").unionByName(kept))
    return cells


def _cells(state: DataFrame) -> DataFrame:
    return state.select(*_COLUMN, F.inline("entries"))


def _start(dsm: Dsm, inflations: tuple[float, ...], top: int | None, at_once: int) -> DataFrame:
    own = dsm.elements.select("dsm_id", F.col("idx").alias("i"), F.col("idx").alias("j"), F.lit(1.0).alias("w"))
    cells = dsm.edges.filter("w > 0 and i <> j").select("dsm_id", "i", "j", "w").unionByName(own)
    cells = _thinned(cut(cells), top, at_once)
    columns = cells.groupBy("dsm_id", "j").agg(F.sort_array(F.collect_list(F.struct("i", "w"))).alias("entries"))
    every = F.explode(F.array(*(F.lit(float(x)) for x in inflations))).alias("inflation")
    return columns.select("dsm_id", every, "j", _normalised(_largest(F.col("entries"), top)).alias("entries"))


def _round(state: DataFrame, top: int | None) -> DataFrame:
    """state after one expansion by its square, inflation and pruning."""
    rows = _cells(state).select(*_KEY, F.col("i").alias("k"), "j", F.col("w").alias("b"))
    columns = state.select(*_KEY, F.col("j").alias("k"), "entries")
    products = rows.join(columns, [*_KEY, "k"]).select(*_COLUMN, "b", F.inline("entries")).select(*_COLUMN, "i", (F.col("w") * F.col("b")).alias("w"))
    # by column: both aggregates below work on whole columns where they stand
    square = products.repartition(*_COLUMN).groupBy(*_COLUMN, "i").agg(F.sum("w").alias("w"))
    raised = square.select(*_COLUMN, "i", F.pow("w", "inflation").alias("w")).filter("w > 0")
    packed = raised.groupBy(*_COLUMN).agg(F.sort_array(F.collect_list(F.struct("i", "w"))).alias("entries"))
    return packed.select(*_COLUMN, _normalised(_largest(F.col("entries"), top)).alias("entries"))


def _moved(new: DataFrame, old: DataFrame) -> DataFrame:
    """(key, moved): the largest change of an entry."""
    both = _cells(new).unionByName(_cells(old).withColumn("w", -F.col("w")))
    return both.groupBy(*_COLUMN, "i").agg(F.abs(F.sum("w")).alias("d")).groupBy(*_KEY).agg(F.max("d").alias("moved"))


def markov(
    dsm: Dsm, inflations: tuple[float, ...] = (2.0,), top: int | None = 64, rounds: int = 100, tolerance: float = 1e-6, at_once: int = AT_ONCE
) -> DataFrame:
    """(dsm_id, inflation, j, entries): each matrix once no entry changes by tolerance or more, or after that many rounds.

    Self-loops weigh 1 whatever the scale of the weights; directed. top: entries kept in a column, None for all, which may fill up to n squared. An element without edges is its own
    column. An empty batch: no rows. Repeated cells count as one of their sum."""
    edges = dsm.edges.groupBy("dsm_id", "i", "j").agg(F.sum("w").alias("w"))
    state = cut(_start(Dsm(dsm.elements, edges), inflations, top, at_once))
    ended: list[DataFrame] = []
    for _ in range(rounds):
        new = cut(_round(state, top))
        if tolerance <= 0:  # nothing ever counts as settled
            drop(state)
            state = new
            continue
        moved = cut(_moved(new, state))
        still, every = moved.agg(F.count_if(F.col("moved") >= tolerance), F.count("*")).first()
        drop(state)
        if still == every:
            state = new
            continue
        ended.append(cut(new.join(moved.filter(F.col("moved") < tolerance).select(*_KEY), _KEY, "left_semi")))
        state = cut(new.join(moved.filter(F.col("moved") >= tolerance).select(*_KEY), _KEY, "left_semi"))
        drop(new)
        if not still:
            break
    out = state
    for part in ended:
        out = out.unionByName(part)
    return out


def attracted(state: DataFrame) -> DataFrame:
    """(dsm_id, inflation, idx, cluster): each element goes to the first attractor (an element with an entry of its own in its column) that has an entry in its column, one that
    none has to the first of the matrix; cluster is the attractor's number. Without attractors the largest entries of the columns stand for them."""
    cells = cut(_cells(state).filter("w > 0"))
    own = cells.filter("i = j").select(*_KEY, "i").distinct()
    without = state.select(*_KEY).distinct().join(own.select(*_KEY).distinct(), _KEY, "left_anti")
    peaks = cells.join(without, _KEY, "left_semi").groupBy(*_COLUMN).agg(F.max_by("i", F.struct("w", -F.col("i"))).alias("i"))
    pulls = cut(own.unionByName(peaks.select(*_KEY, "i").distinct()))
    held = cells.join(pulls, [*_KEY, "i"], "left_semi").groupBy(*_COLUMN).agg(F.min("i").alias("cluster"))
    first = pulls.groupBy(*_KEY).agg(F.min("i").alias("first"))
    out = state.select(*_COLUMN).join(held, _COLUMN, "left").join(first, _KEY)
    return out.select(*_KEY, F.col("j").alias("idx"), F.coalesce("cluster", "first").alias("cluster"))


def markov_sweep(core: Dsm, limits: Constraints = Constraints(), inflations: tuple[float, ...] = INFLATIONS, top: int | None = 64) -> tuple[DataFrame, DataFrame]:
    """((dsm_id, inflation, idx, cluster), (dsm_id, inflation, n_clusters, cost, external_ratio, k_in_range)) of each matrix's best inflation: one with a number of clusters within the
    limits first, then the cheapest, then the lowest. A matrix that every inflation leaves in one cluster has no row."""
    found = cut(attracted(markov(core, inflations, top)))
    several = found.groupBy(*_KEY).agg(F.count_distinct("cluster").alias("k")).filter("k > 1").select(*_KEY)
    found = cut(found.join(several, _KEY, "left_semi"))
    sizes = core.sizes()
    scored = scoring.k_in_range(scoring.scores(core.edges, found, sizes, tuple(_KEY)), sizes, limits.min_clusters, limits.max_clusters)
    order = W.partitionBy("dsm_id").orderBy(F.desc("k_in_range"), "cost", "inflation")  # as many rows as inflations
    best = cut(scored.withColumn("r", F.row_number().over(order)).filter("r = 1").drop("r"))
    return found.join(best.select(*_KEY), _KEY, "left_semi"), best
