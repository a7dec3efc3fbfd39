"""Edits of matrices as an append-only log, with undo, redo and every earlier version.

A log has (dsm_id, seq, kind, a, b, w, label): kind is set (cell a, b becomes w; 0 clears it), rename, add or remove (element a, with its label), undo or redo. Elements go by a number of their own,
which edits don't shift; the base's are their places. Undo and redo only tell which edits hold: a pass over the log in order, with the last DEPTH edits that can be undone in hand, emits
for each step the edit that it puts in force or takes out. A version is then what the last edits in force before it say of each cell and element: aggregates, whatever the log's length.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depmatrix.operators.graph import cut
from depmatrix.operators.numbering import numbered
from depmatrix.schema import Dsm

#: Fixed value: steps that can be undone.
DEPTH = 50
LOG = "dsm_id string, seq long, kind string, a int, b int, w double, label string"


def effects(log: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(dsm_id, seq, edit, holds): at step seq the edit of that number comes into force, or goes out of it. A new edit ends what could be redone; undo or redo with nothing left does nothing.

    Cells on the diagonal and names that are empty are no edits."""
    fine = ~((F.col("kind") == "set") & (F.col("a") == F.col("b"))) & ~((F.col("kind") == "rename") & (F.coalesce("label", F.lit("")) == ""))
    ordered = log.filter(fine).select("dsm_id", "seq", "kind").repartition("dsm_id").sortWithinPartitions("dsm_id", "seq")

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        at, undo, redo = object(), deque(maxlen=depth), []
        for frame in frames:
            out = []
            for name, seq, kind in frame.itertuples(index=False):
                if name != at:
                    at, undo, redo = name, deque(maxlen=depth), []
                if kind == "undo":
                    if undo:
                        redo.append(undo.pop())
                        out.append((name, seq, redo[-1], False))
                elif kind == "redo":
                    if redo:
                        undo.append(redo.pop())
                        out.append((name, seq, undo[-1], True))
                else:
                    undo.append(seq)
                    redo.clear()
                    out.append((name, seq, seq, True))
            yield pd.DataFrame(out, columns=["dsm_id", "seq", "edit", "holds"])

    return ordered.mapInPandas(run, "dsm_id string, seq long, edit long, holds boolean")


def in_force(log: DataFrame, done: DataFrame, version: int | None = None) -> DataFrame:
    """The edits of the log in force after step `version`, or after the last. done: effects(log)."""
    upto = done if version is None else done.filter(F.col("seq") <= version)
    last = upto.groupBy("dsm_id", "edit").agg(F.max_by("holds", "seq").alias("holds")).filter("holds")
    return log.join(last.select("dsm_id", F.col("edit").alias("seq")), ["dsm_id", "seq"], "left_semi")


def as_of(base: Dsm, log: DataFrame, done: DataFrame, version: int | None = None) -> tuple[Dsm, DataFrame]:
    """(the matrices after step `version`, numbered anew; the map dsm_id, uid, idx). base's elements have their places as numbers."""
    edits = cut(in_force(log, done, version))
    first = F.lit(-1).cast("long").alias("seq")
    names = base.elements.select("dsm_id", F.col("idx").alias("uid"), first, "label", F.lit(False).alias("gone"))
    said = edits.filter("kind in ('rename', 'add', 'remove')").select("dsm_id", F.col("a").alias("uid"), "seq", "label", (F.col("kind") == "remove").alias("gone"))
    there = names.unionByName(said).groupBy("dsm_id", "uid").agg(
        F.max_by("label", F.when(~F.col("gone"), F.col("seq"))).alias("label"), F.max_by("gone", "seq").alias("gone")
    )
    placed = cut(numbered(there.filter("not gone").select("dsm_id", "uid", "label"), ["uid"], "idx"))
    cells = base.edges.select("dsm_id", F.col("i").alias("a"), F.col("j").alias("b"), first, "w").unionByName(
        edits.filter("kind = 'set'").select("dsm_id", "a", "b", "seq", "w")
    )
    now = cells.groupBy("dsm_id", "a", "b").agg(F.max_by("w", "seq").alias("w")).filter("w > 0")
    i, j = (placed.select("dsm_id", F.col("uid").alias(x), F.col("idx").alias(y)) for x, y in (("a", "i"), ("b", "j")))
    edges = now.join(i, ["dsm_id", "a"]).join(j, ["dsm_id", "b"]).select("dsm_id", "i", "j", "w")
    return Dsm(placed.select("dsm_id", "idx", "label"), edges), placed.select("dsm_id", "uid", "idx")
