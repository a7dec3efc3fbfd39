"""Loops to a fix-point over edges: components, strong components, levels, change propagation.

Each round is a join and an aggregate over edges, never over pairs of elements (closure() apart); the state is written every
round to the shared folder, never kept on one executor.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from depmatrix.kernels.sequence import components_of
from depmatrix.schema import Dsm

#: Edges of a graph, or of a block of one, that go to one task.
IN_TASK = 1 << 18
_own_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset, the warehouse if it isn't a local path, or in local mode (tests) a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    master = spark.sparkContext.master
    if master == "local" or master.startswith("local["):
        if not _own_folder:
            _own_folder.append(tempfile.mkdtemp(prefix="depmatrix-"))
        return _own_folder[0]
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    if warehouse.startswith(("file:", "/")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return warehouse


def _delete(spark: SparkSession, path: str) -> None:
    try:
        to = spark._jvm.org.apache.hadoop.fs.Path(path)
        to.getFileSystem(spark._jsc.hadoopConfiguration()).delete(to, True)
    except Exception:  # the session is gone; the cluster's folder has its own clean-up
        pass


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut, as a Parquet table in the shared folder, removed at exit. A checkpoint would keep the plan's estimate of its size, which a loop with joins multiplies
    each round until working it out takes longer than the round."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/depmatrix-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_delete, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._table = path
    return out


def drop(state: DataFrame) -> None:
    """Removes the table of an earlier state, a result of cut() that nothing reads any more."""
    path = vars(state).pop("_table", None)
    if path:
        _delete(state.sparkSession, path)


def components(dsm: Dsm) -> DataFrame:
    """(dsm_id, idx, component): undirected; component is the smallest member."""
    e = dsm.edges.filter("w > 0 and i <> j")
    links = cut(e.select("dsm_id", "i", "j").union(e.select("dsm_id", "j", "i")).distinct())
    now = cut(dsm.elements.select("dsm_id", "idx", F.col("idx").alias("c")))
    while True:
        # the neighbours' smallest label, then that label's own label: halves the distance to the root
        near = (
            links.join(now.select("dsm_id", F.col("idx").alias("j"), "c"), ["dsm_id", "j"])
            .groupBy("dsm_id", F.col("i").alias("idx"))
            .agg(F.min("c").alias("m"))
        )
        new = now.join(near, ["dsm_id", "idx"], "left").select(
            "dsm_id", "idx", F.col("c").alias("old"), F.least("c", F.coalesce("m", "c")).alias("c")
        )
        jump = new.select("dsm_id", F.col("idx").alias("c"), F.col("c").alias("cc"))
        new = cut(new.join(jump, ["dsm_id", "c"]).select("dsm_id", "idx", "old", F.least("c", "cc").alias("c")))
        if new.filter("c <> old").isEmpty():
            break
        now = new.drop("old")
    return now.select("dsm_id", "idx", F.col("c").alias("component"))


def component_sizes(found: DataFrame) -> DataFrame:
    """Largest first, ties by smallest member: (dsm_id, rank, component, size)."""
    sizes = found.groupBy("dsm_id", "component").agg(F.count("*").alias("size"))
    return sizes.withColumn(
        "rank", F.row_number().over(W.partitionBy("dsm_id").orderBy(F.desc("size"), "component")) - 1
    ).select("dsm_id", "rank", "component", "size")


def closure(edges: DataFrame, key: tuple[str, ...] = ("dsm_id",), max_rounds: int = 64) -> DataFrame:
    """Reachable pairs (key, i, j) over at least one edge, paths doubling each round. Its rows may reach n squared: for small matrices and tests."""
    now = cut(edges.filter("w > 0 and i <> j").select(*key, "i", "j").distinct())
    n = now.count()
    for _ in range(max_rounds):
        longer = now.withColumnRenamed("j", "k").join(now.withColumnRenamed("i", "k"), [*key, "k"]).select(*key, "i", "j")
        now = cut(now.union(longer).distinct())
        if (m := now.count()) == n:
            break
        n = m
    return now


def _trimmed(edges: DataFrame, key: list[str], stop: float = 0.02) -> DataFrame:
    """Edges without those whose source nothing leads to or whose target leads nowhere: no loop runs over them. Layers are taken off while they take a share of `stop`."""
    n = edges.count()
    while n:
        ends = edges.select(*key, F.col("j").alias("i")).distinct()
        begins = edges.select(*key, F.col("i").alias("j")).distinct()
        edges = cut(edges.join(ends, [*key, "i"], "left_semi").join(begins, [*key, "j"], "left_semi"))
        left = edges.count()
        if n - left <= stop * n:
            break
        n = left
    return edges


def _coloured(edges: DataFrame, key: list[str]) -> DataFrame:
    """(key, idx, c): the smallest element from which idx can be reached, itself included."""
    now = cut(edges.select(*key, F.explode(F.array("i", "j")).alias("idx")).distinct().withColumn("c", F.col("idx")))
    while True:
        reached = (
            edges.join(now.select(*key, F.col("idx").alias("i"), "c"), [*key, "i"])
            .groupBy(*key, F.col("j").alias("idx"))
            .agg(F.min("c").alias("m"))
        )
        new = cut(
            now.join(reached, [*key, "idx"], "left").select(
                *key, "idx", F.col("c").alias("old"), F.least("c", F.coalesce("m", "c")).alias("c")
            )
        )
        now = new.drop("old")
        if new.filter("c <> old").isEmpty():
            return now


def _colours(left: DataFrame, key: list[str]) -> DataFrame | None:
    """(key, idx, scc) of what lies in loops, or None: forward colours, then backward from each colour's root (Orzan, 2004); what reaches its root within its colour is a component, the
    rest goes round again. Rounds grow with the length of the shortest ways inside the loops, so this is for what contraction leaves."""
    found = None
    while True:
        left = _trimmed(left, key)
        if left.isEmpty():
            return found
        colour = _coloured(left, key)
        a = colour.select(*key, F.col("idx").alias("i"), F.col("c"))
        b = colour.select(*key, F.col("idx").alias("j"), F.col("c").alias("cj"))
        inner = cut(left.join(a, [*key, "i"]).join(b, [*key, "j"]).filter("c = cj").select(*key, "i", "j", "c"))
        reached = front = cut(colour.filter("idx = c"))
        while True:
            back = inner.join(
                front.select(*key, F.col("idx").alias("j"), "c"), [*key, "j", "c"], "left_semi"
            ).select(*key, F.col("i").alias("idx"), "c").distinct()
            front = cut(back.join(reached, [*key, "idx"], "left_anti"))
            if front.isEmpty():
                break
            reached = cut(reached.unionByName(front))
        own = reached.select(*key, "idx", F.col("c").alias("scc"))
        found = own if found is None else found.unionByName(own)
        settled = reached.select(*key, "idx")
        for end in ("i", "j"):
            inner = inner.join(settled.withColumnRenamed("idx", end), [*key, end], "left_anti")
        left = cut(inner.select(*key, "i", "j"))


def _schema(df: DataFrame, key: list[str], rest: str) -> str:
    kinds = dict(df.dtypes)
    return ", ".join([*(f"{k} {kinds[k]}" for k in key), rest])


def _in_tasks(edges: DataFrame, by: list[str]) -> DataFrame:
    """(by, idx, scc) of each group of edges, one task a group: for groups of a bounded number of edges."""

    def run(frame):
        import numpy as np
        import pandas as pd

        names, at = np.unique(frame[["i", "j"]].to_numpy().ravel(), return_inverse=True)
        after: list[list[int]] = [[] for _ in names]
        for x, y in at.reshape(-1, 2).tolist():
            after[x].append(y)
        scc = np.empty(len(names), np.int64)
        for group in components_of(after):
            scc[group] = names[group[0]]
        return pd.DataFrame({**{k: frame[k].iloc[0] for k in by}, "idx": names, "scc": scc})

    return edges.groupBy(*by).applyInPandas(run, _schema(edges, by, "idx int, scc int"))


def _blocked(left: DataFrame, key: list[str], in_task: int, ends: tuple[str, str] = ("i", "j")) -> DataFrame:
    """left with block: ranges of elements, some in_task / 2 edges each on average; null where the ends lie in different ones, or where a block has more than in_task edges inside."""
    a, b = ends
    spans = left.groupBy(*key).agg(
        F.least(F.min(a), F.min(b)).alias("_low"), F.greatest(F.max(a), F.max(b)).alias("_high"), F.ceil(F.count("*") * 2 / F.lit(in_task)).alias("_blocks")
    )
    placed = left.join(spans, key)
    place = lambda c: F.floor((F.col(c) - F.col("_low")).cast("double") * F.col("_blocks") / (F.col("_high") - F.col("_low") + 1))
    placed = placed.withColumn("block", F.when(place(a) == place(b), place(a))).drop("_low", "_high", "_blocks")
    full = placed.filter("block is not null").groupBy(*key, "block").agg(F.count("*").alias("_m")).filter(F.col("_m") > in_task)
    placed = placed.join(full, [*key, "block"], "left")
    return placed.withColumn("block", F.when(F.col("_m").isNull(), F.col("block"))).drop("_m")


def _renamed(left: DataFrame, key: list[str], names: DataFrame) -> DataFrame:
    """left between other elements: names has (key, idx, to)."""
    for end in ("i", "j"):
        left = left.join(names.select(*key, F.col("idx").alias(end), F.col("to").alias("_to")), [*key, end], "left")
        left = left.withColumn(end, F.coalesce("_to", end)).drop("_to")
    return cut(left.filter("i <> j").select(*key, "i", "j").distinct())


def _hung(left: DataFrame, key: list[str], in_task: int) -> DataFrame:
    """(key, block, idx, on, to): elements that only one other of their block leads to (on), and the first of the row of such ones that they hang on (to)."""
    only = left.groupBy(*key, "j").agg(F.count("*").alias("d"), F.min("i").alias("i")).filter("d = 1").drop("d")
    near = _blocked(only, key, in_task).filter("block is not null")

    def run(frame):
        import pandas as pd

        on = dict(zip(frame["j"].tolist(), frame["i"].tolist(), strict=True))
        to: dict[int, int] = {}
        for v in list(on):
            way = []
            while v in on and v not in to and v not in way[-1:]:
                way.append(v)
                to[v] = -1
                v = on[v]
                if to.get(v) == -1:  # a ring: it is opened at v
                    del to[v], on[v]
                    way.remove(v)
                    break
            first = to.get(v, v)
            for x in way:
                to[x] = first
        rows = [(v, on[v], to[v]) for v in on]
        out = pd.DataFrame(rows, columns=["idx", "on", "to"])
        for k in (*key, "block"):
            out[k] = frame[k].iloc[0]
        return out[[*key, "block", "idx", "on", "to"]]

    kind = dict(near.dtypes)["block"]
    return cut(near.groupBy(*key, "block").applyInPandas(run, _schema(near, key, f"block {kind}, idx int, on int, to int")))


def _unhung(hung: DataFrame, before: DataFrame, key: list[str], found: DataFrame) -> DataFrame:
    """(key, idx, to, scc) of what hung: with the component of what it hung on if it, or what hangs on it, leads back to that; a component by itself (no row) if not."""
    of = found.select(*key, "idx", "scc")
    exits = before.join(hung.select(*key, F.col("idx").alias("j")), [*key, "j"], "left_anti")
    exits = exits.join(hung.select(*key, F.col("idx").alias("i"), "to"), [*key, "i"])
    back = exits.join(of.select(*key, F.col("idx").alias("to"), F.col("scc").alias("a")), [*key, "to"], "left").join(
        of.select(*key, F.col("idx").alias("j"), F.col("scc").alias("b")), [*key, "j"], "left"
    )
    back = back.filter(F.coalesce("a", "to") == F.coalesce("b", "j")).select(*key, F.col("i").alias("idx")).distinct()
    marked = hung.join(back.withColumn("back", F.lit(True)), [*key, "idx"], "left")

    def run(frame):
        on = dict(zip(frame["idx"].tolist(), frame["on"].tolist(), strict=True))
        stay: set[int] = set()
        for v in frame.loc[frame["back"].notna(), "idx"].tolist():
            while v in on and v not in stay:
                stay.add(v)
                v = on[v]
        return frame.loc[frame["idx"].isin(stay), [*key, "idx", "to"]]

    alive = marked.groupBy(*key, "block").applyInPandas(run, _schema(marked, key, "idx int, to int"))
    alive = alive.join(of.withColumnRenamed("idx", "to"), [*key, "to"], "left")
    return alive.select(*key, "idx", "to", F.coalesce("scc", "to").alias("scc"))


def _contracted(left: DataFrame, key: list[str], in_task: int) -> DataFrame | None:
    """(key, idx, scc) of graphs too large for a task: blocks of elements contract the components inside them and the rows that hang together, and the smaller graph goes round again
    until it fits or no longer shrinks. Then the contractions are undone, last ones first."""
    steps: list[tuple[DataFrame, DataFrame | None]] = []
    while True:
        left = _trimmed(left, key)
        n = left.count()
        largest = left.groupBy(*key).agg(F.count("*").alias("m")).agg(F.max("m")).first()[0]
        if not n or largest <= in_task:
            found = _in_tasks(left, key)
            break
        inner = _blocked(left, key, in_task).filter("block is not null")
        own = cut(_in_tasks(inner, [*key, "block"]).filter("idx <> scc").select(*key, "idx", F.col("scc").alias("to")))
        left = _renamed(left, key, own)
        steps.append((own, None))
        hung = _hung(left, key, in_task)
        steps.append((hung, left))
        left = _renamed(left, key, hung)
        if left.count() > 0.8 * n:
            found = _colours(left, key)
            break
    if found is None:
        found = left.select(*key, F.col("i").alias("idx"), F.col("j").alias("scc")).limit(0)
    found = cut(found)
    for moved, before in reversed(steps):
        if before is None:  # a component's members are in the component of the one that stood for them
            of = found.withColumnRenamed("idx", "to")
            more = moved.join(of, [*key, "to"], "left").select(*key, "idx", "to", F.coalesce("scc", "to").alias("scc"))
        else:
            more = _unhung(moved, before, key, found)
        more = cut(more)
        stood = more.select(*key, F.col("to").alias("idx"), F.col("to").alias("scc")).distinct().join(found, [*key, "idx"], "left_anti")
        found = cut(found.unionByName(more.drop("to")).unionByName(stood))
    least = found.groupBy(*key, "scc").agg(F.min("idx").alias("least"))
    return found.join(least, [*key, "scc"]).select(*key, "idx", F.least("least", "scc").alias("scc"))


def strong_components(elements: DataFrame, edges: DataFrame, key: tuple[str, ...] = ("dsm_id",), in_task: int = IN_TASK) -> DataFrame:
    """(key, idx, scc): scc is the smallest element that it reaches and is reached from.

    Graphs of at most in_task edges are one row of work each, in time in proportion to their edges, all at once; larger ones are contracted in blocks of their elements."""
    key = list(key)
    left = cut(edges.filter("w > 0 and i <> j").select(*key, "i", "j").distinct())
    large = cut(left.groupBy(*key).agg(F.count("*").alias("m")).filter(F.col("m") > in_task).select(*key))
    found = _in_tasks(left.join(large, key, "left_anti"), key)
    if not large.isEmpty():
        found = found.unionByName(_contracted(cut(left.join(large, key, "left_semi")), key, in_task))
    return elements.select(*key, "idx").join(found, [*key, "idx"], "left").select(*key, "idx", F.coalesce("scc", "idx").alias("scc"))


def loops(sccs: DataFrame, key: tuple[str, ...] = ("dsm_id",)) -> DataFrame:
    """Components of two and more elements: (key, scc, size)."""
    return sccs.groupBy(*key, "scc").agg(F.count("*").alias("size")).filter("size > 1")


def _raised(nodes: DataFrame, inner: DataFrame, by: list[str]) -> DataFrame:
    """(by, a, old, level): the longest chain to each node inside its block, from the levels that it has already. nodes: by, a, level; inner: by, a, b."""

    def run(_, own, links):
        level = dict(zip(own["a"].tolist(), own["level"].tolist(), strict=True))
        after: dict[int, list[int]] = {}
        waits: dict[int, int] = {}
        for a, b in zip(links["a"].tolist(), links["b"].tolist(), strict=True):
            after.setdefault(b, []).append(a)
            waits[a] = waits.get(a, 0) + 1
        todo = [b for b in after if b not in waits]
        for b in todo:
            for a in after.get(b, ()):
                level[a] = max(level[a], level[b] + 1)
                waits[a] -= 1
                if not waits[a]:
                    todo.append(a)
        return own.assign(level=own["a"].map(level))

    out = _schema(nodes, by, "a int, level int")
    return nodes.select(*by, "a", "level").groupBy(*by).cogroup(inner.select(*by, "a", "b").groupBy(*by)).applyInPandas(run, out)


def levels(edges: DataFrame, sccs: DataFrame, in_task: int = IN_TASK) -> DataFrame:
    """(dsm_id, scc, level): longest chain of components that it depends on. Each round follows all chains inside each block of components, some in_task / 2 dependencies each, then one
    dependency between blocks; a matrix of at most in_task / 2 dependencies is one block."""
    key = ["dsm_id"]
    sccs = cut(sccs.select("dsm_id", "idx", "scc"))
    a, b = (
        sccs.select("dsm_id", F.col("idx").alias("i"), F.col("scc").alias("a")),
        sccs.select("dsm_id", F.col("idx").alias("j"), F.col("scc").alias("b")),
    )
    deps = edges.filter("w > 0").join(a, ["dsm_id", "i"]).join(b, ["dsm_id", "j"]).filter("a <> b").select("dsm_id", "a", "b").distinct()
    deps = cut(_blocked(cut(deps), key, in_task, ("a", "b")))
    inner, across = deps.filter("block is not null"), cut(deps.filter("block is null").select("dsm_id", "a", "b"))
    zero = F.lit(0).alias("level")
    inside = cut(inner.select("dsm_id", "block", F.explode(F.array("a", "b")).alias("a")).distinct().select("dsm_id", "block", "a", zero))
    others = across.select("dsm_id", F.explode(F.array("a", "b")).alias("a")).distinct()
    outside = cut(others.join(inside, ["dsm_id", "a"], "left_anti").select("dsm_id", "a", zero))
    while True:
        inside = cut(_raised(inside, inner, ["dsm_id", "block"]))
        now = inside.select("dsm_id", "a", "level").unionByName(outside)
        up = across.join(now.withColumnRenamed("a", "b"), ["dsm_id", "b"]).groupBy("dsm_id", "a").agg((F.max("level") + 1).alias("m"))
        up = cut(up.join(now, ["dsm_id", "a"]).filter("m > level").select("dsm_id", "a", "m"))
        if up.isEmpty():
            break
        higher = F.coalesce("m", "level").alias("level")
        inside = inside.join(up, ["dsm_id", "a"], "left").select("dsm_id", "block", "a", higher)
        outside = cut(outside.join(up, ["dsm_id", "a"], "left").select("dsm_id", "a", higher))
    every = sccs.select("dsm_id", F.col("scc").alias("a")).distinct().join(now, ["dsm_id", "a"], "left")
    return every.select("dsm_id", F.col("a").alias("scc"), F.coalesce("level", F.lit(0)).alias("level"))


def propagation(edges: DataFrame, depth: int = 4, attenuation: float = 0.6) -> DataFrame:
    """(dsm_id, i, j, strength): strongest path of up to depth edges, weights relative to the largest, attenuated for each edge after the first."""
    e = edges.filter("w > 0 and i <> j")
    top = e.groupBy("dsm_id").agg(F.max("w").alias("top"))
    direct = cut(e.join(top, "dsm_id").select("dsm_id", "i", "j", (F.col("w") / F.col("top")).alias("s")))
    now = direct
    for _ in range(depth - 1):
        step = (
            direct.select("dsm_id", "i", F.col("j").alias("k"), F.col("s").alias("a"))
            .join(now.select("dsm_id", F.col("i").alias("k"), "j", "s"), ["dsm_id", "k"])
            .filter("i <> j")
            .select("dsm_id", "i", "j", (F.lit(attenuation) * F.col("a") * F.col("s")).alias("s"))
        )
        now = cut(direct.union(step).groupBy("dsm_id", "i", "j").agg(F.max("s").alias("s")))
    return now.select("dsm_id", "i", "j", F.col("s").alias("strength"))


def risk_ranking(risk: DataFrame, sizes: DataFrame, axis: str, top: int = 6, least: float = 0.01) -> DataFrame:
    """axis 'j': who drives change (column means); 'i': who is prone to it (row means). (dsm_id, idx, mean_risk, rank)."""
    means = (
        risk.groupBy("dsm_id", F.col(axis).alias("idx"))
        .agg(F.sum("strength").alias("s"))
        .join(sizes, "dsm_id")
        .select("dsm_id", "idx", (F.col("s") / F.greatest(F.col("n") - 1, F.lit(1))).alias("mean_risk"))
    )
    return means.withColumn(
        "rank", F.row_number().over(W.partitionBy("dsm_id").orderBy(F.desc("mean_risk"), "idx"))
    ).filter((F.col("rank") <= top) & (F.col("mean_risk") > least))


def markov_steps(dsm: Dsm, steps: int = 2, inflation: float = 2.0, prune: float = 0.0) -> DataFrame:
    """A fixed number of Markov-clustering steps as joins: self-loops of 1, columns normalised, squared, raised, normalised.

    prune: what is below that share of its column goes after each step, and columns are normalised again; 0 keeps all, so that rows may fill up to n squared."""
    from depmatrix.operators.transforms import column_normalise

    loops_ = dsm.elements.select("dsm_id", F.col("idx").alias("i"), F.col("idx").alias("j"), F.lit(1.0).alias("w"))
    now = cut(column_normalise(dsm.edges.filter("i <> j").unionByName(loops_)))
    for _ in range(steps):
        square = (
            now.withColumnRenamed("j", "k")
            .withColumnRenamed("w", "a")
            .join(now.withColumnRenamed("i", "k").withColumnRenamed("w", "b"), ["dsm_id", "k"])
            .groupBy("dsm_id", "i", "j")
            .agg(F.sum(F.col("a") * F.col("b")).alias("w"))
        )
        raised = column_normalise(square.withColumn("w", F.pow("w", F.lit(inflation))))
        now = cut(column_normalise(cut(raised).filter(F.col("w") >= prune)) if prune else raised)
    return now
