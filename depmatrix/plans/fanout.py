"""Kernels over many matrices: each matrix is packed into a row, and a grouped map runs one kernel for each matrix and task (algorithm, seed, k, ...)."""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depmatrix.operators.graph import cut
from depmatrix.schema import Dsm

#: A kernel holds n squared numbers; larger matrices are for the operators that stay in tables.
MAX_N = 5_000
#: Cells of all packed matrices together, up to which they are broadcast (16 bytes each).
MAX_CELLS = 10_000_000


def packed(dsm: Dsm, max_n: int = MAX_N) -> DataFrame:
    """(dsm_id, n, ii, jj, ww), checkpointed. Raises for matrices that a kernel can't hold."""
    sizes = dsm.sizes().select(
        "dsm_id",
        F.when(
            F.col("n") > max_n, F.raise_error(F.concat(F.lit("matrix too large for a kernel: "), "dsm_id"))
        ).otherwise(F.col("n")).cast("int").alias("n"),
    )
    # a packed matrix has at most max_n squared cells
    cells = dsm.edges.join(sizes, "dsm_id", "left_semi").groupBy("dsm_id").agg(F.collect_list(F.struct("i", "j", "w")).alias("cells"))
    field = lambda k: F.transform("cells", lambda c: c[k])
    return cut(
        sizes.join(cells, "dsm_id", "left").select("dsm_id", "n", field("i").alias("ii"), field("j").alias("jj"), field("w").alias("ww"))
    )


def dense(row) -> np.ndarray:
    a = np.zeros((int(row["n"]), int(row["n"])))
    if row["ii"] is not None and len(row["ii"]):
        a[np.asarray(row["ii"], int), np.asarray(row["jj"], int)] = row["ww"]
    np.fill_diagonal(a, 0)
    return a


def fan_out(pack: DataFrame, tasks: list[dict], kernel: Callable[[np.ndarray, dict], list[dict]], schema: str) -> DataFrame:
    """Runs kernel(matrix, task) for each matrix and task; its rows come back with dsm_id, task (JSON) and status ('ok') in front.

    schema: what the kernel returns. A kernel that fails gives one row with the error as status and nulls, so one bad matrix doesn't stop the others and is
    seen; done() leaves such rows out. Only (dsm_id, task) is shuffled: the matrices go along by broadcast while they have at most MAX_CELLS cells in all,
    beyond that by a join. Each call of the kernel has one matrix in memory."""
    listed = F.array(*(F.lit(json.dumps(t)) for t in tasks))
    spread = pack.select("dsm_id", F.explode(listed).alias("task")).repartition("dsm_id", "task")
    cells = pack.agg(F.sum(F.coalesce(F.size("ii"), F.lit(0)))).first()[0] or 0
    joined = spread.join(F.broadcast(pack) if cells <= MAX_CELLS else pack, "dsm_id")
    columns = ["dsm_id", "task", "status", *(c.split()[0] for c in schema.split(", "))]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in frame.to_dict("records"):
            head = {"dsm_id": row["dsm_id"], "task": row["task"]}
            try:
                out += [{**head, "status": "ok", **r} for r in kernel(dense(row), json.loads(row["task"]))]
            except (ValueError, np.linalg.LinAlgError) as e:
                out.append({**head, "status": f"{type(e).__name__}: {e}"})
        return pd.DataFrame(out, columns=columns).astype(object).where(lambda x: x.notna(), None)

    return joined.groupBy("dsm_id", "task").applyInPandas(run, f"dsm_id string, task string, status string, {schema}")


def done(found: DataFrame) -> DataFrame:
    """What the kernels that ended well returned, without task and status."""
    return found.filter("status = 'ok'").drop("task", "status")


def failures(found: DataFrame) -> DataFrame:
    """(dsm_id, task, status) of the kernels that failed."""
    return found.filter("status <> 'ok'").select("dsm_id", "task", "status")
