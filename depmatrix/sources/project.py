"""Project files (JSON) and tables of results."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depmatrix.schema import EDGES, ELEMENTS, Dsm
from depmatrix.sources.text import _CELLS, as_dsm

FORMAT, VERSION = "depmatrix-project", 2


def serialize(matrix: list[list[float]], labels: list[str], **state) -> str:
    """One project: matrix, labels and whatever of source_name, params, dsm_type, convention, client_state, server_state is given."""
    return json.dumps({"format": FORMAT, "version": VERSION, "matrix": matrix, "labels": labels, **state})


def parse(text: str, formats: tuple[str, ...] | None = None) -> dict:
    """The project; version 1 had matrix and settings only. ValueError for another format or without a square matrix."""
    got = json.loads(text)
    if not isinstance(got, dict) or "format" not in got or formats and got["format"] not in formats:
        raise ValueError("not a project file")
    m = got.get("matrix")
    if not m or any(len(r) != len(m) for r in m):
        raise ValueError("the project has no square matrix")
    got.setdefault("labels", [f"Element {i + 1}" for i in range(len(m))])
    got["params"] = got.get("params") or got.get("settings") or {}
    return got


def read_projects(spark: SparkSession, path: str) -> Dsm:
    files = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("dsm_id"), "value")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for dsm_id, text in zip(frame["dsm_id"], frame["value"], strict=True):
                p = parse(text)
                rows = (
                    [(dsm_id, i, None, x, None) for i, x in enumerate(p["labels"])]
                    + [(dsm_id, i, j, None, float(w)) for i, r in enumerate(p["matrix"]) for j, w in enumerate(r) if i != j and w and w > 0]
                )
                yield pd.DataFrame(rows, columns=["dsm_id", "i", "j", "label", "w"]).astype({"i": "Int32", "j": "Int32"})

    return as_dsm(files.mapInPandas(run, _CELLS))


@dataclass(frozen=True)
class Restored:
    """What a project file holds besides its matrix, as tables.

    state: dsm_id, dsm_type, convention, source_name. params: dsm_id, name, value. raw: dsm_id, algo, idx (of the core), cluster, for cluster.restored().
    result: dsm_id, pos, label, cluster, source, title, the result that was final. client: dsm_id, client_state (JSON)."""

    dsm: Dsm
    state: DataFrame
    params: DataFrame
    raw: DataFrame
    result: DataFrame
    client: DataFrame


_STATE = "dsm_id string, kind string, name string, value string, i int, cluster int"


def restore(spark: SparkSession, path: str) -> Restored:
    """The projects of a path with their parameters, convention, clusters and results, so that work goes on without clustering again."""
    files = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("dsm_id"), "value")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for dsm_id, text in zip(frame["dsm_id"], frame["value"], strict=True):
                p = parse(text)
                kept = p.get("server_state") or {}
                defaults = {"dsm_type": "component", "convention": "IR", "source_name": "project"}
                out = [(dsm_id, "state", k, str(p.get(k) or kept.get(k) or v), None, None) for k, v in defaults.items()]
                out += [
                    (dsm_id, "param", k, None if v is None else str(v), None, None)
                    for k, v in (p["params"] or kept.get("params") or {}).items()
                ]
                for algo, found in (kept.get("stage1") or {}).items():
                    if isinstance(found, dict):
                        out += [(dsm_id, "raw", algo, None, i, int(c)) for i, c in enumerate(found.get("raw_clusters") or [])]
                last = kept.get("last_result") or {}
                said = f"{last.get('source', 'final')}/{last.get('title', 'Optimized DSM')}"
                out += [
                    (dsm_id, "result", label, said, i, int(c))
                    for i, (label, c) in enumerate(zip(last.get("labels") or [], last.get("clusters") or [], strict=True))
                ]
                out.append((dsm_id, "client", None, json.dumps(p.get("client_state")), None, None))
                yield pd.DataFrame(
                    out, columns=["dsm_id", "kind", "name", "value", "i", "cluster"]
                ).astype({"i": "Int32", "cluster": "Int32"})

    found = files.mapInPandas(run, _STATE)
    of = lambda kind: found.filter(F.col("kind") == kind)
    state = of("state").groupBy("dsm_id").pivot("name", ["dsm_type", "convention", "source_name"]).agg(F.first("value"))
    source = F.split("value", "/", 2)
    result = of("result").select(
        "dsm_id", F.col("i").alias("pos"), F.col("name").alias("label"), "cluster", source[0].alias("source"), source[1].alias("title")
    )
    raw = of("raw").select("dsm_id", F.col("name").alias("algo"), F.col("i").alias("idx"), "cluster")
    return Restored(
        read_projects(spark, path),
        state,
        of("param").select("dsm_id", "name", "value"),
        raw,
        result,
        of("client").select("dsm_id", F.col("value").alias("client_state")),
    )


def save(dsm: Dsm, path: str, **results: DataFrame) -> None:
    """elements, edges and results as Parquet, a folder for each matrix, so that one can be read alone."""
    for name, df in {"elements": dsm.elements, "edges": dsm.edges, **results}.items():
        df.write.partitionBy("dsm_id").parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str) -> Dsm:
    schema = lambda s: ", ".join([*s.split(", ")[1:], s.split(", ")[0]])  # noqa: E731  the partition's column stands last
    return Dsm(spark.read.schema(schema(ELEMENTS)).parquet(f"{path}/elements"), spark.read.schema(schema(EDGES)).parquet(f"{path}/edges"))
