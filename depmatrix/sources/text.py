"""Matrix and edge-list files in CSV. A file is one value (wholetext), since rows of a matrix only have a meaning in their order; files are read in parallel."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from depmatrix.operators.numbering import numbered
from depmatrix.schema import Dsm

_CELLS = "dsm_id string, i int, j int, label string, w double"


def _number(x: str) -> float:
    try:
        return float(x.strip())
    except ValueError:
        return 0.0


def parse_matrix(text: str) -> tuple[list[str], list[tuple[int, int, float]]]:
    """(labels, cells off the diagonal that aren't 0). The first row is a header; empty rows don't count, in labels and cells alike."""
    rows = [r for r in list(csv.reader(io.StringIO(text.lstrip("﻿"))))[1:] if any(c.strip() for c in r)]
    cells = [(i, j, v) for i, r in enumerate(rows) for j, x in enumerate(r[1 : len(rows) + 1]) if i != j and (v := _number(x)) > 0]
    return [r[0] for r in rows], cells


def read_matrices(spark: SparkSession, path: str, convention: str = "IR") -> Dsm:
    """All matrix CSVs of a path; dsm_id is the file's name. IC files are transposed. Weights that aren't positive count as empty."""
    files = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("dsm_id"), "value")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for dsm_id, text in zip(frame["dsm_id"], frame["value"], strict=True):
                labels, cells = parse_matrix(text)
                rows = [(dsm_id, i, None, x, None) for i, x in enumerate(labels)] + [(dsm_id, i, j, None, w) for i, j, w in cells]
                yield pd.DataFrame(rows, columns=["dsm_id", "i", "j", "label", "w"]).astype({"i": "Int32", "j": "Int32"})

    return as_dsm(files.mapInPandas(run, _CELLS), convention)


def as_dsm(cells: DataFrame, convention: str = "IR") -> Dsm:
    a, b = ("j", "i") if convention == "IC" else ("i", "j")
    edges = cells.filter("j is not null").select("dsm_id", F.col(a).alias("i"), F.col(b).alias("j"), "w")
    return Dsm(cells.filter("j is null").select("dsm_id", F.col("i").alias("idx"), "label"), edges)


def looks_like_edge_list(lines: list[str]) -> bool:
    """At least two of the first six lines that aren't blank, all of two or three cells. A matrix of two elements looks like that too."""
    first = [x for x in lines if x.strip()][:6]
    return len(first) >= 2 and all(2 <= len(x.split(",")) <= 3 for x in first)


def edges_from_lines(lines: DataFrame, dsm_id: Column | None = None) -> Dsm:
    """From (line bigint, value) with 'from,to[,weight]'. A blank weight is 1; of repeated pairs the last counts; an edge to itself only names its element.

    Elements are numbered by first appearance. A header is a first line that starts with from or source, or whose third cell isn't a number.
    A weight that isn't a number raises an error; fewer than two elements are found by schema.validate()."""
    name = F.lit("edge_list") if dsm_id is None else dsm_id
    cells = F.transform(F.split("value", ","), lambda x: F.trim(x))
    rows = lines.filter(F.trim("value") != "").select(name.alias("dsm_id"), "line", cells.alias("c"))
    top = rows.groupBy("dsm_id").agg(F.min("line").alias("top"))
    third = F.coalesce(F.get("c", F.lit(2)), F.lit(""))
    head = (
        (F.col("line") == F.col("top"))
        & (F.lower(F.get("c", F.lit(0))).isin("from", "source") | ((F.size("c") > 2) & (third != "") & third.try_cast("double").isNull()))
    )
    body = rows.join(top, "dsm_id").filter(~head).filter("size(c) >= 2 and c[0] <> '' and c[1] <> ''")
    number = third.try_cast("double")
    weight = F.when(third == "", 1.0).when(
        number.isNull() | F.isnan(number), F.raise_error(F.concat(F.lit("not a weight: "), third)).cast("double")
    ).otherwise(number)
    pairs = body.select("dsm_id", "line", F.get("c", F.lit(0)).alias("src"), F.get("c", F.lit(1)).alias("dst"), weight.alias("w"))
    seen = (
        pairs.select("dsm_id", "line", F.posexplode(F.array("src", "dst")).alias("side", "label"))
        .groupBy("dsm_id", "label")
        .agg(F.min(2 * F.col("line") + F.col("side")).alias("first"))
    )
    elements = numbered(seen, ["first", "label"], "idx").select("dsm_id", "idx", "label")
    last = pairs.filter("src <> dst").groupBy("dsm_id", "src", "dst").agg(F.max_by("w", "line").alias("w")).filter("w > 0")
    a, b = (
        elements.select("dsm_id", F.col("idx").alias("i"), F.col("label").alias("src")),
        elements.select("dsm_id", F.col("idx").alias("j"), F.col("label").alias("dst")),
    )
    return Dsm(elements, last.join(a, ["dsm_id", "src"]).join(b, ["dsm_id", "dst"]).select("dsm_id", "i", "j", "w"))


def read_edge_lists(spark: SparkSession, path: str) -> Dsm:
    """All edge-list files of a path; dsm_id is the file's name."""
    files = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), "value")
    lines = files.select("file", F.posexplode(F.split("value", "\r?\n")).alias("line", "value"))
    return edges_from_lines(lines, F.col("file"))


def write_matrix_csv(dsm: Dsm, path: str, convention: str = "IR") -> None:
    """One CSV for each matrix, as rows of text in order: for matrices that a kernel holds."""
    from depmatrix.plans.fanout import dense, packed

    labels = dsm.elements.groupBy("dsm_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("idx", "label"))), lambda x: x["label"]).alias("labels")
    )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.to_dict("records"):
                a, out = dense(row), io.StringIO()
                a, names = (a.T if convention == "IC" else a), list(row["labels"])
                w = csv.writer(out, lineterminator="\n")
                w.writerow(["label", *names])
                w.writerows([n, *(f"{v:g}" if v else "" for v in r)] for n, r in zip(names, a, strict=True))
                yield pd.DataFrame({"dsm_id": [row["dsm_id"]], "value": [out.getvalue()]})

    packed(dsm).join(labels, "dsm_id").mapInPandas(run, "dsm_id string, value string").write.partitionBy("dsm_id").text(path)
