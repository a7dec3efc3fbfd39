"""Choice of the reader by a file's name."""

from __future__ import annotations

from pyspark.sql import SparkSession

from depmatrix.schema import Dsm
from depmatrix.sources import project, text, workbook


def read_dsm(spark: SparkSession, path: str, sheet: int | str = 0, convention: str = "IR", format: str | None = None) -> Dsm:
    """format: matrix, edges, project or xlsx; by default .csv files are matrices or edge lists, as their first lines look, .json projects, others workbooks."""
    if format is None and path.lower().endswith(".csv"):
        first = [r["value"] for r in spark.read.text(path).limit(6).collect()]
        format = "edges" if text.looks_like_edge_list(first) else "matrix"
    format = format or ("project" if path.lower().endswith(".json") else "xlsx")
    if format == "matrix":
        return text.read_matrices(spark, path, convention)
    if format == "edges":
        return text.read_edge_lists(spark, path)
    return project.read_projects(spark, path) if format == "project" else workbook.read_workbooks(spark, path, sheet, convention)
