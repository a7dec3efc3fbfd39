"""Matrix files as a Spark data source: spark.read.format("dsm").load(folder), df.write.format("dsm").save(folder), after register(spark).

Rows are (dsm_id, i, j, label, w): an element has a label and no j, a cell no label. A partition is a file, so any number of files is read and written in parallel. Files are opened
by their path, so on a cluster the folder has to be one that is mounted on all machines.

Reading: CSV matrices and workbooks; options sheet (index or name), convention (IR or IC), format (csv or xlsx; by default the file's ending). dsm_id is the file's name. A filter on dsm_id
(= or IN) leaves other files unopened. An empty folder gives no rows, a file that can't be read an error that names it.

Writing: a CSV a matrix, a row at a time, from rows as laid_out() gives them: each matrix in one task, elements first. Tasks write to names of their own; commit moves them all, so that a
failed or repeated task leaves nothing. A matrix that two tasks wrote, and a name with a slash, is an error.
"""

from __future__ import annotations

import csv
import os
import shutil
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from depmatrix.schema import Dsm
from depmatrix.sources import text, workbook

SCHEMA = "dsm_id string, i int, j int, label string, w double"
_KINDS = {".csv": "csv", ".xlsx": "xlsx", ".xlsm": "xlsx"}


def _local(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:") or "/"


@dataclass
class _File(InputPartition):
    path: str
    kind: str

    @property
    def dsm_id(self) -> str:
        return os.path.basename(self.path)


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self._options = options
        self._only: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("dsm_id",):
                names = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self._only = names if self._only is None else self._only & names
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        path, kind = _local(self._options["path"]), self._options.get("format")
        names = [path] if os.path.isfile(path) else sorted(os.path.join(path, n) for n in os.listdir(path) if n[0] not in "._")
        found = [_File(n, kind or _KINDS.get(os.path.splitext(n)[1].lower(), "")) for n in names]
        return [f for f in found if f.kind and (self._only is None or f.dsm_id in self._only)]

    def read(self, partition: _File) -> Iterator[tuple]:
        try:
            if partition.kind == "csv":
                with open(partition.path, encoding="utf-8-sig", newline="") as f:
                    labels, cells = text.parse_matrix(f.read())
            else:
                with open(partition.path, "rb") as f:
                    labels, cells = workbook.parse_matrix(workbook.rows(f.read(), _sheet(self._options.get("sheet", "0"))))
        except Exception as e:
            raise ValueError(f"{partition.path}: {e}") from e
        turned = self._options.get("convention", "IR") == "IC"
        for i, label in enumerate(labels):
            yield partition.dsm_id, i, None, label, None
        for i, j, w in cells:
            yield partition.dsm_id, *((j, i) if turned else (i, j)), None, float(w)


def _sheet(given: str) -> int | str:
    return int(given) if given.isdigit() else given


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, str]]  # own name, name in the folder


class _Writer(DataSourceWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self._folder, self._overwrite = _local(options["path"]), overwrite
        self._own = os.path.join(self._folder, f"_writing-{uuid.uuid4().hex}")

    def write(self, rows: Iterator) -> _Written:
        os.makedirs(self._own, exist_ok=True)
        files: list[tuple[str, str]] = []
        sheet: _Sheet | None = None
        for dsm_id, i, j, label, w in rows:
            if sheet is None or sheet.dsm_id != dsm_id:
                if sheet:
                    sheet.close()
                if not dsm_id or "/" in dsm_id or any(n == _named(dsm_id) for _, n in files):
                    raise ValueError(f"matrix {dsm_id!r} has no name for a file, or its rows don't stand together")
                sheet = _Sheet(dsm_id, os.path.join(self._own, uuid.uuid4().hex))
                files.append((sheet.path, _named(dsm_id)))
            sheet.add(i, j, label, w)
        if sheet:
            sheet.close()
        return _Written(files)

    def commit(self, messages: list[_Written | None]) -> None:
        files = [f for m in messages if m for f in m.files]
        names = [n for _, n in files]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("rows of a matrix stand in more than one task: use laid_out()")
        os.makedirs(self._folder, exist_ok=True)
        if self._overwrite:
            for n in os.listdir(self._folder):
                if n.endswith(".csv") and n not in names:
                    os.remove(os.path.join(self._folder, n))
        for own, name in files:
            os.replace(own, os.path.join(self._folder, name))
        shutil.rmtree(self._own, ignore_errors=True)

    def abort(self, messages: list[_Written | None]) -> None:
        shutil.rmtree(self._own, ignore_errors=True)


def _named(dsm_id: str) -> str:
    return dsm_id if dsm_id.lower().endswith(".csv") else f"{dsm_id}.csv"


def _shown(w: float | None) -> str:
    return "" if not w else f"{w:.0f}" if w.is_integer() and abs(w) < 1e15 else repr(w)


class _Sheet:
    """One matrix's CSV: labels are held, cells of one row at a time."""

    def __init__(self, dsm_id: str, path: str):
        self.dsm_id, self.path = dsm_id, path
        self._file = open(path, "w", encoding="utf-8", newline="")  # noqa: SIM115  closed by close()
        self._csv = csv.writer(self._file, lineterminator="\n")
        self._labels: list[str] = []
        self._at, self._cells = -1, {}

    def add(self, i: int, j: int | None, label: str | None, w: float | None) -> None:
        if j is None:
            if i != len(self._labels) or self._at >= 0:
                raise ValueError(f"elements of {self.dsm_id!r} aren't numbered from 0, or come after cells")
            self._labels.append(label or "")
            return
        if self._at < 0:
            self._csv.writerow(["", *self._labels])
            self._at = 0
        if not self._at <= i < len(self._labels) or not 0 <= j < len(self._labels):
            raise ValueError(f"cell ({i}, {j}) of {self.dsm_id!r} is out of order or has no element")
        self._until(i)
        self._cells[j] = w

    def _until(self, i: int) -> None:
        while self._at < i:
            # the diagonal is written, so that no row looks empty
            cells = (_shown(self._cells.get(j)) if j != self._at else "0" for j in range(len(self._labels)))
            self._csv.writerow([self._labels[self._at], *cells])
            self._at, self._cells = self._at + 1, {}

    def close(self) -> None:
        if self._at < 0:
            self._csv.writerow(["", *self._labels])
            self._at = 0
        self._until(len(self._labels))
        self._file.close()


class DsmSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "dsm"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known, and lets filters reach it (readers that take filters are refused otherwise)."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(DsmSource)


def laid_out(dsm: Dsm, convention: str = "IR") -> DataFrame:
    """The rows of all matrices as the writer takes them: each matrix in one task, its elements, then its cells row by row. IC: transposed."""
    a, b = ("j", "i") if convention == "IC" else ("i", "j")
    nothing = F.lit(None)
    elements = dsm.elements.select("dsm_id", F.col("idx").alias("i"), nothing.cast("int").alias("j"), "label", nothing.cast("double").alias("w"))
    cells = dsm.edges.filter("i <> j").select("dsm_id", F.col(a).alias("i"), F.col(b).alias("j"), nothing.cast("string").alias("label"), "w")
    return elements.unionByName(cells).repartition("dsm_id").sortWithinPartitions("dsm_id", F.col("j").isNotNull(), "i", "j")


def as_dsm(rows: DataFrame) -> Dsm:
    """Rows of the source as a batch of matrices."""
    return text.as_dsm(rows)
