"""Workbooks (.xlsx) by the standard library: reading matrices and sheet lists, writing a result."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depmatrix.schema import Dsm
from depmatrix.sources.text import _CELLS, as_dsm

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: What counts as 1 besides numbers.
MARKS = ("X", "✓", "YES")


def sheets(content: bytes) -> list[tuple[str, str, bool]]:
    """(name, part in the archive, visible) in the workbook's order."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        return [
            (s.get("name"), "xl/" + targets[s.get(_REL)].lstrip("/").removeprefix("xl/"), s.get("state", "visible") == "visible")
            for s in book.find("m:sheets", _NS)
        ]


def _text(x: ElementTree.Element) -> str:
    """All runs of a text, but not how it is pronounced."""
    spoken = {t for p in x.iter(f"{{{_NS['m']}}}rPh") for t in p}
    return "".join(t.text or "" for t in x.iter(f"{{{_NS['m']}}}t") if t not in spoken)


def rows(content: bytes, sheet: int | str = 0) -> list[list[str]]:
    """Cells of a sheet, by index or name, as texts; gaps are empty."""
    listed = sheets(content)
    if isinstance(sheet, str) and not any(n == sheet for n, _, _ in listed) and sheet.strip().isdigit():
        sheet = int(sheet)
    part = listed[sheet][1] if isinstance(sheet, int) else next((p for n, p, _ in listed if n == sheet), None)
    if part is None:
        raise ValueError(f"no sheet {sheet!r}")
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = (
            [_text(x) for x in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
            if "xl/sharedStrings.xml" in z.namelist()
            else []
        )
        out: dict[int, dict[int, str]] = {}
        row = column = 0
        for c in ElementTree.fromstring(z.read(part)).iter():
            if c.tag == f"{{{_NS['m']}}}row":  # rows and cells without a reference follow the one before
                row, column = int(c.get("r") or row + 1), 0
            if c.tag != f"{{{_NS['m']}}}c":
                continue
            column += 1
            if c.get("r"):
                letters, digits = re.match(r"([A-Z]+)(\d+)", c.get("r")).groups()
                row, column = int(digits), 0
                for x in letters:
                    column = column * 26 + ord(x) - 64
            kind, value = c.get("t"), c.find("m:v", _NS)
            text = (
                _text(c)
                if kind == "inlineStr"
                else (value.text or "" if value is not None else "")
            )
            out.setdefault(row - 1, {})[column - 1] = shared[int(text)] if kind == "s" and text else text
    width = max((max(r) + 1 for r in out.values()), default=0)
    return [[out.get(i, {}).get(j, "") for j in range(width)] for i in range(max(out, default=-1) + 1)]


def parse_matrix(table: list[list[str]]) -> tuple[list[str], list[tuple[int, int, float]]]:
    """(labels, cells): header after leading empty rows; rows without a label don't count; labels lose a leading number; marks and numbers are weights."""
    filled = [k for k, r in enumerate(table) if any(c.strip() for c in r)]
    body = [r for r in table[filled[0] + 1 :] if r and r[0].strip()] if filled else []
    if not body:
        raise ValueError("no component labels")

    def weight(x: str) -> float:
        if x.strip().upper() in MARKS:
            return 1.0
        try:
            return float(x)
        except ValueError:
            return 0.0

    labels = [re.sub(r"^\d+[.\s]+", "", r[0].strip()).strip() for r in body]
    return labels, [(i, j, w) for i, r in enumerate(body) for j, x in enumerate(r[1 : len(body) + 1]) if i != j and (w := weight(x)) > 0]


def read_workbooks(spark: SparkSession, path: str, sheet: int | str = 0, convention: str = "IR") -> Dsm:
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("dsm_id"), "content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for dsm_id, content in zip(frame["dsm_id"], frame["content"], strict=True):
                labels, cells = parse_matrix(rows(content, sheet))
                data = [(dsm_id, i, None, x, None) for i, x in enumerate(labels)] + [(dsm_id, i, j, None, w) for i, j, w in cells]
                yield pd.DataFrame(data, columns=["dsm_id", "i", "j", "label", "w"]).astype({"i": "Int32", "j": "Int32"})

    return as_dsm(files.mapInPandas(run, _CELLS), convention)


def list_sheets(spark: SparkSession, path: str) -> DataFrame:
    """(dsm_id, place, sheet) of visible sheets; none for files that aren't workbooks, such as CSV."""
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("dsm_id"), "content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for dsm_id, content in zip(frame["dsm_id"], frame["content"], strict=True):
                listed = sheets(content) if zipfile.is_zipfile(io.BytesIO(content)) else []
                yield pd.DataFrame([(dsm_id, k, n) for k, (n, _, seen) in enumerate(listed) if seen], columns=["dsm_id", "place", "sheet"])

    return files.mapInPandas(run, "dsm_id string, place int, sheet string")


def _name(column: int) -> str:
    out = ""
    while column >= 0:
        out, column = chr(65 + column % 26) + out, column // 26 - 1
    return out


#: Fills of clusters in turn, of the diagonal, of marks between clusters.
COLOURS = ("AED6F1", "A9DFBF", "F9E79F", "F5CBA7", "D7BDE2", "FAD7A0", "A3E4D7", "85C1E9", "D5DBDB", "FADBD8")
DIAGONAL, BETWEEN = "BFC9CA", "F1948A"


def _styles(main: str) -> str:
    fills = [*COLOURS, DIAGONAL, BETWEEN]
    solid = "".join(f'<fill><patternFill patternType="solid"><fgColor rgb="FF{x}"/></patternFill></fill>' for x in fills)
    used = "".join(f'<xf numFmtId="0" fontId="0" fillId="{k + 2}" borderId="0" xfId="0" applyFill="1"/>' for k in range(len(fills)))
    none = '<fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill>'
    plain = '<xf numFmtId="0" fontId="0" fillId="0" borderId="0"'
    return (
        f'<styleSheet xmlns="{main}"><fonts count="1"><font/></fonts><fills count="{len(fills) + 2}">{none}{solid}</fills><borders '
        'count="1"><border/></borders>'
        f'<cellStyleXfs count="1">{plain}/></cellStyleXfs><cellXfs count="{len(fills) + 1}">{plain} xfId="0"/>{used}</cellXfs></styleSheet>'
    )


def workbook(matrix, labels: list[str], title: str = "DSM", clusters: list[int] | None = None) -> bytes:
    """One matrix as a workbook: title in A1, header beside it from column B on, integral weights as integers, others to two places.

    clusters: labels and marks inside a cluster have its colour, marks between clusters another, the diagonal its own."""
    known = {c: k % len(COLOURS) for k, c in enumerate(sorted(set(clusters)))} if clusters else {}
    fill = [known[c] + 1 for c in clusters] if clusters else [0] * len(labels)

    def cell(r: int, c: int, v, style: int) -> str:
        at = f'r="{_name(c)}{r + 1}"' + (f' s="{style}"' if style else "")
        if v is None:
            return f"<c {at}/>"
        if isinstance(v, str):
            return f'<c {at} t="inlineStr"><is><t>{escape(v)}</t></is></c>'
        return f"<c {at}><v>{int(v) if float(v).is_integer() else round(float(v), 2)}</v></c>"

    def mark(r: int, c: int, v) -> str:
        if r == c:
            return cell(r + 1, c + 1, None, len(COLOURS) + 1) if clusters else ""
        inside = not clusters or clusters[r] == clusters[c]
        return cell(r + 1, c + 1, v, fill[r] if inside else len(COLOURS) + 2) if v > 0 else ""

    lines = [cell(0, 0, title, 0) + "".join(cell(0, c + 1, x, fill[c]) for c, x in enumerate(labels))]
    lines += [cell(r + 1, 0, x, fill[r]) + "".join(mark(r, c, v) for c, v in enumerate(matrix[r])) for r, x in enumerate(labels)]
    sheet = "".join(f'<row r="{r + 1}">{line}</row>' for r, line in enumerate(lines))
    main, rel = _NS["m"], "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    parts = {"/xl/workbook.xml": "sheet.main", "/xl/worksheets/sheet1.xml": "worksheet", "/xl/styles.xml": "styles"}
    named = "".join(f'<Override PartName="{p}" ContentType="{kind}.{k}+xml"/>' for p, k in parts.items())
    plain = '<Default Extension="xml" ContentType="application/xml"/>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(
            "[Content_Types].xml",
            f'<Types xmlns="{package}/content-types"><Default Extension="rels" '
            f'ContentType="application/vnd.openxmlformats-package.relationships+xml"/>{plain}{named}</Types>',
        )
        z.writestr(
            "_rels/.rels",
            f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" '
            'Target="xl/workbook.xml"/></Relationships>',
        )
        z.writestr(
            "xl/workbook.xml",
            f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="DSM" sheetId="1" r:id="r1"/></sheets></workbook>',
        )
        links = (
            f'<Relationship Id="r1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Type="{rel}/styles" '
            'Target="styles.xml"/>'
        )
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{package}/relationships">{links}</Relationships>')
        z.writestr("xl/styles.xml", _styles(main))
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData>{sheet}</sheetData></worksheet>')
    return out.getvalue()


def workbooks(dsm: Dsm, ordering: DataFrame, title: str = "Optimized DSM", convention: str = "IR") -> DataFrame:
    """(dsm_id, content): each matrix in the order of ordering (dsm_id, pos, idx, cluster) as a workbook with the clusters' colours; IC files are transposed back."""
    from depmatrix.operators.transforms import permute
    from depmatrix.plans.fanout import dense, packed

    final = permute(dsm, ordering)
    said = ordering.select("dsm_id", F.col("pos").alias("idx"), "cluster").join(final.elements, ["dsm_id", "idx"])
    listed = said.groupBy("dsm_id").agg(F.sort_array(F.collect_list(F.struct("idx", "label", "cluster"))).alias("said"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        row = frame.to_dict("records")[0]
        a = dense(row)
        content = workbook(
            a.T if convention == "IC" else a, [x["label"] for x in row["said"]], title, [int(x["cluster"]) for x in row["said"]]
        )
        return pd.DataFrame({"dsm_id": [row["dsm_id"]], "content": [content]})

    return packed(final).join(listed, "dsm_id").groupBy("dsm_id").applyInPandas(run, "dsm_id string, content binary")
