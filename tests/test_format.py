"""The data source for matrix files: round trips, workbooks of other programs, tasks that fail."""

from __future__ import annotations

import os
import zipfile

import numpy as np
import pytest
from fixtures import dsm_of, loop_process, two_cliques
from pyspark.sql import functions as F

from depmatrix.schema import Dsm
from depmatrix.sources import dsm_format, workbook

_BOOK = (
    '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships">'
    '<sheets><sheet name="Notes" sheetId="1" state="hidden" r:id="rId1"/><sheet name="Structure" sheetId="2" r:id="rId2"/></sheets></workbook>'
)
_RELS = (
    '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/>'
    '<Relationship Id="rId2" Target="/xl/worksheets/sheet2.xml"/></Relationships>'
)
_MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
#: "Pump", one text in two runs with its pronunciation, "Valve", "X".
_STRINGS = f"<sst {_MAIN}><si><t>1. Pump</t></si><si><r><t>Mo</t></r><r><t>tor</t></r><rPh sb='0' eb='1'><t>moh</t></rPh></si><si><t>Valve</t></si><si><t>X</t></si></sst>"
_SHEET = f"""<worksheet {_MAIN}><sheetData>
<row r="2"><c r="B2" t="s"><v>0</v></c><c r="C2" t="s"><v>1</v></c><c r="D2" t="s"><v>2</v></c></row>
<row r="3"><c r="A3" t="s"><v>0</v></c><c r="C3" t="s"><v>3</v></c></row>
<row r="5"><c r="A5" t="s"><v>1</v></c><c r="B5" t="inlineStr"><is><t>✓</t></is></c><c r="D5"><v>2.5</v></c></row>
<row><c t="s"><v>2</v></c><c t="b"><v>1</v></c><c/><c t="str"><v>note</v></c></row>
</sheetData></worksheet>"""


def foreign(path):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", _BOOK)
        z.writestr("xl/_rels/workbook.xml.rels", _RELS)
        z.writestr("xl/sharedStrings.xml", _STRINGS)
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {_MAIN}><sheetData/></worksheet>")
        z.writestr("xl/worksheets/sheet2.xml", _SHEET)


def rows_of(d):
    labels = {(r["dsm_id"], r["idx"]): r["label"] for r in d.elements.collect()}
    return labels, {(r["dsm_id"], r["i"], r["j"]): r["w"] for r in d.edges.collect()}


@pytest.fixture()
def source(spark):
    dsm_format.register(spark)
    return spark


def test_round_trip_of_many_matrices(source, tmp_path):
    rng = np.random.default_rng(1)
    given = {f"m{k}": np.round(rng.random((k + 1, k + 1)), 3) * (rng.random((k + 1, k + 1)) < 0.5) for k in range(9)}
    given |= {"loop": loop_process(), "cliques": two_cliques() * 1e-7, "none": np.zeros((3, 3))}
    d = dsm_of(source, **given)
    odd = F.when(F.col("idx") == 0, F.lit('a, "b"\nc')).when(F.col("idx") == 1, "").otherwise(F.col("label"))
    d = Dsm(d.elements.withColumn("label", odd), d.edges)
    for convention in ("IR", "IC"):
        folder = str(tmp_path / convention)
        dsm_format.laid_out(d, convention).write.format("dsm").mode("append").save(folder)
        assert sorted(os.listdir(folder)) == sorted(f"{n}.csv" for n in given)
        back = dsm_format.as_dsm(source.read.format("dsm").option("convention", convention).load(folder))
        back = Dsm(*(x.withColumn("dsm_id", F.regexp_replace("dsm_id", r"\.csv$", "")) for x in (back.elements, back.edges)))
        assert rows_of(back) == rows_of(d)
    dsm_format.laid_out(dsm_of(source, loop=two_cliques())).write.format("dsm").mode("overwrite").save(folder)
    assert os.listdir(folder) == ["loop.csv"]


def test_workbooks_of_other_programs(source, tmp_path):
    foreign(tmp_path / "plant.xlsx")
    (tmp_path / "_hidden.csv").write_text("x")
    for sheet in ("1", "Structure"):
        labels, cells = rows_of(dsm_format.as_dsm(source.read.format("dsm").option("sheet", sheet).load(str(tmp_path))))
        name = "plant.xlsx"
        assert [labels[name, k] for k in range(3)] == ["Pump", "Motor", "Valve"]
        assert cells == {(name, 0, 1): 1.0, (name, 1, 0): 1.0, (name, 1, 2): 2.5, (name, 2, 0): 1.0}
    assert [n for n, _, seen in workbook.sheets((tmp_path / "plant.xlsx").read_bytes()) if seen] == ["Structure"]
    with pytest.raises(Exception, match="plant.xlsx"):
        source.read.format("dsm").option("sheet", "Nothing").load(str(tmp_path)).collect()


def test_filters_on_the_name_leave_other_files_unopened(source, tmp_path):
    for k in range(4):
        (tmp_path / f"m{k}.csv").write_text("label,a,b\na,0,2\nb,1,0\n")
    (tmp_path / "broken.xlsx").write_bytes(b"no archive")
    rows = source.read.format("dsm").load(str(tmp_path))
    assert rows.filter("dsm_id = 'm2.csv' and w > 1").count() == 1
    assert rows.filter("dsm_id in ('m1.csv', 'm3.csv') and j is not null").count() == 4


def test_failed_tasks_leave_no_file(source, tmp_path):
    folder = str(tmp_path / "out")
    d = dsm_of(source, good=two_cliques(), bad=loop_process())
    lost = Dsm(d.elements.filter("not (dsm_id = 'bad' and idx = 6)"), d.edges)  # a cell without its element
    with pytest.raises(Exception, match="no element"):
        dsm_format.laid_out(lost).write.format("dsm").mode("append").save(folder)
    assert not os.path.exists(folder) or os.listdir(folder) == []
    scattered = dsm_format.laid_out(d).repartition(4)
    with pytest.raises(Exception):  # noqa: B017  out of order, or in several tasks
        scattered.write.format("dsm").mode("append").save(folder)
    assert not os.path.exists(folder) or os.listdir(folder) == []
