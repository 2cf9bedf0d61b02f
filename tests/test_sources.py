import json
import zipfile

from wordloom.sources import readers
from wordloom.streaming import flows

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def test_text_json_and_docx(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Ala.\nKot.", encoding="utf-8")
    (tmp_path / "c.jsonl").write_text(json.dumps({"text": "raz"}) + "\nnot json\n", encoding="utf-8")
    assert readers.halves(readers.text_files(spark, str(tmp_path))).first().text == "Ala.\nKot."
    assert [r.text for r in readers.json_lines(spark, str(tmp_path / "c.jsonl")).collect()] == ["raz"]
    assert sorted(r.text for r in readers.json_lines(spark, str(tmp_path / "c.jsonl"), raw=True).collect()) == ["not json", "raz"]
    body = "<w:p><w:r><w:t>Raz</w:t><w:tab/><w:t>dwa</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>pole</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>')
    (tmp_path / "~$d.docx").write_bytes(b"lock")
    (tmp_path / "broken.docx").write_bytes(b"no zip")
    units = readers.docx_files(spark, str(tmp_path))
    assert sorted((r.kind or "", r.text or "") for r in units.collect()) == [("", ""), ("cell", "pole"), ("paragraph", "Raz\tdwa")]
    assert [r.text for r in readers.docx_texts(units).collect()] == ["Raz\tdwa\npole"]


def test_columns_by_name_letter_and_place(spark):
    d = spark.createDataFrame([(1, "x")], "`Id` long, `Treść  Pisma` string")
    assert d.select(readers.column(d, "treść pisma"), readers.column(d, "B"), readers.column(d, 1)).first() == ("x", "x", 1)


def test_stream_equals_batch(spark, tmp_path):
    from wordloom.operators import documents

    docs = spark.createDataFrame([(1, "Ponadto tak. Ponadto nie."), (2, "Nic.")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "in"))
    flows.diagnose_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    assert sorted(got.collect()) == sorted(documents.document_signal(docs).collect())


def test_xlsx(spark, tmp_path):
    x = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    r = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    rows = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>Treść </t><t>pisma</t></is></c></row><row r="2"><c r="A2"><v>7</v></c><c r="C2" t="str"><f>A2</f><v>raz</v></c></row><row r="4"><c r="C4" t="s"><v>1</v></c><c r="AA4"/></row>'
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{x}" xmlns:r="{r}"><sheets><sheet name="S" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{x}"><si><t>Nr</t></si><si><r><t>d</t></r><r><t>wa</t></r></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{x}"><sheetData>{rows}</sheetData></worksheet>')
    (tmp_path / "b.xlsx").write_bytes(b"no zip")
    cells = readers.xlsx_cells(spark, str(tmp_path))
    assert sorted((c.row, c.place, c.value) for c in cells.where("problem IS NULL").collect()) == [(1, 1, "Nr"), (1, 3, "Treść pisma"), (2, 1, "7"), (2, 3, "raz"), (4, 3, "dwa")]
    assert cells.where("problem IS NOT NULL").count() == 1
    for wanted in ("treść  PISMA", "C", 3, "3"):
        assert sorted((c.row, c.text) for c in readers.xlsx_column(cells, wanted).collect()) == [(2, "raz"), (4, "dwa")]
    assert [c.text for c in readers.xlsx_column(cells, "nr").collect()] == ["7"]
