"""Files in, files out."""

import io
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from quillgrid.operators import widgets
from quillgrid.plans.detect import detect
from quillgrid.sources import documents, pdf, sinks, tables


def write(folder, name, data):
    folder.mkdir(exist_ok=True)
    (folder / name).write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(folder)


def test_permissive_field_specs(spark, tmp_path):
    text = "﻿page,name,type,x,y,w,h\r\n1,txtA,tx,1,2,30,14\r\n,txtB,text,1,2,3,4\r\n1,c,blob,1,2,3,4\r\n1,d,text,1,x,3,4\r\n2,imgS,IMG,1.5,2,3,4\r\n1,e,text,nan,2,3,4\r\n"
    rows = tables.csv_rows(tables.files(spark, write(tmp_path / "a", "one.csv", text)))
    specs, issues = tables.field_specs(rows)
    assert sorted((r.row, r.name, r.type, r.x) for r in specs.collect()) == [(2, "txtA", "text", 1.0), (6, "imgS", "image", 1.5)]
    assert sorted((r.row, r.code, r.field) for r in issues.collect()) == [(1, "missing-optional-columns", None), (3, "empty-required-cell", None), (4, "unsupported-type", "c"), (5, "invalid-number", "d"), (7, "invalid-number", "e")]
    lacking = tables.csv_rows(tables.files(spark, write(tmp_path / "b", "two.csv", "page,name\n1,a\n")))
    specs, issues = tables.field_specs(lacking)
    assert specs.count() == 0 and [r.code for r in issues.collect()] == ["missing-columns"]


def test_strict_field_specs(spark, tmp_path):
    good = tables.csv_rows(tables.files(spark, write(tmp_path / "a", "one.csv", "page,name,type,x,y,w,h,value\n1,a,,1,2,3,4,v\n")))
    assert [(r.name, r.type, r.value) for r in tables.strict_field_specs(good).collect()] == [("a", "text", "v")]
    for i, bad in enumerate(("1,,text,1,2,3,4", "x,a,text,1,2,3,4", "1,a,blob,1,2,3,4", "1,a,text,1,2,z,4")):
        rows = tables.csv_rows(tables.files(spark, write(tmp_path / f"bad{i}", "x.csv", f"page,name,type,x,y,w,h\n{bad}\n")))
        with pytest.raises(Exception, match="row 2"):
            tables.strict_field_specs(rows).collect()


def test_names_of_files(spark, tmp_path):
    write(tmp_path / "n", "list.csv", "field_name,prefix\ntxtA,txt\n chkB ,chk\n,\n")
    folder = write(tmp_path / "n", "code.cs", 'x = "txtFoo_1"; Atxt; imgBar; txt')
    got = {(r.path.rsplit("/", 1)[1], r.name) for r in tables.known_names(tables.files(spark, folder)).collect()}
    assert got == {("list.csv", "txtA"), ("list.csv", "chkB"), ("code.cs", "txtFoo_1"), ("code.cs", "imgBar")}
    write(tmp_path / "x", "a.xml", "<f><field x='1' name='one'/><field name=\"two\">")
    folder = write(tmp_path / "x", "b.bin", '<field name="no">')
    assert {r.name for r in tables.example_names(tables.files(spark, folder)).collect()} == {"one", "two"}


def test_semantic_aliases(spark, tmp_path):
    known = spark.createDataFrame([("txtName",), ("txtMail",)], "name string")
    rows = tables.csv_rows(tables.files(spark, write(tmp_path / "s", "m.csv", "label,name,field_name\nFull Name:,oldName,TXTNAME\nmail,,txtMail\nmail,,txtName\n,,txtName\n")))
    assert sorted(map(tuple, tables.semantic_aliases(rows, known).collect())) == [("label", "full name", "txtName"), ("name", "oldname", "txtName")]
    bad = tables.csv_rows(tables.files(spark, write(tmp_path / "t", "m.csv", "label,field_name\na,txtNope\n")))
    with pytest.raises(Exception, match="txtNope"):
        tables.semantic_aliases(bad, known).collect()


def workbook(rows):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    strings, body = [], ""
    for n, cells in enumerate(rows, 1):
        body += f'<row r="{n}">'
        for i, c in enumerate(cells):
            if c is None:
                continue
            if i % 2:
                body += f'<c r="{chr(65 + i)}{n}" t="inlineStr"><is><t>{c}</t></is></c>'
            else:
                strings.append(c)
                body += f'<c r="{chr(65 + i)}{n}" t="s"><v>{len(strings) - 1}</v></c>'
        body += "</row>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>" + "".join(f"<si><t>{s}</t></si>" for s in strings) + "</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")
    return out.getvalue()


def test_workbook_aliases(spark, tmp_path, monkeypatch):
    rows = [("Current field", "Suggested code field", "Status", "Notes"), ("p.txtNameOfAccountOwner[0]", "txtAccountName", "Direct match", None), ("CheckBox2[0]", "chkPersonMale / chkPersonFemale", "Context dependent", None), ("txtUnknown", "txtDoesNotExist", "Direct match", None), ("txtBoth", "chkPersonMale / chkPersonFemale", "Direct match", None), (None, "txtAccountName", "Direct match", None)]
    folder = write(tmp_path / "w", "m.xlsx", workbook(rows))
    known = spark.createDataFrame([("txtAccountName",), ("chkPersonMale",), ("chkPersonFemale",)], "name string")
    sheet = tables.sheet_rows(tables.files(spark, folder))
    assert {r.alias for r in tables.mapping_aliases(sheet, known).collect()} == {"p.txtnameofaccountowner[0]", "p.txtnameofaccountowner", "txtnameofaccountowner"}
    monkeypatch.setattr(tables, "MOST_SHEET_BYTES", 10)
    with pytest.raises(ValueError, match="larger"):
        tables._sheet(workbook(rows), 1)


def test_word_boxes_and_layout(spark):
    lines = ['<word xMin="0" yMin="0" xMax="1" yMax="1">early</word>', '<page width="600" height="500">', '<word xMin="264.6" yMin="108" xMax="283.9" yMax="120">a &amp; b</word>', "<flow>", '<page width="600" height="400">', '<word xMin="1" yMin="2" xMax="3" yMax="4">________</word>']
    df = spark.createDataFrame([("d", i, t) for i, t in enumerate(lines)], "doc_id string, line int, text string")
    words = documents.word_boxes(df)
    assert sorted((r.page, r.text, r.x0, r.page_height) for r in words.collect()) == [(1, "a & b", 264.6, 500.0), (2, "________", 1.0, 400.0)]
    assert [(r.text, r.x, r.y) for r in documents.word_anchors(words).collect()] == [("a & b", 264.6, 380.0)]
    layout = '{"pages": [{"page": 1, "width": 8.5, "height": 11, "words": [{"text": "w", "polygon": [1, 1, 2, 1, 2, 2, 1, 2]}], "lines": [], "marks": [{"state": "x", "polygon": [0, 0, 0.2, 0, 0.2, 0.2, 0, 0.2]}, {"state": "big", "polygon": [0, 0, 5, 0, 5, 5, 0, 5]}]}]}'
    sizes = spark.createDataFrame([("d", 1, 612.0, 792.0)], "doc_id string, page int, width double, height double")
    out = documents.layout_items(spark.createDataFrame([("d", layout)], "doc_id string, json string"), sizes)
    assert sorted((r.kind, r.text, r.x1, r.y1) for r in out.collect()) == [("mark", "x", pytest.approx(14.4), pytest.approx(14.4)), ("word", "w", 144.0, 144.0)]


def test_templates_read_back(spark):
    specs = spark.createDataFrame([("d", 1, "txtA<", "text", 130.0, 732.0, 200.0, 18.0), ("d", 1, "chkB", "checkbox", 10.0, 10.0, 12.0, 12.0), ("d", 7, "gone", "text", 1.0, 1.0, 1.0, 1.0)], "doc_id string, page int, name string, type string, x double, y double, w double, h double")
    pages = spark.createDataFrame([("d", 1, 595.0, 842.0), ("d", 2, 595.0, 842.0)], "doc_id string, page int, width double, height double")
    built = sinks.templates(specs, pages)
    xml = built.first().xml
    assert f'x="{130 * 0.3528:.4f}mm" y="{(842 - 732 - 18) * 0.3528:.4f}mm"' in xml
    fields = documents.form_fields(built)
    assert [(r.page, r.name) for r in fields.orderBy("seq").collect()] == [("Page1", "txtA<"), ("Page1", "chkB")]
    names = spark.createDataFrame([("d", "Page1"), ("d", "Page2")], "doc_id string, page string")
    assert sorted((r.page, r.n) for r in documents.page_summaries(fields, names).collect()) == [("Page1", 2), ("Page2", 0)]
    assert documents.form_fields(spark.createDataFrame([("x", "no xml"), ("y", None)], "doc_id string, xml string")).count() == 0


def test_csv_sinks(spark, tmp_path):
    specs = spark.createDataFrame([(1, "a", "text", 1.0, 2.0, 3.0, 4.0)], "page int, name string, type string, x double, y double, w double, h double")
    path = str(tmp_path / "out")
    sinks.write_csv(sinks.with_value(specs), path, sinks.SPEC_COLUMNS, one_file=True)
    got, issues = tables.field_specs(tables.csv_rows(tables.files(spark, path, "*.csv")))
    assert issues.count() == 0 and got.select("page", "name", "type", "x", "y", "w", "h").first() == specs.first()
    with pytest.raises(FileExistsError):
        sinks.write_csv(sinks.with_value(specs), path, sinks.SPEC_COLUMNS)
    sinks.write_csv(sinks.with_value(specs), path, sinks.SPEC_COLUMNS, overwrite=True)


def make_pdf(content, extra=b"", packed=True):
    stream = zlib.compress(content) if packed else content
    kind = b" /Filter /FlateDecode" if packed else b""
    parts = [
        b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 /MediaBox [0 0 595 842] >>",
        b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R /Annots [5 0 R 7 0 R] >>", b"<< /Length %d%s >>\nstream\n%s\nendstream" % (len(stream), kind, stream),
        b"<< /Subtype /Widget /Rect [10 20 110 40] /T (leaf\\(1\\)) /Parent 6 0 R >>", b"<< /T (root) /FT /Tx /Ff 4096 >>", b"<< /Subtype /Widget /Rect [0 0 12 12] /T (imgSignature) /FT /Btn /Ff 65536 >>",
    ]
    return b"%PDF-1.7\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i, p) for i, p in enumerate(parts, 1)) + extra + b"trailer << /Root 1 0 R >>"


CONTENT = b"""q 1 0 0 1 0 0 cm 150 700 200 20 re S Q
BT /F1 10 Tf 50 705 Td (Full name) Tj ET
2 0 0 2 0 0 cm 50 300 6 6 re S 0.5 0 0 0.5 0 0 cm
BT 1 0 0 1 120 603 Tm [(App) -20 (roved)] TJ ET
1 g 300 300 100 30 re f 0 g
50 500 m 250 500 l S
BT 50 510 Td (Address) Tj ET BT 50 200 Td (Email:) Tj ET"""


@pytest.mark.parametrize("packed", [True, False])
def test_pdf_tables(spark, tmp_path, packed):
    write(tmp_path / "p", "not.pdf", b"hello")
    found = tables.files(spark, write(tmp_path / "p", "a.pdf", make_pdf(CONTENT, packed=packed)), "*.pdf")
    assert [tuple(r)[1:] for r in pdf.page_sizes(found).collect()] == [(1, 595.0, 842.0)]
    items = pdf.drawn_items(found)
    got = {(r.kind, r.x, r.y, r.w, r.h, r.text) for r in items.collect()}
    assert got == {
        ("rect", 150.0, 700.0, 200.0, 20.0, None), ("checkbox", 100.0, 600.0, 12.0, 12.0, None), ("line", 50.0, 500.0, 200.0, 12.0, None),
        ("anchor", 50.0, 705.0, 0.0, 0.0, "Full name"), ("anchor", 120.0, 603.0, 0.0, 0.0, "Approved"), ("anchor", 50.0, 510.0, 0.0, 0.0, "Address"), ("anchor", 50.0, 200.0, 0.0, 0.0, "Email:"),
    }
    fields = {r.name: (r.type, r.x, r.y) for r in detect(items).collect()}
    assert fields == {"txtFullName": ("text", 150.0, 700.0), "chkApproved": ("checkbox", 100.0, 600.0), "txtAddress": ("text", 50.0, 500.0), "txtEmail": ("text", 87.0, 197.0)}
    own = widgets.inferred(pdf.widgets(found))
    assert sorted((r.name, r.inferred, r.w) for r in own.collect()) == [("imgSignature", "image", 12.0), ("root.leaf(1)", "textarea", 100.0)]


def test_broken_pdf_gives_what_it_holds(spark, tmp_path):
    found = tables.files(spark, write(tmp_path / "q", "b.pdf", b"%PDF-1.4\n1 0 obj\n<< /Type /Catalog >>\nendobj"), "*.pdf")
    assert pdf.page_sizes(found).count() == 0 and pdf.widgets(found).count() == 0
    assert pdf.drawn_items(found.where(F.lit(False))).count() == 0


def test_built_forms_read_back(spark, tmp_path):
    from quillgrid.operators import rules
    from quillgrid.sources import pdf_writer

    flat = make_pdf(CONTENT).replace(b" /Annots [5 0 R 7 0 R]", b"")
    found = tables.files(spark, write(tmp_path / "f", "a.pdf", flat), "*.pdf")
    rows = [(1, "txtA", "text", 10.0, 700.0, 100.0, 20.0, "v"), (1, "txtÄ", "textarea", 10.0, 600.0, 100.0, 40.0, ""), (1, "chkB", "checkbox", 10.0, 500.0, 12.0, 12.0, "yes"), (1, "imgSignature", "image", 10.0, 400.0, 100.0, 20.0, "")]
    path = found.first().path
    specs = spark.createDataFrame([(path, *r) for r in rows], "path string, page int, name string, type string, x double, y double, w double, h double, value string")
    built = pdf_writer.fillable_files(found, specs)
    own = widgets.inferred(pdf.widgets(built))
    assert sorted((r.name, r.inferred, r.x, r.y, r.w, r.h) for r in own.collect()) == sorted((n, t, x, y, w, h) for _, n, t, x, y, w, h, _ in rows)
    assert rules.count_compare(specs, own).count() == 0
    assert pdf.drawn_items(built).count() == pdf.drawn_items(found).count()
    content = bytes(built.first().content)
    start = int(content.rsplit(b"startxref\n", 1)[1].split()[0])
    assert content[start : start + 4] == b"xref" and content.endswith(b"%%EOF\n")
    assert pdf_writer.fillable_files(found, specs.limit(0)).count() == 0
    with pytest.raises(ValueError, match="page 2"):
        pdf_writer.Builder(flat).build([{"page": 2, "name": "n", "type": "text", "x": 0, "y": 0, "w": 1, "h": 1}])


def test_packets_and_fonts(spark, tmp_path):
    form = b"20 0 obj\n<< /Type /Catalog /Pages 2 0 R /AcroForm << /XFA [(xdp) 21 0 R (template) 22 0 R] >> >>\nendobj\n21 0 obj\n<< /Length 3 >>\nstream\n<a>\nendstream\nendobj\n22 0 obj\n<< /Length 4 >>\nstream\n<t/>\nendstream\nendobj\n"
    fonts = b"30 0 obj\n<< /Type /Pages /Kids [31 0 R] >>\nendobj\n31 0 obj\n<< /Type /Page /Resources << /Font << /F1 << /FirstChar 65 /Widths [500 600] >> /F2 << /DescendantFonts [<< /DW 900 /W [3 [250 300] 10 12 400] >>] >> >> >> >>\nendobj\n"
    data = b"%PDF-1.7\n" + form.replace(b"/Pages 2 0 R", b"/Pages 30 0 R") + fonts
    found = tables.files(spark, write(tmp_path / "x", "x.pdf", data), "*.pdf")
    best = pdf.template_packet(pdf.form_packets(found)).first()
    assert (best["name"], best.xml) == ("template", "<t/>")
    widths = pdf.font_widths(found)
    assert {(r.font, r.code): r.em for r in widths.collect()} == {("F1", 65): 0.5, ("F1", 66): 0.6, ("F2", 3): 0.25, ("F2", 4): 0.3, ("F2", 10): 0.4, ("F2", 11): 0.4, ("F2", 12): 0.4}
    path = found.first().path
    units = spark.createDataFrame([(1, path, 1, "F2", c) for c in (3, 10, 99)], "id int, path string, page int, font string, code int")
    assert pdf.advances(units, widths).first().em == pytest.approx(0.25 + 0.4 + 0.9)
    from quillgrid.sources import pdf_writer

    kept = pdf_writer.without_form(data)
    assert not list(pdf.File(kept).packets()) and b"/NeedAppearances true" in kept
    text = spark.createDataFrame([(bytes([0, 46] * 10),), (bytes([1, 46] * 10),), (b"\0a",)], "t binary")
    assert [r[0] for r in text.select(pdf.cid_units(F.col("t"))).collect()] == [[46] * 10, None, None]


def test_issued_names_and_layouts(spark):
    from quillgrid.operators import naming, rules

    fields = spark.createDataFrame([("d", i, n) for i, n in enumerate(["a", "a", "a", "a", "b", "a_1"])], "doc_id string, seq int, name string")
    known = spark.createDataFrame([("a",), ("a_1",), ("a3",), ("b",)], "name string")
    assert [r.issued for r in naming.issued_names(fields, known, ["seq"]).orderBy("seq").collect()] == ["a", "a_1", "a3", "a", "b", "a_1"]
    page = lambda *rows: spark.createDataFrame(rows, "page int, width double, height double")
    out = rules.layout_mismatches(page((1, 600.0, 800.0), (2, 600.0, 800.0), (3, 1.0, 1.0)), page((1, 601.5, 800.0), (2, 603.0, 800.0)))
    assert sorted(map(tuple, out.collect())) == [(2, "page-size"), (3, "page-count")]


def test_deep_fields_and_long_objects(spark, tmp_path):
    chain = b"".join(b"%d 0 obj\n<< /T (n%d) /Parent %d 0 R >>\nendobj\n" % (100 + i, i, 101 + i) for i in range(80))
    chain += b"180 0 obj\n<< /T (top) /FT /Tx /Parent 180 0 R /Opt [%s] >>\nendobj\n" % (b"(endobj x) " * 120_000)
    data = make_pdf(CONTENT).replace(b"/Parent 6 0 R", b"/Parent 100 0 R").replace(b"trailer", chain + b"trailer")
    found = tables.files(spark, write(tmp_path / "d", "a.pdf", data), "*.pdf")
    names = {r.name: r.ft for r in pdf.widgets(found).collect()}
    assert names[".".join(["top", *(f"n{i}" for i in reversed(range(80))), "leaf(1)"])] == "/Tx"


def test_automatic_forms(spark, tmp_path):
    from quillgrid.plans import forms

    found = tables.files(spark, write(tmp_path / "p", "a.pdf", make_pdf(CONTENT)), "*.pdf")
    one = lambda c, *rows: spark.createDataFrame(rows, c)
    known = one("name string", ("txtFullName",), ("txtMailAddress",), ("chkApproved",))
    labels = one("alias string, canonical string", ("email", "txtMailAddress"), ("gone", "txtNope"))
    out = forms.auto_form(pdf.drawn_items(found), known, one("alias string, canonical string", ("txtaddress", "txtFullName")), labels)
    got = {(r.x, r.y): (r.name, r.type, r.matched, r.method) for r in out.collect()}
    assert got[(150.0, 700.0)][:3] == ("txtFullName", "text", True) and got[(100.0, 600.0)][:3] == ("chkApproved", "checkbox", True)
    assert got[(50.0, 500.0)][0] == "txtFullName_duplicate1" and got[(87.0, 197.0)] == ("txtMailAddress", "text", True, "semantic-label-map")
    assert forms.auto_form(pdf.drawn_items(found).limit(0), known, labels, labels).count() == 0
    pairs = forms.dictionary(one("alias string, canonical string", ("a", "txtX")), one("alias string, canonical string", ("A", "txtY"), ("b", "txtB"), ("c", "txtC"), ("c", "txtD")))
    assert sorted(map(tuple, pairs.collect())) == [("a", "txtX"), ("b", "txtB")]


def test_page_replacement_refuses_what_does_not_fit(spark):
    from quillgrid.plans import forms

    xml = '<template><subform name="topmostSubform"><subform name="Page1"><field name="a"/></subform></subform></template>'
    docs = spark.createDataFrame([(1, xml)], "doc_id int, xml string")
    part = lambda page, fragment: spark.createDataFrame([(1, page, fragment)], "doc_id int, page string, xml string")
    done = forms.replaced_pages(docs, part("Page1", '<subform><field name="b"><font typeface="Times"/></field></subform>')).first().xml
    assert 'name="Page1"' in done and 'typeface="Arial"' in done and 'name="a"' not in done
    for bad in (part("Page1", '<subform name="Page2"/>'), part("Page1", "<field/>"), part("Page9", "<subform/>")):
        with pytest.raises(Exception, match="Page"):
            forms.replaced_pages(docs, bad).collect()
