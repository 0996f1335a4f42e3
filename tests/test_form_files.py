"""Form files are read once, and only as far as they are asked for."""

import itertools

import pyarrow as pa
import pytest

from quillgrid.plans import forms
from quillgrid.sources import batches, pdf, pdf_writer

FLAT = b"%%PDF-1.7\n1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n2 0 obj\n<< /Type /Pages /Kids [3 0 R] /MediaBox [0 0 %d 792] >>\nendobj\n3 0 obj\n<< /Type /Page /Parent 2 0 R >>\nendobj\n"
SPECS = [(1, f"n{i}", k, i, 2.5 * i, 30 + i, 12, v) for i in range(20) for k, v in (("text", "v"), ("textarea", None), ("checkbox", "yes"), ("checkbox", ""), ("image", None))]


def test_objects_are_parsed_when_they_are_asked_for():
    file = pdf.File(pdf_writer.Builder(FLAT % 600).built(SPECS))
    assert file.sizes() == [(1, 600.0, 792.0)] and len(file._held) < 5 < len(file.numbers())


def test_objects_are_found_as_by_pattern():
    data = b"1 0 obj 5 endobj\n2 0 obj x\n12 3 0 obj\n9 endobj 4 0 object 5  0\tobj<<>>endobj6 0 obj 7 0 objx 8 obj 0 8 0obj>>10 0 obj_ 01 0 obj 6 endobj obj 11 0 obj"
    expected = {}
    for m in pdf.re.finditer(rb"(\d+)\s+(\d+)\s+obj\b", data):
        expected[int(m[1])] = m.end()
    assert pdf.File(data)._at == expected and list(pdf.File(data)._at) == list(expected)


def odd(n: int) -> bytes:
    """Widgets of many forms: other numbers, orders, nested keys of the same names, parents, entries elsewhere or none."""
    w = [
        b"<< /Subtype /Widget /T <41%02x> /Rect [%d 2 3.5 -4] /FT /Tx /Ff %d >>" % (n + 32, n, n), b"<< /Subtype /Widget /T <4> /Rect [1 %d 3 4] /FT /Btn >>" % n,
        b"<</FT/Tx/Subtype/Widget/MK<</T <5A> /Rect [9 9 9 9]>>/Rect[%d 2 3 4]/T<42>>>" % n, b"<< /Subtype /Widget /T (a\\)b) /Rect [1 2 3 4] /FT /Tx /Ff 4096 >>",
        b"<< /Subtype /Widget /T <4 1> /Rect [1 2 3 %d] /FT /Tx >>" % n, b"<< /Subtype /Widget /T <41> /Rect 90 0 R /FT /Tx /Ff 91 0 R >>", b"<< /Subtype /Widget /T <41> /Rect [.5 +2 3 4] /FT /Sig >>",
        b"<< /Subtype /Widget /Parent 92 0 R /T <41> /Rect [1 2 3 4] >>", b"<< /Subtype /Widget /T <41> /T <42> /Rect [1 2 3 4] /FT /Tx >>", b"<< /Subtype /Link /T <41> /Rect [1 2 3 4] /FT /Tx >>",
        b"<< /Subtype /Widget /T <FEFF05D0> /Rect [1 2 3 4] /FT /Tx /Ff %d.0 >>" % n, b"<< /Subtype /Widget /Rect [1 2 3 4] /FT /Tx >>", b"<< /Subtype /Widget /T <> % no\n /Rect [1 2 3 4] /FT /Tx >>",
    ]
    rest = b"90 0 obj [5 6 7 8] endobj 91 0 obj 4096 endobj 92 0 obj << /T <50> /FT /Btn /Ff 65536 >> endobj "
    kids = b" ".join(b"%d 0 R" % (10 + i) for i in range(len(w)))
    return (FLAT % 600).replace(b"/Parent 2 0 R", b"/Annots [%s]" % kids) + b"".join(b"%d 0 obj\n%s\nendobj\n" % (10 + i, x) for i, x in enumerate(w)) + rest


def test_shapes_read_widgets_as_tokens_do(monkeypatch):
    files = [odd(n) for n in range(20)] + [pdf_writer.Builder(FLAT % 600).built(SPECS)] * 2
    read = lambda: [[(n, a, k, f, list(r)) for n, a, k, f, r in pdf.File(d).widgets()] for d in files]
    monkeypatch.setattr(pdf, "_SHAPES", [])
    monkeypatch.setattr(pdf, "_tried", itertools.count())
    by_shape = read()
    assert pdf._SHAPES
    monkeypatch.setattr(pdf, "_SHAPES", [])
    monkeypatch.setattr(pdf, "_tried", itertools.count(pdf.MOST_TRIED))
    assert by_shape == read() and not pdf._SHAPES and sum(map(len, by_shape)) == 20 * 12 + 2 * len(SPECS)


def test_groups_go_on_over_batches():
    rows = [(k, b"%d" % n, n + 1) for k, size in (("a", 3), ("b", 1), ("c", 7)) for n in range(size)]
    made = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[i : i + 2])], names=["k", "v", "n"]) for i in range(0, len(rows), 2)]
    assert [(k[0], len(k), v[-1]) for k, v in batches.groups(iter(made))] == [("a", 3, b"2"), ("b", 1, b"0"), ("c", 7, b"6")]


@pytest.fixture
def files(spark):
    table = lambda *rows: spark.createDataFrame(rows, "path string, content binary")
    fillable = lambda width: bytes(pdf_writer.Builder(FLAT % width).built(SPECS))
    template = table(("same", fillable(600)), ("wide", fillable(600)), ("near", fillable(600)), ("gone", fillable(600)), ("none", fillable(600)), ("text", b"hello"), (None, fillable(600)))
    return template, table(("same", FLAT % 600), ("wide", FLAT % 610), ("near", FLAT % 602), ("new", FLAT % 600), ("none", b"hello"), ("text", b"hello"), (None, FLAT % 600))


def test_transfer_reads_each_file_once(files):
    out, wrong = forms.transferred(*files)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")
    assert plan(out) == 2  # the templates, then the groups of a path
    got = forms.extracted(out)
    assert sorted(r["path"] for r in got.groupBy("path").count().where(f"count = {len(SPECS)}").collect()) == ["near", "same"] and got.count() == 2 * len(SPECS)


def test_mismatches_read_each_file_once(files):
    wrong = forms.transferred(*files)[1]
    assert wrong._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 3  # templates, targets and paths
    assert sorted(map(tuple, wrong.collect())) == [("new", 1, "page-count"), ("none", 1, "page-count"), ("wide", 1, "page-size")]
