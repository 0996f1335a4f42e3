"""Names, labels, lookups and patterns."""

import pytest
from pyspark.sql import functions as F

from quillgrid.functions import text as T
from quillgrid.operators import naming, patterns, reports, resolve


def names(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "name string")


def value(spark, f, *texts):
    return [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(f(F.col("t"))).collect()]


def test_cascade(spark):
    known = resolve.merged_names([("code", names(spark, "txtName", "chkYes")), ("examples", names(spark, "TXTNAME", "imgSign"))])
    out = {r.original_name: (r.canonical_name, r.method) for r in resolve.first_match(names(spark, "txtname", "form.a.chkYes[0]", "form.imgSign_DUPLICATED_2", "p.txtName_3", "zzz"), known, resolve.long_cascade, "code").collect()}
    assert out == {
        "txtname": ("txtName", "exact"), "form.a.chkYes[0]": ("chkYes", "path-last-segment-strip-indexes"), "form.imgSign_DUPLICATED_2": ("imgSign", "strip-duplicated-suffix:examples"),
        "p.txtName_3": ("txtName", "strip-number-suffix"), "zzz": ("zzz", "unmatched"),
    }
    short = resolve.first_match(names(spark, "a.b[2].chkYes_7"), known).first()
    assert (short.canonical_name, short.method) == ("chkYes", "strip-number-suffix")


def test_unambiguous_aliases(spark):
    pairs = spark.createDataFrame([("Old", "a"), ("old", "a"), ("Two", "a"), ("two", "b"), ("", "c")], "alias string, canonical string")
    assert [tuple(r) for r in resolve.unambiguous(pairs).collect()] == [("old", "a")]


def test_token_match_needs_a_lead(spark):
    known = names(spark, "txtPersonFullName", "txtCommitmentAmount", "txtCommitmentAmountUsd", "chkApproved")
    labels = spark.createDataFrame([("Person full name",), ("Commitment amount",), ("Approved",), ("person",)], "label string")
    out = {r.label: r.name for r in resolve.token_match(labels, known).collect()}
    assert out == {"Person full name": "txtPersonFullName", "Approved": "chkApproved", "Commitment amount": "txtCommitmentAmount"}
    close = names(spark, "txtCommitmentAmountA1", "txtCommitmentAmountB2")
    assert resolve.token_match(labels.where("label = 'Commitment amount'"), close).count() == 0


def test_resolver_takes_prefixes_and_label_maps(spark):
    fields = spark.createDataFrame([("txtName", "text", ""), ("chkName", "checkbox", "Name"), ("imgField", "image", "חתימה"), ("txtField", "text", "המייל"), ("txtQ", "text", "Q")], "name string, type string, label string")
    known = names(spark, "txtName", "imgPersonSignature", "txtEmail")
    aliases = spark.createDataFrame([("oldName", "txtName")], "alias string, canonical string")
    labels = spark.createDataFrame([("חתימה", "imgPersonSignature"), ("מייל", "txtEmail")], "alias string, canonical string")
    out = {r["name"]: (r.resolved, r.method) for r in resolve.resolved(fields, known, aliases, labels).collect()}
    assert out == {"txtName": ("txtName", "exact"), "chkName": ("chkName", "unmatched"), "imgField": ("imgPersonSignature", "semantic-label-map"), "txtField": ("txtEmail", "semantic-label-map"), "txtQ": ("txtQ", "unmatched")}


def test_label_keys(spark):
    assert value(spark, T.label_keys, "Full  Name:", "המייל", "") == [["full name"], ["המייל", "מייל", "ליימה", "יימה"], []]


@pytest.mark.parametrize(
    "label,kind,name",
    [("Full name:", "text", "txtFullName"), ("שם מלא", "text", "txtFullName"), ("תז", "text", "txtIdNumber"), ("חתימה", "signature", "imgSignature"), ("שלום", "text", "txtShlvm"), ("***", "checkbox", "chkField"), ("", "date", "dtField"), ("x" * 50, "text", "txtX" + "x" * 31)],
)
def test_generated_names(spark, label, kind, name):
    out = naming.generated(spark.createDataFrame([(label, kind)], "label string, type string"))
    assert out.first().name == name


def test_unique_names(spark):
    own = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "a")], "seq long, name string")
    got = lambda d: [r.unique_name for r in naming.unique_names(own, [F.col("seq")], d).orderBy("seq").collect()]
    assert got("underscore") == ["a", "a_1", "b", "a_2"]
    assert got("number") == ["a", "a2", "b", "a3"]
    assert got("duplicate") == ["a", "a_duplicate1", "b", "a_duplicate2"]


def test_patterns(spark):
    own, glyphs = patterns.load('{"patterns": [{"match": "tax no", "type": "text", "width": 99}, {"match": "date", "type": "special"}], "checkbox_glyphs": ["▢"]}')
    labels = spark.createDataFrame([("Tax No",), ("Update",), ("תאריך לידה",), ("▢ yes",), ("plain",), ("E-Mail",)], "label string")
    out = {r.label: (r.type, r.width) for r in patterns.classify(labels, own, glyphs).collect()}
    assert out == {"Tax No": ("text", 99), "Update": ("special", 150), "תאריך לידה": ("date", 80), "▢ yes": ("checkbox", 12), "plain": ("text", 150), "E-Mail": ("text", 180)}
    default = {r.label: r.type for r in patterns.classify(labels).collect()}
    assert default["Update"] == "text" and default["▢ yes"] == "text"
    with pytest.raises(ValueError):
        patterns.load('{"patterns": 3}')


def test_text_functions(spark):
    assert value(spark, T.is_fill_line, "Name ________", "_______", "a" * 30 + "_" * 10, "________") == [True, False, False, True]
    assert value(spark, T.looks_like_text, "Name", "a", "ab12345", "aaaaaaaaab", "שם") == [True, False, False, False, True]
    assert value(spark, T.is_readable, "ok", "\x01a", "--", "é1") == [True, False, False, True]
    assert value(spark, T.repaired_hebrew, "éà", "é", "abc") == ["יא", "é", "abc"]
    assert value(spark, T.column_index, "A1", "Z9", "AA3", "BC12", "7") == [0, 25, 26, 54, 0]
    assert value(spark, T.title_slug, "o'neil 2nd", "full name") == ["ONeil2Nd", "FullName"]
    assert value(spark, T.html_unescaped, "&lt;a&gt; &amp;lt;") == ["<a> &lt;"]
    assert value(spark, T.tokens, "A bc BC d1-x") == [["bc", "d1"]]


def test_reports(spark):
    items = spark.createDataFrame([(1, "word", "Commitment amount", 10.0, 20.0, None, 5.0)], "page long, item_type string, text string, x double, y double, w double, h double")
    row = reports.layout_rows(items, names(spark, "txtCommitmentAmount", "txtOther")).first()
    assert (row.x, row.w, row.suggested_names) == ("10.00", "", "txtCommitmentAmount")
    assert "1 of 2" in reports.match_rate(spark.createDataFrame([(True,), (False,)], "matched boolean")).first().message
