"""Every rule on specs that break it, and only it."""

from quillgrid.operators import rules, widgets

SPEC = "page long, name string, type string, x double, y double, w double, h double"


def specs(spark, *rows):
    return spark.createDataFrame([(p, n, t, float(x), float(y), float(w), float(h)) for p, n, t, x, y, w, h in rows], SPEC)


def codes(df):
    return sorted((r.code, r.field) for r in df.collect())


def test_row_rules(spark):
    own = specs(
        spark,
        (0, "txtA", "text", 0, 0, 50, 20), (1, "txtB", "text", 0, 0, 0, 5), (1, "txtC", "text", 0, 0, 50, 9), (1, "txtD", "textarea", 0, 0, 50, 12),
        (1, "chkE", "checkbox", 0, 0, 40, 12), (1, "imgF", "image", 0, 0, 10, 12), (1, "txtBeneficiary1Name", "text", 0, 0, 50, 15),
        (1, "imgMySignature", "text", 0, 0, 50, 20), (1, "photo", "image", 0, 0, 50, 20), (1, "txtFine", "text", 0, 0, 50, 20),
    )
    assert codes(rules.row_rules(own)) == [
        ("checkbox-size", "chkE"), ("image-name-format", "photo"), ("invalid-page", "txtA"), ("invalid-size", "txtB"), ("signature-format", "imgMySignature"),
        ("small-beneficiary-field", "txtBeneficiary1Name"), ("small-image-field", "imgF"), ("small-text-height", "txtC"), ("small-textarea-height", "txtD"),
    ]


def test_group_rules(spark):
    own = specs(spark, (1, "a", "text", 0, 0, 50, 20), (1, "a", "checkbox", 0, 0, 50, 20), (2, "imgSignature", "image", 0, 0, 50, 20), (3, "imgSignature", "image", 0, 0, 50, 20), (4, "b", "text", 1, 0, 50, 20), (4, "b", "text", 1, 0, 50, 20))
    assert codes(rules.duplicate_rules(own)) == [("duplicate-name", "a"), ("duplicate-name", "b"), ("duplicate-name", "imgSignature"), ("duplicate-name-mixed-types", "a"), ("duplicate-signature-name", "imgSignature")]
    assert codes(rules.cell_rules(own)) == [("duplicate-cell", "a"), ("duplicate-cell", "b")]


def test_beneficiary_tables(spark):
    full = [(1, f"txtBeneficiary{r}{c}", "text", 0, 0, 50, 20) for r in (2, 3, 4) for c in rules.BENEFICIARY_COLUMNS]
    assert rules.beneficiary_rules(specs(spark, *full)).count() == 0
    part = specs(spark, *full[:-1], (1, "txtBeneficiaryXName", "text", 0, 0, 50, 20))
    assert [tuple(r) for r in rules.missing_cells(rules.beneficiary_cells(part)).collect()] == [(1, 4, "BenefitPercent")]
    assert codes(rules.beneficiary_rules(part)) == [("incomplete-beneficiary-row", None), ("incomplete-beneficiary-table", None)]
    two = specs(spark, *full[:12])
    assert codes(rules.beneficiary_rules(two)) == [("incomplete-beneficiary-table", None)]


def test_bounds_and_ink(spark):
    pages = spark.createDataFrame([(1, 100.0, 100.0)], "page long, width double, height double")
    own = specs(spark, (1, "in", "text", 0, 0, 100.5, 20), (1, "out", "text", 0, 0, 100.6, 20), (1, "low", "text", -1, 0, 5, 20), (9, "gone", "text", 0, 0, 5, 5))
    assert codes(rules.bounds_rules(own, pages)) == [("field-out-of-page", "low"), ("field-out-of-page", "out"), ("page-out-of-range", "gone")]
    runs = spark.createDataFrame([(1, r, 12, 30) for r in range(75, 85)], "page long, row long, begin long, end long")
    ink = specs(spark, (1, "over", "text", 10, 10, 30, 20), (1, "clear", "text", 60, 10, 30, 20), (1, "box", "checkbox", 10, 10, 30, 20))
    assert codes(rules.ink_rules(ink, runs, pages)) == [("field-over-original-content", "over")]


def test_widgets_round_trip_and_rules(spark):
    own = specs(spark, (1, "txtA", "text", 0, 0, 50, 20), (1, "txtB", "textarea", 0, 0, 50, 20), (1, "chkC", "checkbox", 0, 0, 12, 12), (1, "imgSignature", "image", 0, 0, 50, 20))
    built = widgets.attributes(own)
    assert {r.name: r.inferred for r in widgets.inferred(built).collect()} == {"txtA": "text", "txtB": "textarea", "chkC": "checkbox", "imgSignature": "image"}
    assert rules.widget_rules(own, built).count() == 0
    from pyspark.sql import functions as F

    broken = built.where("name <> 'txtB'").withColumn("has_bg", F.lit(True)).withColumn("style", F.lit(None).cast("string")).withColumn("appearances", F.array(F.lit("/Off")))
    signed = broken.unionByName(broken.where("name = 'imgSignature'").withColumn("ft", F.lit("/Sig")).withColumn("ff", F.lit(0)))
    assert codes(rules.widget_rules(own, signed)) == [
        ("field-name-count-mismatch", "imgSignature"), ("field-name-count-mismatch", "txtB"), ("pdf-checkbox-appearance", "chkC"), ("pdf-duplicate-name", "imgSignature"),
        ("pdf-field-covers-original-content", "txtA"), ("pdf-image-button-format", "imgSignature"), ("pdf-image-button-format", "imgSignature"), ("pdf-image-signature-format", "imgSignature"), ("pdf-signature-field", "imgSignature"),
    ]
    assert codes(rules.widget_rules(own, built.limit(0))) == [("missing-acroform", None)]
    assert codes(rules.widget_rules(own.where("name = 'txtA'"), built.where("name <> 'chkC'"))) != []


def test_verdict(spark):
    warned = rules.validate(specs(spark, (1, "photo", "image", 0, 0, 50, 20)))
    assert not rules.verdict(warned).first().failed and rules.verdict(warned, strict=True).first().failed
