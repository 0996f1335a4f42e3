"""Fields among words, on the literal words of forms."""

import pytest
from pyspark.sql import functions as F

from quillgrid.functions import signatures as S
from quillgrid.operators import words as W

WORD = "page long, seq long, page_height double, text string, x0 double, y0 double, x1 double, y1 double"


def words(spark, height, *rows):
    return spark.createDataFrame([(1, i, float(height), t, *map(float, r)) for i, (t, *r) in enumerate(rows)], WORD)


def boxes(spark, *rows):
    return spark.createDataFrame([(1, *map(float, r)) for r in rows], "page long, x double, y double, w double, h double")


def xs(df):
    return sorted(r.x for r in df.collect())


def test_private_glyph_columns_are_checkboxes(spark):
    own = words(spark, 600, *[("", 493.3, y, 500.5, y + 14.7) for y in (70, 110, 150)])
    assert sorted((r.x, r.y, r.w, r.h) for r in W.accepted_checkboxes(own).collect()) == [(493.3, y, 14.7, 14.7) for y in (435.3, 475.3, 515.3)]
    lone = words(spark, 600, ("☐", 10, 10, 22, 22), ("yes", 30, 10, 50, 22), ("☐", 400, 300, 412, 312), ("☐", 10, 500, 40, 512))
    assert xs(W.accepted_checkboxes(lone)) == [10.0]


@pytest.mark.parametrize(
    "label,wanted",
    [("Signature", "ltr"), ("Signature date", "ltr"), ("Date signature", None), ("Sign here please", "ltr"), ("חתימה העמית", "rtl"), ("חותמת החברה", "rtl"), ("אני החתום מטה", None), ("תאריך חתימה", None), ("החתום מטה", "rtl"), ("12", None)],
)
def test_label_direction(spark, label, wanted):
    assert spark.createDataFrame([(label,)], "t string").select(S.label_direction(F.col("t"))).first()[0] == wanted


def test_underline_below_a_reversed_signature_word(spark):
    own = words(spark, 842, ("חוקלה", 443.8, 705.4, 470.8, 717.7), ("תמיתח", 473.8, 705.4, 503.9, 717.7), ("_" * 18, 393.8, 734, 504.3, 738))
    assert [(r.x, r.y, r.w, r.h) for r in W.accepted_underlines(own).collect()] == [(393.8, 104.0, 110.5, 12.0)]
    assert xs(W.near_signature(boxes(spark, (393.8, 97.5, 110.5, 12)), own)) == [393.8]


def test_signature_side_follows_the_script(spark):
    pair = boxes(spark, (100, 700, 120, 12), (320, 700, 120, 12))
    assert xs(W.near_signature(pair, words(spark, 842, ("המיתח", 250, 130, 300, 142)))) == [100.0]
    assert xs(W.near_signature(pair, words(spark, 842, ("Signature", 250, 130, 300, 142)))) == [320.0]
    assert xs(W.near_signature(boxes(spark, (363.2, 545.4, 141.2, 12)), words(spark, 842, ("תמיתח", 473.8, 301.2, 503.9, 313.5)))) == [363.2]


def test_segments_of_a_row_are_judged_apart(spark):
    english = words(spark, 842, ("Signature", 100, 130, 150, 142), ("client", 155, 130, 185, 142), ("Date", 360, 130, 390, 142), ("of", 395, 130, 407, 142), ("signature", 412, 130, 460, 142))
    pair = boxes(spark, (195, 700, 120, 12), (470, 700, 120, 12))
    assert xs(W.near_signature(pair, english)) == [195.0]
    assert {r.x: r.label for r in W.same_line_label(pair, english).collect()} == {195.0: "Signature client", 470.0: "Date of signature"}
    hebrew = words(spark, 842, ("תמיתח", 460, 130, 510, 142), ("חוקל", 425, 130, 455, 142), ("ךיראת", 280, 130, 320, 142), ("המיתח", 235, 130, 275, 142))
    assert xs(W.near_signature(boxes(spark, (320, 700, 120, 12), (100, 700, 110, 12)), hebrew)) == [320.0]


def test_underlines_in_words_and_sentences(spark):
    own = words(spark, 500, ("Name:" + "_" * 20, 100, 100, 225, 112), ("_" * 10, 300, 200, 400, 212), ("_" * 20, 10, 300, 110, 312), ("city", 120, 300, 140, 312), ("_" * 20, 100, 400, 200, 412), (",", 96, 400, 99, 412), ("here", 60, 400, 90, 412), ("lives", 30, 400, 55, 412))
    found = sorted((r.x, r.w) for r in W.accepted_underlines(own).collect())
    assert found == [(10.0, 100.0), (125.0, 100.0)]


def test_contexts_turn_text_into_images(spark):
    spec = "page long, name string, type string, x double, y double, w double, h double, label string"
    specs = spark.createDataFrame([(3, "txtField", "text", 393.8, 97.5, 110.5, 12.0, "15"), (3, "txtAmount", "text", 100.0, 97.5, 110.5, 12.0, "Amount")], spec)
    own = spark.createDataFrame([(3, 1, 842.0, "Signature", 443.0, 705.0, 500.0, 717.0)], WORD)
    out = {r.label: (r["name"], r["type"]) for r in W.signed_fields(specs, W.signature_contexts(own)).collect()}
    assert out == {"15": ("imgField", "image"), "Amount": ("txtAmount", "text")}
