"""Label patterns: a label's field type and width by the first pattern that it matches."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The default patterns in order, and the characters drawn as checkboxes.
DEFAULT_PATTERNS = (
    (r"signature|sign here|חתימה|חתימת", "signature", 180.0),
    (r"\bdate\b|תאריך", "date", 80.0),
    (r"\baddress\b|כתובת", "text", 240.0),
    (r"\bphone\b|\bfax\b|טלפון|נייד|פקס", "text", 120.0),
    (r"\be-?mail\b|דוא\"ל|דואל|מייל", "text", 180.0),
    (r"\bid\b|ת\.?ז\.?|תעודת זהות|ח\.?פ\.?", "text", 100.0),
    (r"account|מספר חשבון", "text", 140.0),
    (r"amount|סכום", "text", 100.0),
)
DEFAULT_GLYPHS = ("☐", "□", "◻")
DEFAULT_WIDTH, GLYPH_WIDTH = 150.0, 12.0


def load(text: str | None) -> tuple[tuple, tuple]:
    """Patterns and glyphs of a JSON document, its own patterns before the defaults."""
    data = json.loads(text) if text else {}
    own = data.get("patterns", [])
    if not isinstance(own, list):
        raise ValueError("patterns must be a list")
    rows = tuple((str(r["match"]), str(r.get("type", "text")), float(r.get("width", DEFAULT_WIDTH))) for r in own)
    return rows + DEFAULT_PATTERNS, tuple(dict.fromkeys((*DEFAULT_GLYPHS, *data.get("checkbox_glyphs", []))))


def classify(labels: DataFrame, patterns=DEFAULT_PATTERNS, glyphs=DEFAULT_GLYPHS) -> DataFrame:
    """`labels` with `type` and `width`; a glyph first, then patterns in order, then plain text."""
    label = F.col("label")
    glyph: Column = F.lit(False)
    for g in glyphs:
        glyph = glyph | label.contains(g)
    kind = F.when(glyph, F.struct(F.lit("checkbox").alias("type"), F.lit(GLYPH_WIDTH).alias("width")))
    for match, type_, width in patterns:
        kind = kind.when(label.rlike(f"(?iU){match}"), F.struct(F.lit(type_).alias("type"), F.lit(width).alias("width")))
    found = kind.otherwise(F.struct(F.lit("text").alias("type"), F.lit(DEFAULT_WIDTH).alias("width")))
    return labels.withColumn("found", found).select(*labels.columns, "found.type", "found.width")
