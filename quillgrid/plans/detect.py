"""Detection of form fields: from drawn items to named field specs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.functions import geometry as G
from quillgrid.functions import text as T
from quillgrid.operators import cluster, naming, patterns, spatial


def detect(items: DataFrame, matchers=patterns.DEFAULT_PATTERNS, glyphs=patterns.DEFAULT_GLYPHS) -> DataFrame:
    """(page, name, type, x, y, w, h, label) of the items of pdf.drawn_items() of documents.

    Pages are those of all documents, keyed by path and page. Rectangles with text inside are no inputs; lines
    and squares give way to what they overlap. Each box is typed by its nearest label; labels that end in a
    colon, and checkbox characters, with no box on their line make a field of their own. Coordinates snap to
    their page's grid lines, and names are generated from labels, repeats numbered in reading order.
    """
    keyed = items.withColumn("page", F.concat_ws("#", "path", F.col("page").cast("string")))
    anchors = keyed.where("kind = 'anchor'").select("page", "seq", T.repaired_hebrew(F.col("text")).alias("text"), "x", "y")
    part = lambda k: keyed.where(F.col("kind") == k).select("page", "x", "y", "w", "h").distinct()
    rects, lines, squares = part("rect"), part("line"), part("checkbox")
    lines = spatial.not_overlapping(lines, rects)
    squares = spatial.not_overlapping(spatial.not_overlapping(squares, rects), lines)
    inputs = spatial._minus(rects, spatial.containing(rects, anchors)).unionAll(lines)
    labelled = patterns.classify(spatial.nearest_label(inputs, anchors), matchers, glyphs)
    kind = F.when(F.col("type") == "checkbox", "text").otherwise(F.col("type"))
    boxes = labelled.select("page", "x", "y", "w", F.least("h", F.lit(G.MOST_FIELD_HEIGHT)).alias("h"), "label", kind.alias("type"))
    checks = spatial.nearest_label(squares, anchors).select("page", "x", "y", "w", "h", "label", F.lit("checkbox").alias("type"))
    drawn = boxes.unionAll(checks)
    every = drawn.unionAll(_synthesised(anchors, drawn, matchers, glyphs))
    for c in ("x", "y"):
        snap = cluster.snapped(every, "page", c)
        every = every.join(snap, ["page", c]).drop(c).withColumnRenamed("snapped", c)
    named = naming.generated(every)
    unique = naming.unique_names(named, [F.desc("y"), F.col("x"), F.col("w"), F.col("h")], "underscore", ["page"])
    csv_type = T.mapped(F.col("type"), T.CSV_TYPES, F.lit("text"))
    return unique.select("page", F.col("unique_name").alias("name"), csv_type.alias("type"), "x", "y", "w", "h", "label")


def _synthesised(anchors: DataFrame, boxes: DataFrame, matchers, glyphs) -> DataFrame:
    """Fields for labels that end in a colon and for checkbox characters without a box on their line."""
    text = F.trim("text")
    glyph = F.lit(False)
    for g in glyphs:
        glyph = glyph | text.contains(g)
    free = spatial.without_box_on_line(anchors.where(glyph | text.endswith(":")), boxes).withColumn("glyph", glyph)
    marks = free.where("glyph").select("page", "x", "y", F.lit(12.0).alias("w"), F.lit(12.0).alias("h"), text.alias("label"), F.lit("checkbox").alias("type"))
    named = free.where("not glyph").withColumn("label", F.trim(F.regexp_replace(text, ":+$", "")))
    typed = patterns.classify(named, matchers, glyphs)
    left = F.greatest(F.lit(0.0), F.col("x") - F.col("width") - 4.0)
    x = F.when(T.has_hebrew(F.col("label")), left).otherwise(F.col("x") + F.length(text) * 5.5 + 4.0)
    words = typed.select("page", F.round(x, 2).alias("x"), F.round(F.col("y") - 3.0, 2).alias("y"), F.col("width").alias("w"), F.lit(14.0).alias("h"), "label", "type")
    return marks.unionAll(words)
