"""Fields found among positioned words: underscore runs, checkbox characters, labels beside them, signatures.

Words are (page, seq, page_height, text, x0, y0, x1, y1), origin at the page's top left; boxes have theirs at the
bottom left. Joins are on the page and bands of its height.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.functions import geometry as G
from quillgrid.functions import signatures as S
from quillgrid.functions import text as T
from quillgrid.operators import cluster, spatial

# Characters drawn as checkboxes, by their font or as symbols.
CHECKBOX_GLYPHS = ("□", "☐", "▢", "◻", "▫", "☑", "☒")
PRIVATE_GLYPHS = ("",)
BOX = ("page", "x", "y", "w", "h")


def underline_boxes(words: DataFrame) -> DataFrame:
    """(page, seq, x, y, w, h) of each word's longest underscore run of eight or more, in its share of the width."""
    size = F.greatest(F.length("text"), F.lit(1))
    run = T.longest_run(F.col("text"))
    wide = (F.col("x1") - F.col("x0")) / size
    at = F.expr("locate(repeat('_', run), text)") - 1
    own = words.withColumn("run", run.cast("int")).where("run >= 8")
    box = own.select("page", "seq", F.round(F.col("x0") + at * wide, 1).alias("x"), F.round(F.col("page_height") - F.col("y1"), 1).alias("y"), (F.col("run") * wide).alias("w"), F.lit(G.UNDERLINE_HEIGHT).alias("h"))
    return box.where(F.col("w") >= G.LEAST_BOX_WIDTH).withColumn("w", F.round("w", 1))


def checkbox_boxes(words: DataFrame) -> DataFrame:
    """P5: (page, seq, x, y, w, h) of words that are a checkbox character of checkbox size."""
    text, w, h = F.trim("text"), F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    private = text.isin(*PRIVATE_GLYPHS) & w.between(6, 20) & h.between(10, 20)
    shown = text.isin(*CHECKBOX_GLYPHS) & w.between(10, 20) & h.between(10, 20) & (F.abs(w - h) / F.greatest(w, h) <= 0.35)
    own = words.where(private | shown)
    side = lambda s: F.round(F.when(text.isin(*PRIVATE_GLYPHS), F.greatest(w, h)).otherwise(s), 1)
    return own.select("page", "seq", F.round("x0", 1).alias("x"), F.round(F.col("page_height") - F.col("y1"), 1).alias("y"), side(w).alias("w"), side(h).alias("h"))


def accepted_checkboxes(words: DataFrame) -> DataFrame:
    """Checkboxes with a label within 260 points of their line, or in a group; overlaps keep the first."""
    boxes = checkbox_boxes(words)
    near = spatial.same_line_words(words, 260)
    labels = near.where((T.effective_length(F.col("b.text")) > 0) & ~F.trim(F.col("b.text")).isin(*CHECKBOX_GLYPHS))
    labelled = boxes.join(labels.select(F.col("a.page").alias("page"), F.col("a.seq").alias("seq")).distinct(), ["page", "seq"], "left_semi")
    kept = labelled.unionAll(spatial.grouped_checkboxes(boxes)).distinct()
    return cluster.greedy_kept(kept, G.overlaps, ["seq"])


def _same_line(box: DataFrame, words: DataFrame) -> DataFrame:
    """Boxes with each word of their line: no fill lines, two points of height in common."""
    own = words.where(~F.col("text").contains("_") & (T.effective_length(F.col("text")) > 0))
    low, high = F.col("a.page_height") - F.col("a.y") - F.col("a.h"), F.col("a.page_height") - F.col("a.y")
    heights = words.groupBy("page").agg(F.max("page_height").alias("page_height"))
    sized = box.join(heights, "page")
    shared = F.least(high, F.col("b.y1")) - F.greatest(low, F.col("b.y0"))
    return sized.alias("a").join(own.alias("b"), (F.col("a.page") == F.col("b.page")) & (shared >= 2))


def side_labels(boxes: DataFrame, words: DataFrame) -> DataFrame:
    """`boxes` with `left_label` and `right_label`: their line's words walked outward until a gap is too wide.

    To the right a word may reach 20 points into the box, to the left two; words to the right are read from
    the right, as right-to-left labels are.
    """
    keys = list(boxes.columns)
    met = _same_line(boxes, words)
    base = [F.col(f"a.{k}") for k in keys]
    left = met.where(F.col("b.x1") <= F.col("a.x") + 2).select(*base, F.col("a.x").alias("edge"), F.col("b.x0").alias("x0"), F.col("b.x1").alias("x1"), "b.text")
    right_edge = F.col("a.x") + F.col("a.w")
    # mirrored, so that the same walk applies; its words come in falling order of place, as wanted
    right = met.where(F.col("b.x0") >= right_edge - 20).select(*base, (-right_edge).alias("edge"), (-F.col("b.x1")).alias("x0"), (-F.col("b.x0")).alias("x1"), "b.text")
    lefts = cluster.walked_labels(left, keys, 2).withColumnRenamed("label", "left_label")
    rights = cluster.walked_labels(right, keys, 20).withColumnRenamed("label", "right_label")
    out = boxes.join(lefts, keys, "left").join(rights, keys, "left")
    return out.fillna("", ["left_label", "right_label"])


def same_line_label(boxes: DataFrame, words: DataFrame) -> DataFrame:
    """`boxes` with `label`: a signature label to the left, else the right one, else the left one."""
    sides = side_labels(boxes, words)
    signed = S.label_direction(F.col("left_label")) == "ltr"
    label = F.when(F.coalesce(signed, F.lit(False)), F.col("left_label")).when(F.col("right_label") != "", F.col("right_label")).otherwise(F.col("left_label"))
    return sides.withColumn("label", label).drop("left_label", "right_label")


def near_signature(boxes: DataFrame, words: DataFrame) -> DataFrame:
    """Boxes that a signature label points at on their line, or, without a label there, that a signature
    word on another line is within 45 points of."""
    keys = list(boxes.columns)
    sides = side_labels(boxes, words)
    left = F.coalesce(S.label_direction(F.col("left_label")) == "ltr", F.lit(False))
    right = F.coalesce(S.label_direction(F.col("right_label")) == "rtl", F.lit(False))
    on_line = sides.where(left | right).select(*keys)
    bare = sides.where("left_label = '' and right_label = ''").select(*keys)
    own = words.where(~F.col("text").contains("_") & S.word_direction(F.col("text")).isNotNull())
    a, top = G.Box("a"), F.col("b.page_height") - F.col("a.y") - F.col("a.h")
    bottom = F.col("b.page_height") - F.col("a.y")
    shared = F.least(bottom, F.col("b.y1")) - F.greatest(top, F.col("b.y0"))
    gap = F.greatest(G.gap(a.x, a.right, F.col("b.x0"), F.col("b.x1")), G.gap(top, bottom, F.col("b.y0"), F.col("b.y1")))
    other = bare.alias("a").join(own.alias("b"), (a.page == F.col("b.page")) & (shared < 2) & (gap <= 45), "left_semi")
    return on_line.unionAll(other).distinct()


def accepted_underlines(words: DataFrame) -> DataFrame:
    """Underscore runs that are fields: with text in their own word, near a signature, or with a word of
    their line within 220 points; runs printed inside a sentence, after its comma, are none."""
    boxes = underline_boxes(words)
    text = words.select("page", "seq", F.regexp_replace("text", "_+", "").alias("rest"))
    own = boxes.join(text, ["page", "seq"]).where(T.effective_length(F.col("rest")) > 0).select(*boxes.columns)
    rest = boxes.join(own, boxes.columns, "left_anti").join(_inline(words), ["page", "seq"], "left_anti").select(*boxes.columns)
    signed = rest.join(near_signature(rest.select(*BOX), words), list(BOX), "left_semi").select(*boxes.columns)
    pairs = spatial.same_line_words(words, 10_000).where(~F.col("b.text").contains("_") & (T.effective_length(F.col("b.text")) > 0))
    beside = pairs.select(F.col("a.page").alias("page"), F.col("a.seq").alias("seq"), F.col("b.x0").alias("l"), F.col("b.x1").alias("r"))
    gap = G.gap(F.col("x"), F.col("x") + F.col("w"), F.col("l"), F.col("r"))
    labelled = rest.join(beside, ["page", "seq"]).where(gap <= 220).select(*boxes.columns)
    kept = own.unionAll(signed).unionAll(labelled).distinct()
    return cluster.greedy_kept(kept, G.overlaps, ["seq"])


def _inline(words: DataFrame) -> DataFrame:
    """(page, seq) of fill lines right after a comma or semicolon with two words within 130 points before it."""
    met = spatial.same_line_words(words, 10_000).where(F.col("a.text").contains("_") & ~F.col("b.text").contains("_") & (F.col("b.x1") <= F.col("a.x0") + 2))
    item = F.struct((-F.col("b.x1")).alias("far"), F.col("b.seq").alias("seq"), F.trim(F.col("b.text")).alias("text"), (F.col("a.x0") - F.col("b.x1")).alias("gap"), T.effective_length(F.col("b.text")).alias("n"))
    lines = met.groupBy(F.col("a.page").alias("page"), F.col("a.seq").alias("seq")).agg(F.array_sort(F.collect_list(item)).alias("left"))  # one line's words
    first = F.col("left")[0]
    before = F.size(F.filter(F.slice("left", 2, 10_000), lambda w: (w["gap"] <= 130) & (w["n"] > 0)))
    return lines.where((first["gap"] <= 3) & first["text"].isin(",", ";") & (before >= 2)).select("page", "seq")


def signature_contexts(words: DataFrame) -> DataFrame:
    """P10: (cid, page, x0, x1, y, direction) of the words that speak of a signature."""
    way = S.context_direction(F.col("text"))
    return words.where(way.isNotNull()).select(F.col("seq").alias("cid"), "page", "x0", "x1", (F.col("page_height") - F.col("y1")).alias("y"), way.alias("direction"))


def signed_fields(specs: DataFrame, contexts: DataFrame) -> DataFrame:
    """`specs` (with label) with the text fields that contexts speak of as images, their names' prefix changed."""
    rows = spatial.context_rows(specs, contexts).where(S.may_become_image(F.col("label")))
    targets = rows.select("page", "x", "y", "name").distinct().withColumn("signed", F.lit(True))
    joined = specs.join(targets, ["page", "x", "y", "name"], "left")
    now = F.coalesce("signed", F.lit(False)) & (F.col("type") == "text")
    name = F.when(F.col("name").startswith("txt"), F.regexp_replace("name", "^txt", "img")).otherwise(F.concat(F.lit("img"), "name"))
    out = joined.withColumn("name", F.when(now, name).otherwise(F.col("name"))).withColumn("type", F.when(now, "image").otherwise(F.col("type")))
    return out.select(*specs.columns)

