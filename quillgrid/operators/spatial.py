"""Spatial joins of boxes and text anchors on a page.

Boxes are (page, x, y, w, h, ...) and anchors (page, text, x, y, ...). Every join is an equi-join on the page
and a grid cell with the exact predicate on top, so its cost follows the boxes that are near each other and
one crowded page is spread over its cells. The nearest label alone looks at a whole page.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgrid.functions import geometry as G
from quillgrid.functions import text as T
from quillgrid.functions.geometry import Box
from quillgrid.operators.materialise import written

BOX = ("page", "x", "y", "w", "h")
#: Side of a grid cell, and height of a band, in points.
CELL, BAND = 64, 128


def _cells(df: DataFrame, left: Column, right: Column, low: Column, high: Column) -> DataFrame:
    span = lambda a, b: F.explode(F.sequence(F.floor(a / CELL), F.floor(F.greatest(a, b) / CELL)))
    return df.withColumn("gx", span(left, right)).withColumn("gy", span(low, high))


def _boxes_in_cells(boxes: DataFrame, dx: float = 0, up: float = 0, down: float = 0) -> DataFrame:
    b = Box()
    return _cells(boxes, b.x - dx, b.right + dx, b.y - down, b.top + up)


def _points_in_cells(points: DataFrame) -> DataFrame:
    return points.withColumn("gx", F.floor(F.col("x") / CELL)).withColumn("gy", F.floor(F.col("y") / CELL))


def _same_cell() -> Column:
    return reduce(Column.__and__, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("page", "gx", "gy")])


def _keys(alias: str, columns: list[str]) -> list[Column]:
    return [F.col(f"{alias}.{c}") for c in columns]


def overlapping_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a.*, b.* as structs) of boxes that overlap; each pair once."""
    a = _boxes_in_cells(left.distinct()).alias("a")
    b = _boxes_in_cells(right.distinct()).alias("b")
    # of the cells that a pair shares, the one of the lower left corner of what they share
    corner = [F.floor(F.greatest(F.col(f"a.{c}"), F.col(f"b.{c}")) / CELL) == F.col(f"a.g{c}") for c in "xy"]
    met = a.join(b, _same_cell() & G.overlaps(Box("a"), Box("b")) & corner[0] & corner[1])
    return met.select(F.struct(*_keys("a", left.columns)).alias("a"), F.struct(*_keys("b", right.columns)).alias("b"))


def _matched(boxes: DataFrame, cells: DataFrame, others: DataFrame, test: Column) -> DataFrame:
    """Distinct rows of `boxes` that have a partner in `others` (in cells) under the test."""
    met = cells.alias("a").join(others.alias("b"), _same_cell() & test, "left_semi")
    return met.select(*boxes.columns).distinct()


def not_overlapping(boxes: DataFrame, others: DataFrame) -> DataFrame:
    """Boxes that overlap none of the others."""
    hit = _matched(boxes, _boxes_in_cells(boxes), _boxes_in_cells(others), G.overlaps(Box("a"), Box("b")))
    return _minus(boxes, hit)


def _minus(df: DataFrame, gone: DataFrame) -> DataFrame:
    same = reduce(Column.__and__, [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in df.columns])
    return df.alias("l").join(gone.alias("r"), same, "left_anti")


def containing(boxes: DataFrame, anchors: DataFrame, inset: float = 0) -> DataFrame:
    """Boxes with an anchor inside."""
    test = G.contains(Box("a"), F.col("b.x"), F.col("b.y"), inset)
    return _matched(boxes, _boxes_in_cells(boxes), _points_in_cells(anchors), test)


def nearest_label(boxes: DataFrame, anchors: DataFrame) -> DataFrame:
    """`boxes` with `label`, the best anchor's text, "" if there is none.

    An anchor up to 28 points below and within 10 of the box's sides scores its gap; others that aren't well
    below score their distances; both add a tenth of their distance from the box's middle. Of equal scores
    the anchor with the smallest seq wins.
    """
    a, ax, ay = Box("a"), F.col("b.x"), F.col("b.y")
    off = F.abs(ax - (a.x + a.w / 2)) * 0.1
    below = a.y - ay
    under = (below > 0) & (below <= 28) & ax.between(a.x - 10, a.right + 10)
    dx, dy = F.greatest(a.x - ax, ax - a.right, F.lit(0)), ay - a.top
    score = F.when(under, below + off).when(dy >= -a.h, dx + F.abs(dy) + off)
    named = anchors.where(T.is_readable(F.col("text")) & ~T.is_section_number(F.col("text")))
    keys = _keys("a", boxes.columns)
    met = boxes.distinct().alias("a").join(named.alias("b"), F.col("a.page") == F.col("b.page"), "left")
    best = met.groupBy(*keys).agg(F.min(F.when(score.isNotNull(), F.struct(score.alias("score"), F.col("b.seq"), F.col("b.text")))).alias("best"))
    return best.withColumn("label", F.coalesce("best.text", F.lit(""))).drop("best")


def _labelled(boxes: DataFrame, cells: DataFrame, anchors: DataFrame, test: Column, longest: int) -> DataFrame:
    """Boxes with one to three matching labels within 5 points of height and 2 to `longest` characters in all."""
    named = anchors.where((T.effective_length(F.col("text")) > 0) & ~T.is_section_number(F.col("text")))
    met = cells.alias("a").join(_points_in_cells(named).alias("b"), _same_cell() & test)
    y, size = F.col("b.y"), T.effective_length(F.col("b.text"))
    found = met.groupBy(*_keys("a", boxes.columns)).agg(F.count(F.lit(1)).alias("n"), (F.max(y) - F.min(y)).alias("span"), F.sum(size).alias("size"))
    return found.where((F.col("n") <= 3) & (F.col("span") <= 5) & F.col("size").between(2, longest)).select(*boxes.columns)


def _below(a: Box) -> Column:
    ax, ay = F.col("b.x"), F.col("b.y")
    return ax.between(a.x - 10, a.right + 10) & (ay >= a.y - 28) & (ay < a.y)


def _beside(a: Box) -> Column:
    ax, ay = F.col("b.x"), F.col("b.y")
    upper = F.when((a.h <= G.UNDERLINE_HEIGHT) & (a.w > 220), F.lit(8.0)).otherwise(a.h + 12)
    return ay.between(a.y - 10, a.y + upper) & ((a.x - ax).between(0, 180) | (ax - a.right).between(0, 180))


def _above(a: Box) -> Column:
    ax, ay = F.col("b.x"), F.col("b.y")
    return (ay - a.top > 0) & (ay - a.top <= 12) & ax.between(a.x - 10, a.right + 10)


def with_label_below(boxes: DataFrame, anchors: DataFrame) -> DataFrame:
    """Boxes with a short label right under them."""
    return _labelled(boxes, _boxes_in_cells(boxes.distinct(), 10, 0, 28), anchors, _below(Box("a")), 80)


def with_label_beside(boxes: DataFrame, anchors: DataFrame) -> DataFrame:
    """Boxes with a short label beside them, up to 180 points off."""
    return _labelled(boxes, _boxes_in_cells(boxes.distinct(), 180, 12, 10), anchors, _beside(Box("a")), 40)


def with_conflict(boxes: DataFrame, anchors: DataFrame) -> DataFrame:
    """Boxes with text inside, or with text under them that is no short label."""
    return _label_finds(boxes, anchors).where(F.col("inside") | (F.col("under") & ~F.col("below"))).select(*boxes.columns)


def with_label(boxes: DataFrame, anchors: DataFrame) -> DataFrame:
    """Boxes of with_label_below() or with_label_beside(), from one join."""
    return _label_finds(boxes, anchors).where(F.col("below") | F.col("beside")).select(*boxes.columns)


def row_peers(boxes: DataFrame) -> DataFrame:
    """`boxes` with `peers`, the narrow boxes of the same row and height, themselves included."""
    narrow = boxes.distinct().where("w <= 220")
    a, b = Box("a"), Box("b")
    test = (F.abs(a.y - b.y) <= 2) & (F.abs(a.h - b.h) <= 3)
    met = _bands(narrow, "y", 2).alias("a").join(_bands(narrow, "y", 0).alias("b"), (F.col("a.page") == F.col("b.page")) & (F.col("a.band") == F.col("b.band")) & test)
    return met.groupBy(*_keys("a", boxes.columns)).agg(F.count(F.lit(1)).alias("peers"))


def column_cells(boxes: DataFrame) -> DataFrame:
    """`boxes` with `cells`, the boxes of the same column, width and height, themselves included."""
    own = boxes.distinct()
    a, b = Box("a"), Box("b")
    test = (F.abs(a.x - b.x) <= 2) & (F.abs(a.w - b.w) <= 3) & (F.abs(a.h - b.h) <= 6)
    met = _bands(own, "x", 2).alias("a").join(_bands(own, "x", 0).alias("b"), (F.col("a.page") == F.col("b.page")) & (F.col("a.band") == F.col("b.band")) & test)
    return met.groupBy(*_keys("a", boxes.columns)).agg(F.count(F.lit(1)).alias("cells"))


def _bands(df: DataFrame, column: str, reach: float) -> DataFrame:
    at = F.col(column)
    return df.withColumn("band", F.explode(F.array_distinct(F.array(F.floor((at - reach) / 16), F.floor((at + reach) / 16)))))


def stacked_lines(boxes: DataFrame, anchors: DataFrame) -> DataFrame:
    """Long flat boxes in a column of such, 8 to 24 points apart and within 80, with a label over the top one."""
    flat = boxes.distinct().where((F.col("h") <= G.UNDERLINE_HEIGHT) & (F.col("w") >= 180))
    a, b = Box("a"), Box("b")
    met = flat.alias("a").join(flat.alias("b"), (a.page == b.page) & (F.abs(a.x - b.x) <= 8) & (F.abs(a.w - b.w) <= 12))
    ys = met.groupBy(*_keys("a", boxes.columns)).agg(F.array_sort(F.collect_list(b.y)).alias("ys"))  # one column of a page
    gaps = F.transform(F.sequence(F.lit(1), F.size("ys") - 1), lambda i: F.get("ys", i) - F.get("ys", i - 1))
    stacked = ys.where(F.size("ys") >= 2).where((F.array_max("ys") - F.array_min("ys") <= 80) & F.exists(gaps, lambda g: g.between(8, 24)))
    tops = stacked.withColumn("top", F.array_max("ys"))
    named = anchors.where((T.effective_length(F.col("text")) > 0) & ~T.is_section_number(F.col("text")))
    ax, ay, top = F.col("b.x"), F.col("b.y"), F.col("a.top")
    over = ax.between(a.x - 40, a.right + 40) & (ay > top) & (ay <= top + 40)
    return tops.alias("a").join(named.alias("b"), (F.col("a.page") == F.col("b.page")) & over, "left_semi").select(*boxes.columns)


def with_label_above(boxes: DataFrame, anchors: DataFrame) -> DataFrame:
    """Small boxes with a label within 12 points above."""
    small = boxes.distinct().where("w <= 180 and h <= 20")
    named = anchors.where((T.effective_length(F.col("text")) > 0) & ~T.is_section_number(F.col("text")))
    return _matched(boxes, _boxes_in_cells(small, 10, 12, 0), _points_in_cells(named), _above(Box("a")))


def _label_finds(boxes: DataFrame, anchors: DataFrame) -> DataFrame:
    """Distinct `boxes` that have anchors near them, with inside, under, below, beside and above: what these say of them.

    Boxes and anchors meet under the page and a band of its height, as reaches are wide and low: a box has one or two
    bands, where it would have ten cells.
    """
    a, x, y = Box("a"), F.col("b.x"), F.col("b.y")
    band = lambda c: F.floor(c / BAND)
    b = Box()
    size = T.effective_length(F.col("text"))
    own = boxes.distinct().withColumn("band", F.explode(F.sequence(band(b.y - 28), band(F.greatest(b.y + 8, b.top + 12))))).alias("a")
    points = anchors.select("page", "x", "y", size.alias("size"), ((size > 0) & ~T.is_section_number(F.col("text"))).alias("named"), band(F.col("y")).alias("band")).alias("b")
    inside = x.between(a.x + 2, a.right - 2) & y.between(a.y + 2, a.top - 2)
    below, beside, above = _below(a), _beside(a), _above(a) & (a.w <= 180) & (a.h <= 20)
    met = own.join(points, (F.col("a.page") == F.col("b.page")) & (F.col("a.band") == F.col("b.band")) & (inside | below | beside | above))
    named = F.col("b.named")

    def short(test: Column, longest: int) -> Column:
        of = lambda c: F.when(test & named, c)
        return F.coalesce(F.count_if(test & named).between(1, 3) & (F.max(of(y)) - F.min(of(y)) <= 5) & F.sum(of(F.col("b.size"))).between(2, longest), F.lit(False))

    some = lambda test: F.coalesce(F.max(test), F.lit(False))
    return met.groupBy(*_keys("a", boxes.columns)).agg(
        some(inside).alias("inside"), some(below & (F.col("b.size") > 0)).alias("under"), short(below, 80).alias("below"), short(beside, 40).alias("beside"), some(above & named).alias("above"),
    )


def label_facts(boxes: DataFrame, anchors: DataFrame) -> DataFrame:
    """Distinct `boxes` with conflict, labelled and above: with_conflict(), with_label_beside() or
    with_label_below(), and with_label_above(), all from one join with the anchors near a box."""
    own, found = boxes.distinct().alias("a"), _label_finds(boxes, anchors).alias("b")
    same = reduce(Column.__and__, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in boxes.columns])
    flag = lambda c: F.coalesce(c, F.lit(False))
    c = lambda n: F.col(f"b.{n}")
    conflict = flag(c("inside") | (c("under") & ~c("below")))
    return own.join(found, same, "left").select(*_keys("a", boxes.columns), conflict.alias("conflict"), flag(c("below") | c("beside")).alias("labelled"), flag(c("above")).alias("above"))


def fillable(boxes: DataFrame, anchors: DataFrame) -> DataFrame:
    """Boxes accepted as blank inputs, with the `stage` that accepted them.

    direct: labelled beside or below. stacked: of a stack of lines. peer: a direct box in a row of two or
    three. above: labelled above. table: of a blank column of three beside a cell with text. Row separators
    and boxes with conflicting text are never accepted; near-duplicates are left to greedy_dedupe.
    """
    facts = written(label_facts(boxes, anchors))
    own, columns = facts.select(*boxes.columns), boxes.columns
    conflict, free = facts.where("conflict").select(*columns), facts.where("not conflict")
    blank = free.where(~G.is_row_separator(Box()))
    labelled, above = blank.where("labelled").select(*columns), blank.where("above").select(*columns)
    free, blank = free.select(*columns), blank.select(*columns)
    a, b = Box("a"), Box("b")
    other = reduce(Column.__or__, [~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in own.columns])
    in_row = (a.page == b.page) & (F.abs(a.y - b.y) <= 2) & (F.abs(a.h - b.h) <= 3) & (b.w <= 220) & other
    beside = (a.page == b.page) & (F.abs(a.y - b.y) <= 3) & (F.abs(a.h - b.h) <= 6) & other
    rows = row_peers(free).where(F.col("peers").between(2, 3)).drop("peers")
    tables = column_cells(free).where((F.col("cells") >= 3) & (F.col("w") <= 220) & (F.col("h") <= 32)).drop("cells")
    same = reduce(Column.__and__, [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in own.columns])
    stacked = stacked_lines(own, anchors).alias("l").join(blank.alias("r"), same, "left_semi")
    stages = [
        ("direct", labelled),
        ("stacked", stacked),
        ("peer", rows.alias("a").join(labelled.alias("b"), in_row, "left_semi")),
        ("above", above),
        ("table", tables.alias("a").join(conflict.alias("b"), beside, "left_semi")),
    ]
    tagged = [df.select(*own.columns, F.struct(F.lit(i).alias("i"), F.lit(s).alias("stage")).alias("s")) for i, (s, df) in enumerate(stages)]
    return reduce(DataFrame.unionAll, tagged).groupBy(*own.columns).agg(F.min("s").alias("s")).select(*own.columns, "s.stage")


def by_priority(sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """Boxes of all sources with `source`; each source's boxes give way to those kept of earlier ones."""
    kept = None
    for name, boxes in sources:
        own = boxes if kept is None else not_overlapping(boxes, kept.select(*BOX))
        own = own.withColumn("source", F.lit(name))
        kept = own if kept is None else kept.unionByName(own)
    return kept


def same_line_words(words: DataFrame, reach: float = 220) -> DataFrame:
    """(a, b) of different words of a line within `reach` points, as structs; each pair both ways.

    (page, seq) must be unique. Words are dealt into bands of lines; a pair is made in the first band it shares.
    """
    line = F.explode(F.sequence(F.floor(F.col("y0") / 16), F.floor(F.greatest("y0", "y1") / 16)))
    own = words.withColumn("gl", line)
    gap = G.gap(F.col("a.x0"), F.col("a.x1"), F.col("b.x0"), F.col("b.x1"))
    test = (F.col("a.page") == F.col("b.page")) & (F.col("a.gl") == F.col("b.gl")) & (F.col("a.seq") != F.col("b.seq")) & G.share_line("a", "b") & (gap <= reach)
    first = F.col("a.gl") == F.floor(F.greatest("a.y0", "b.y0") / 16)
    met = own.alias("a").join(own.alias("b"), test & first)
    return met.select(F.struct(*_keys("a", words.columns)).alias("a"), F.struct(*_keys("b", words.columns)).alias("b"))


def context_rows(specs: DataFrame, contexts: DataFrame) -> DataFrame:
    """Wide text fields of the row that each context (cid, page, x0, x1, y, direction) speaks of.

    On the context's line a field must follow it in its direction within 90 points; else it must be within 50
    points of height and 300 of width. The row are the fields within 3 points of the nearest one; a single
    one counts within 50.
    """
    a, c = Box("a"), lambda n: F.col(f"b.{n}")
    on_line = F.abs(c("y") - a.y) <= 8
    rtl = (c("direction") != "rtl") | (c("x0") - a.right).between(0, 90)
    ltr = (c("direction") != "ltr") | (a.x - c("x1")).between(0, 90)
    far = F.when(c("y").between(a.y, a.top), F.lit(0.0)).otherwise(F.least(F.abs(c("y") - a.y), F.abs(c("y") - a.top)))
    near = (far <= 50) & (F.greatest(a.x - c("x1"), c("x0") - a.right, F.lit(0)) <= 300)
    wide = specs.where("type = 'text' and w >= 70")
    met = wide.alias("a").join(contexts.alias("b"), (a.page == c("page")) & F.when(on_line, rtl & ltr).otherwise(near))
    met = met.select(F.col("b.cid"), *_keys("a", specs.columns), far.alias("far"))
    own = Window.partitionBy("cid")
    row = met.withColumn("nearest", F.min("far").over(own)).where(F.abs(F.col("far") - F.col("nearest")) <= 3)
    return row.withColumn("n", F.count(F.lit(1)).over(own)).where((F.col("n") >= 2) | (F.col("nearest") <= 50)).drop("n", "nearest")


def without_box_on_line(anchors: DataFrame, boxes: DataFrame) -> DataFrame:
    """Anchors with no box within 10 points of their line that begins within 300 points."""
    a, b = F.col, Box("b")
    near = a("a.y").between(b.y - 10, b.top + 10) & (F.abs(b.x - a("a.x")) <= 300)
    return anchors.alias("a").join(boxes.alias("b"), (a("a.page") == b.page) & near, "left_anti")


def squares(segments: DataFrame) -> DataFrame:
    """Checkboxes (page, x, y, w, h) drawn as four segments (page, x0, y0, x1, y1; low ends first)."""
    s = segments.distinct()
    flat, tall = s.where("abs(y0 - y1) <= 0.5"), s.where("abs(x0 - x1) <= 0.5")
    c = F.col
    w, h = c("b.x1") - c("b.x0"), c("t.y0") - c("b.y0")
    lids = flat.alias("b").join(flat.alias("t"), (c("b.page") == c("t.page")) & (F.abs(c("t.x0") - c("b.x0")) <= 1) & (F.abs(c("t.x1") - c("b.x1")) <= 1) & (h > 0) & G.is_checkbox_size(w, h))
    found = lids.select(c("b.page").alias("page"), c("b.x0").alias("x"), c("b.y0").alias("y"), w.alias("w"), h.alias("h")).distinct()
    for side in (c("f.x"), c("f.x") + c("f.w")):
        at = (F.abs(c("v.x0") - side) <= 1) & (F.abs(c("v.y0") - c("f.y")) <= 1) & (F.abs(c("v.y1") - c("f.y") - c("f.h")) <= 1)
        found = found.alias("f").join(tall.alias("v"), (c("f.page") == c("v.page")) & at, "left_semi")
    return found


def uncovered_lines(lines: DataFrame, boxes: DataFrame) -> DataFrame:
    """Lines (page, x, y, w) that no box of the same span covers, 20 points of height allowed."""
    c, b = F.col, Box("b")
    covers = (F.abs(c("a.x") - b.x) <= 5) & (F.abs(c("a.w") - b.w) <= 5) & c("a.y").between(b.y - G.MOST_FIELD_HEIGHT, b.top + G.MOST_FIELD_HEIGHT)
    return lines.distinct().alias("a").join(boxes.alias("b"), (c("a.page") == b.page) & covers, "left_anti")


def grouped_checkboxes(boxes: DataFrame) -> DataFrame:
    """Boxes with another of like size close by in their column or row; rows need a seq."""
    a, b = Box("a"), Box("b")
    like = (F.abs(a.w - b.w) <= 3) & (F.abs(a.h - b.h) <= 3)
    up, side = G.gap(a.y, a.top, b.y, b.top), G.gap(a.x, a.right, b.x, b.right)
    column = (F.abs(a.x - b.x) <= F.greatest(F.lit(4.0), F.least(a.w, b.w) * 0.5)) & (up > 0) & (up <= 40)
    row = (F.abs(a.y - b.y) <= F.greatest(F.lit(4.0), F.least(a.h, b.h) * 0.5)) & (side > 0) & (side <= 50)
    other = _boxes_in_cells(boxes)
    return _matched(boxes, _boxes_in_cells(boxes, 50, 40, 40), other, like & (column | row))
