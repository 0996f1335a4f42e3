"""Geometry expressions on boxes (x, y, w, h; origin bottom left, in points) and words (x0, y0, x1, y1; top left)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Size gates in points.
LEAST_BOX_WIDTH, LEAST_BOX_HEIGHT, MOST_BOX_HEIGHT = 40.0, 9.0, 120.0
MOST_FIELD_HEIGHT, UNDERLINE_HEIGHT = 20.0, 12.0
LEAST_CHECKBOX, MOST_CHECKBOX, MOST_ASPECT = 6.0, 20.0, 0.3
MM_PER_POINT = 0.3528


class Box:
    """The columns of a box under a table's alias."""

    def __init__(self, alias: str = ""):
        dot = f"{alias}." if alias else ""
        self.page, self.x, self.y, self.w, self.h = (F.col(f"{dot}{c}") for c in ("page", "x", "y", "w", "h"))
        self.right, self.top = self.x + self.w, self.y + self.h


def overlaps(a: Box, b: Box) -> Column:
    """Boxes that share more than an edge."""
    return (a.x < b.right) & (a.right > b.x) & (a.y < b.top) & (a.top > b.y)


def contains(box: Box, x: Column, y: Column, inset: float = 0) -> Column:
    """A point inside a box, edges included, or `inset` points inside."""
    return x.between(box.x + inset, box.right - inset) & y.between(box.y + inset, box.top - inset)


def overlap_ratio(a: Box, b: Box) -> Column:
    """shared area by the smaller box's area."""
    wide = F.greatest(F.least(a.right, b.right) - F.greatest(a.x, b.x), F.lit(0))
    high = F.greatest(F.least(a.top, b.top) - F.greatest(a.y, b.y), F.lit(0))
    least = F.least(a.w * a.h, b.w * b.h)
    return F.when(least > 0, wide * high / least).otherwise(0.0)


def near_duplicates(a: Box, b: Box) -> Column:
    near = (F.abs(a.x - b.x) <= 2) & (F.abs(a.y - b.y) <= 2) & (F.abs(a.w - b.w) <= 3) & (F.abs(a.h - b.h) <= 3)
    return near & (overlap_ratio(a, b) >= 0.9)


def gap(low_a: Column, high_a: Column, low_b: Column, high_b: Column) -> Column:
    """the distance of two intervals, 0 if they meet."""
    return F.greatest(low_a - high_b, low_b - high_a, F.lit(0))


def share_line(a: str, b: str) -> Column:
    """Words that share half of the lower one's height."""
    shared = F.least(F.col(f"{a}.y1"), F.col(f"{b}.y1")) - F.greatest(F.col(f"{a}.y0"), F.col(f"{b}.y0"))
    return shared >= F.least(F.col(f"{a}.y1") - F.col(f"{a}.y0"), F.col(f"{b}.y1") - F.col(f"{b}.y0")) * 0.5


def is_row_separator(b: Box) -> Column:
    """A flat box over a whole row."""
    return (b.h <= UNDERLINE_HEIGHT) & (b.w >= 450)


def is_checkbox_size(w: Column, h: Column) -> Column:
    """P5: small and about square."""
    square = F.abs(w - h) / F.greatest(w, h) < MOST_ASPECT
    return w.between(LEAST_CHECKBOX, MOST_CHECKBOX) & h.between(LEAST_CHECKBOX, MOST_CHECKBOX) & square


def is_input_size(b: Box) -> Column:
    """P5: wide and high enough for an input, not too high."""
    return (b.w >= LEAST_BOX_WIDTH) & b.h.between(LEAST_BOX_HEIGHT, MOST_BOX_HEIGHT)


def on_page(b: Box, width: Column, height: Column, margin: float = 2.0) -> Column:
    """Inside the page up to a margin."""
    return (b.x >= -margin) & (b.y >= -margin) & (b.right <= width + margin) & (b.top <= height + margin)


def concatenated(a: Column, b: Column) -> Column:
    """the affine matrix that applies `a`, then `b`; matrices are structs of a to f."""
    return F.struct(
        (a.a * b.a + a.b * b.c).alias("a"), (a.a * b.b + a.b * b.d).alias("b"), (a.c * b.a + a.d * b.c).alias("c"),
        (a.c * b.b + a.d * b.d).alias("d"), (a.e * b.a + a.f * b.c + b.e).alias("e"), (a.e * b.b + a.f * b.d + b.f).alias("f"),
    )


def moved_point(m: Column, x: Column, y: Column) -> tuple[Column, Column]:
    return m.a * x + m.c * y + m.e, m.b * x + m.d * y + m.f


def moved_box(m: Column, b: Box) -> Column:
    """the upright box round a transformed one, as a struct."""
    corners = [moved_point(m, x, y) for x in (b.x, b.right) for y in (b.y, b.top)]
    xs, ys = [c[0] for c in corners], [c[1] for c in corners]
    x, y = F.least(*xs), F.least(*ys)
    return F.struct(x.alias("x"), y.alias("y"), (F.greatest(*xs) - x).alias("w"), (F.greatest(*ys) - y).alias("h"))


def millimetres(b: Box, page_height: Column) -> Column:
    """F16: a box in millimetres from the top left."""
    return F.struct(
        (b.x * MM_PER_POINT).alias("x"), ((page_height - b.y - b.h) * MM_PER_POINT).alias("y"),
        (b.w * MM_PER_POINT).alias("w"), (b.h * MM_PER_POINT).alias("h"),
    )
