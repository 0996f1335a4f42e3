"""The field rules as one table of issues (severity, code, page, field).

Row rules are a single pass: every row yields an array of the codes that it breaks. Group rules aggregate.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid.functions import text as T
from quillgrid.operators.materialise import cut

# The columns of a beneficiary row, and the rows that a table repeats.
BENEFICIARY_COLUMNS = ("Name", "ID", "DOB", "CitizenshipCountry", "TaxResidencyCountry", "BenefitPercent")
BENEFICIARY_ROWS = 3
BENEFICIARY_NAME = rf"^txtBeneficiary(\d+)({'|'.join(BENEFICIARY_COLUMNS)})$"
ISSUE = ("severity", "code", "page", "field")


def _issue(severity: str, code: str, page: Column | None = None, field: Column | None = None) -> Column:
    return F.struct(
        F.lit(severity).alias("severity"),
        F.lit(code).alias("code"),
        (F.lit(None) if page is None else page).cast("long").alias("page"),
        (F.lit(None) if field is None else field).cast("string").alias("field"),
    )


def _exploded(df: DataFrame, checks: list[tuple[Column, Column]]) -> DataFrame:
    found = F.filter(F.array(*[F.when(broken, issue) for broken, issue in checks]), lambda i: i.isNotNull())
    return df.select(F.explode(found).alias("i")).select("i.*")


def _row_checks() -> list[tuple[Column, Column]]:
    c = F.col
    sized = (c("w") > 0) & (c("h") > 0)
    text = c("type").isin("text", "textarea")
    image = c("type") == "image"
    box = (c("w") < 6) | (c("h") < 6) | (c("w") > 30) | (c("h") > 30)
    at = {"page": c("page"), "field": c("name")}
    return [
        (c("page") < 1, _issue("ERROR", "invalid-page", None, c("name"))),
        (~sized, _issue("ERROR", "invalid-size", **at)),
        (sized & text & (c("h") < 10), _issue("WARN", "small-text-height", **at)),
        (sized & (c("type") == "textarea") & (c("h") < 16), _issue("WARN", "small-textarea-height", **at)),
        (sized & (c("type") == "checkbox") & box, _issue("WARN", "checkbox-size", **at)),
        (sized & image & ((c("w") < 20) | (c("h") < 12)), _issue("WARN", "small-image-field", **at)),
        (sized & c("name").startswith("txtBeneficiary") & (c("h") < 20), _issue("WARN", "small-beneficiary-field", **at)),
        (T.is_image_signature(c("name")) & ~image, _issue("ERROR", "signature-format", **at)),
        (image & ~c("name").startswith("img"), _issue("WARN", "image-name-format", **at)),
    ]


def row_rules(specs: DataFrame) -> DataFrame:
    """Rules on one field; the size rules are skipped where the size isn't positive."""
    return _exploded(specs, _row_checks())


def duplicate_rules(specs: DataFrame) -> DataFrame:
    """Names that repeat, with several types, or as signatures."""
    names = specs.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.size(F.collect_set("type")).alias("types")).where("n > 1")
    field = F.col("name")
    return _exploded(
        names,
        [
            (F.lit(True), _issue("WARN", "duplicate-name", None, field)),
            (F.col("types") > 1, _issue("WARN", "duplicate-name-mixed-types", None, field)),
            (T.is_image_signature(field), _issue("WARN", "duplicate-signature-name", None, field)),
        ],
    )


def duplicate_cells(specs: DataFrame) -> DataFrame:
    """(page, name, x, y, w, h, n) of identical fields."""
    return specs.groupBy("page", "name", "x", "y", "w", "h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def cell_rules(specs: DataFrame) -> DataFrame:
    return duplicate_cells(specs).select(_issue("ERROR", "duplicate-cell", F.col("page"), F.col("name")).alias("i")).select("i.*")


def beneficiary_cells(specs: DataFrame) -> DataFrame:
    """(page, row, column) of beneficiary fields."""
    part = lambda i: F.regexp_extract("name", BENEFICIARY_NAME, i)
    found = specs.where(F.col("name").rlike(BENEFICIARY_NAME))
    return found.select("page", part(1).cast("int").alias("row"), part(2).alias("column")).distinct()


def missing_cells(cells: DataFrame) -> DataFrame:
    """(page, row, column) that the three rows from a page's first one should have and don't."""
    wanted = F.explode(F.sequence(F.col("first"), F.col("first") + BENEFICIARY_ROWS - 1))
    rows = cells.groupBy("page").agg(F.min("row").alias("first")).select("page", wanted.alias("row"))
    columns = F.explode(F.array(*map(F.lit, BENEFICIARY_COLUMNS)))
    return rows.select("page", "row", columns.alias("column")).join(cells, ["page", "row", "column"], "left_anti")


def missing_columns(cells: DataFrame) -> DataFrame:
    """(page, row, missing) of rows that lack columns."""
    held = cells.groupBy("page", "row").agg(F.collect_set("column").alias("held"))
    missing = F.array_sort(F.array_except(F.array(*map(F.lit, BENEFICIARY_COLUMNS)), F.col("held")))
    return held.select("page", "row", missing.alias("missing")).where(F.size("missing") > 0)


def beneficiary_rules(specs: DataFrame) -> DataFrame:
    cells = beneficiary_cells(specs)
    tables = missing_cells(cells).select("page").distinct().select(_issue("ERROR", "incomplete-beneficiary-table", F.col("page")).alias("i"))
    rows = missing_columns(cells).select(_issue("ERROR", "incomplete-beneficiary-row", F.col("page")).alias("i"))
    return tables.unionAll(rows).select("i.*")


def _bounds_checks() -> list[tuple[Column, Column]]:
    """Checks of fields joined with their pages' width and height."""
    c = F.col
    outside = (c("x") < 0) | (c("y") < 0) | (c("x") + c("w") > c("width") + 0.5) | (c("y") + c("h") > c("height") + 0.5)
    at = {"page": c("page"), "field": c("name")}
    gone = c("width").isNull()
    return [(gone & (c("page") >= 1), _issue("ERROR", "page-out-of-range", **at)), (~gone & outside, _issue("ERROR", "field-out-of-page", **at))]


def bounds_rules(specs: DataFrame, pages: DataFrame) -> DataFrame:
    """Fields on no page, or outside theirs by over half a point; pages is (page, width, height)."""
    return _exploded(specs.join(pages, "page", "left"), _bounds_checks())


def ink_rules(specs: DataFrame, runs: DataFrame, pages: DataFrame, dpi: float = 72.0) -> DataFrame:
    """Text and image fields over existing ink.

    `runs` holds a page raster's dark pixels as runs (page, row, begin, end) with end exclusive; pages is (page,
    width, height). A field counts if its inset area has 20 dark pixels and they are 8 % of it or more.
    """
    c, scale = F.col, dpi / 72.0
    margin = F.least(F.lit(3.0), c("w") / 4, c("h") / 4)
    clip = lambda v, most: F.greatest(F.lit(0), F.least(F.bround(v * scale).cast("int"), F.bround(most * scale).cast("int")))
    framed = specs.where(c("type").isin("text", "textarea", "image")).join(pages, "page").select(
        "page", "name", "x", "y", "w", "h",
        clip(c("x") + margin, c("width")).alias("left"), clip(c("x") + c("w") - margin, c("width")).alias("right"),
        clip(c("height") - c("y") - c("h") + margin, c("height")).alias("top"), clip(c("height") - c("y") - margin, c("height")).alias("bottom"),
    ).where("right > left and bottom > top")
    inside = (c("r.row") >= c("top")) & (c("r.row") < c("bottom")) & (c("r.begin") < c("right")) & (c("r.end") > c("left"))
    met = framed.alias("f").join(runs.alias("r"), (c("f.page") == c("r.page")) & inside)
    keys = [f"f.{k}" for k in framed.columns]
    dark = F.sum(F.least(c("r.end"), c("right")) - F.greatest(c("r.begin"), c("left")))
    area = (c("right") - c("left")) * (c("bottom") - c("top"))
    found = met.groupBy(*keys).agg(dark.alias("dark")).where((c("dark") >= 20) & (c("dark") >= area * 0.08))
    return found.select(_issue("WARN", "field-over-original-content", c("page"), c("name")).alias("i")).select("i.*")


def ink_skipped(specs: DataFrame, runs: DataFrame, pages: DataFrame) -> DataFrame:
    """Known pages with text or image fields for which no raster is given, so ink_rules() can't judge them."""
    asked = specs.where(F.col("type").isin("text", "textarea", "image")).join(pages.select("page"), "page", "left_semi").select("page").distinct()
    missing = asked.join(runs.select("page").distinct(), "page", "left_anti")
    return missing.select(_issue("WARN", "original-content-check-skipped", F.col("page")).alias("i")).select("i.*")


def count_compare(specs: DataFrame, found: DataFrame) -> DataFrame:
    """(name, expected, actual) of names that the two tables don't hold equally often."""
    left = specs.groupBy("name").agg(F.count(F.lit(1)).alias("expected"))
    right = found.groupBy("name").agg(F.count(F.lit(1)).alias("actual"))
    both = left.join(right, "name", "full").select("name", F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("actual", F.lit(0)).alias("actual"))
    return both.where("expected <> actual")


def layout_mismatches(template: DataFrame, target: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """(page, reason) of pages (page, width, height) that one table lacks, or whose sizes differ too much."""
    a, b = template.alias("a"), target.alias("b")
    both = a.join(b, F.col("a.page") == F.col("b.page"), "full")
    far = (F.abs(F.col("a.width") - F.col("b.width")) > tolerance) | (F.abs(F.col("a.height") - F.col("b.height")) > tolerance)
    reason = F.when(F.col("a.page").isNull() | F.col("b.page").isNull(), "page-count").when(far, "page-size")
    return both.select(F.coalesce("a.page", "b.page").alias("page"), reason.alias("reason")).where("reason is not null")


def widget_rules(specs: DataFrame, widgets: DataFrame) -> DataFrame:
    """Rules on a built form's widgets.

    widgets: name, ft, ff (flags), highlight, border (width or null), style_width, style, has_bg, has_bc,
    appearances (array of states). Without widgets the form has no field tree.
    """
    c = F.col
    if widgets.isEmpty():
        return specs.sparkSession.range(1).select(_issue("ERROR", "missing-acroform").alias("i")).select("i.*")
    wanted = specs.groupBy("name").agg(F.count(F.lit(1)).alias("expected"), F.collect_set("type").alias("types"))
    names = widgets.groupBy("name").agg(F.count(F.lit(1)).alias("actual"))
    counted = wanted.join(names, "name", "left").where(c("expected") != F.coalesce("actual", F.lit(0)))
    totals = specs.agg(F.count(F.lit(1)).alias("n")).crossJoin(widgets.agg(F.count(F.lit(1)).alias("m"))).where("n <> m")  # one row each
    push = (c("ft") == "/Btn") & (c("ff").bitwiseAND(65536) != 0)
    raised = push & (c("highlight") == "/P") & (c("border") > 0) & (c("style_width") > 0) & (c("style") == "/B") & c("has_bg")
    visible = (F.coalesce(c("border"), F.lit(0)) != 0) | (F.coalesce(c("style_width"), F.lit(0)) != 0) | c("has_bg") | c("has_bc")
    joined = widgets.join(wanted.select("name", "types"), "name", "left")
    kind = lambda t: F.coalesce(F.array_contains("types", t), F.lit(False))
    states = F.coalesce(c("appearances"), F.array().cast("array<string>"))
    each = _exploded(
        joined,
        [
            (c("ft") == "/Sig", _issue("ERROR", "pdf-signature-field", None, c("name"))),
            (kind("image") & ~F.coalesce(raised, F.lit(False)), _issue("ERROR", "pdf-image-button-format", None, c("name"))),
            (T.is_image_signature(c("name")) & ~push, _issue("ERROR", "pdf-image-signature-format", None, c("name"))),
            ((c("ft") == "/Tx") & visible, _issue("ERROR", "pdf-field-covers-original-content", None, c("name"))),
            ((c("ft") == "/Btn") & ~push & kind("checkbox") & (F.size(F.array_intersect(states, F.array(F.lit("/Off"), F.lit("/Yes")))) < 2), _issue("ERROR", "pdf-checkbox-appearance", None, c("name"))),
        ],
    )
    parts = [
        totals.select(_issue("ERROR", "field-count-mismatch").alias("i")).select("i.*"),
        counted.select(_issue("ERROR", "field-name-count-mismatch", None, c("name")).alias("i")).select("i.*"),
        names.where("actual > 1").select(_issue("WARN", "pdf-duplicate-name", None, c("name")).alias("i")).select("i.*"),
        each,
    ]
    return reduce(DataFrame.unionAll, parts)


def validate(specs: DataFrame, pages: DataFrame | None = None, runs: DataFrame | None = None) -> DataFrame:
    """All issues of field specs (page, name, type, x, y, w, h); bounds with pages, ink with raster runs too.

    The specs are read once; the rules on single fields and on their pages are judged in one pass.
    """
    own = cut(specs.select("page", "name", "type", "x", "y", "w", "h"))
    single = row_rules(own) if pages is None else _exploded(own.join(pages.select("page", "width", "height"), "page", "left"), _row_checks() + _bounds_checks())
    parts = [single, duplicate_rules(own), cell_rules(own), beneficiary_rules(own)]
    if pages is not None and runs is not None:
        parts += [ink_rules(own, runs, pages), ink_skipped(own, runs, pages)]
    return reduce(DataFrame.unionAll, parts)


def summary(issues: DataFrame) -> DataFrame:
    """Issues by severity and code."""
    return issues.groupBy("severity", "code").agg(F.count(F.lit(1)).alias("n"))


def verdict(issues: DataFrame, strict: bool = False) -> DataFrame:
    """One row: errors, warnings, failed (any error, or any warning if strict)."""
    counts = issues.agg(F.count_if(F.col("severity") == "ERROR").alias("errors"), F.count_if(F.col("severity") == "WARN").alias("warnings"))
    return counts.withColumn("failed", (F.col("errors") > 0) | (F.lit(strict) & (F.col("warnings") > 0)))
