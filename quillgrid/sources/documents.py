"""Words, layouts and XML forms as tables."""

from __future__ import annotations

from xml.etree import ElementTree

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgrid.functions import text as T
from quillgrid.sources.batches import map_rows

_NUM = r"([-0-9.]+)"
WORD_LINE = rf'<word\s+xMin="{_NUM}"\s+yMin="{_NUM}"\s+xMax="{_NUM}"\s+yMax="{_NUM}">(.*?)</word>'
PAGE_LINE = rf'<page\b[^>]*\bheight="{_NUM}"'
LAYOUT_SCHEMA = """struct<warnings: array<string>, pages: array<struct<page: int, width: double, height: double,
  words: array<struct<text: string, polygon: array<double>>>, lines: array<struct<text: string, polygon: array<double>>>,
  marks: array<struct<state: string, polygon: array<double>>>>>>"""


def word_boxes(lines: DataFrame) -> DataFrame:
    """(doc_id, page, seq, page_height, text, x0, y0, x1, y1) of word-box listings (doc_id, line, text).

    Every page line starts the next page; words before the first one, or on a page without height, are left out.
    """
    number = lambda pattern, i: F.expr("cast(null as double)") if pattern is None else F.regexp_extract("text", pattern, i).try_cast("double")
    height = number(PAGE_LINE, 1)
    upto = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("height", height)
    carried = marked.withColumn("page", F.count("height").over(upto)).withColumn("page_height", F.last("height", True).over(upto))
    words = carried.where(F.col("text").rlike(WORD_LINE) & F.col("height").isNull() & (F.col("page") > 0) & (F.col("page_height") > 0))
    sides = [number(WORD_LINE, i + 1).alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))]
    return words.select("doc_id", F.col("page").cast("int").alias("page"), F.col("line").alias("seq"), "page_height", T.html_unescaped(F.regexp_extract("text", WORD_LINE, 5)).alias("text"), *sides)


def word_anchors(words: DataFrame) -> DataFrame:
    """Words as anchors: their lower left corner with the origin at the page's bottom; fill lines are none."""
    own = words.where(~T.is_fill_line(F.col("text")))
    return own.select("doc_id", "page", "seq", "text", F.col("x0").alias("x"), (F.col("page_height") - F.col("y1")).alias("y"))


def _bounds(polygon: str, scale_x, scale_y):
    at = lambda odd: F.filter(F.col(polygon), lambda v, i: i % 2 == odd)
    return [(F.array_min(at(0)) * scale_x).alias("x0"), (F.array_min(at(1)) * scale_y).alias("y0"), (F.array_max(at(0)) * scale_x).alias("x1"), (F.array_max(at(1)) * scale_y).alias("y1")]


def layout_items(layouts: DataFrame, page_sizes: DataFrame) -> DataFrame:
    """(doc_id, page, kind, seq, text, page_height, x0, y0, x1, y1) of layout JSON (doc_id, json), in points.

    kind is word, line or mark; polygons are flat lists of x and y in the layout's unit, scaled to page_sizes
    (doc_id, page, width, height), 612 by 792 where a page is missing. Marks must be 5 to 30 points a side.
    """
    pages = layouts.select("doc_id", F.explode(F.from_json("json", LAYOUT_SCHEMA)["pages"]).alias("p")).select("doc_id", F.col("p.page").alias("page"), F.col("p").alias("p"))
    sized = pages.join(page_sizes.select("doc_id", "page", F.col("width").alias("pw"), F.col("height").alias("ph")), ["doc_id", "page"], "left")
    sized = sized.withColumn("pw", F.coalesce("pw", F.lit(612.0))).withColumn("ph", F.coalesce("ph", F.lit(792.0)))
    parts = []
    for kind, field, text in (("word", "words", "i.text"), ("line", "lines", "i.text"), ("mark", "marks", "i.state")):
        items = sized.select("doc_id", "page", "pw", "ph", F.col("p.width").alias("w"), F.col("p.height").alias("h"), F.posexplode(f"p.{field}").alias("seq", "i"))
        flat = items.withColumn("polygon", F.col("i.polygon")).where(F.size("polygon") >= 4)
        parts.append(flat.select("doc_id", "page", F.lit(kind).alias("kind"), "seq", F.col(text).alias("text"), F.col("ph").alias("page_height"), *_bounds("polygon", F.col("pw") / F.col("w"), F.col("ph") / F.col("h"))))
    every = parts[0].unionAll(parts[1]).unionAll(parts[2])
    size = lambda c: F.col(f"{c}1") - F.col(f"{c}0")
    return every.where((F.col("kind") != "mark") | (size("x").between(5, 30) & size("y").between(5, 30)))


def form_fields(forms: DataFrame, descendants: bool = False) -> DataFrame:
    """(doc_id, page, seq, name) of XML forms (doc_id, xml): the fields of each page subform.

    Pages are the subforms named Page... of the topmost subform. Only a page's own fields are listed, or all
    below it. Namespaces are ignored; a document that isn't XML or has no template gives no rows.
    """
    kind = forms.schema["doc_id"].dataType.simpleString()

    def parse(doc, xml):
        for i, (page, name) in enumerate(_fields(xml, descendants)):
            yield doc, page, i, name

    return map_rows(forms.select("doc_id", "xml"), parse, f"doc_id {kind}, page string, seq int, name string")


def _local(element) -> str:
    return element.tag.rpartition("}")[2] if isinstance(element.tag, str) else ""


def _fields(xml: str | None, descendants: bool):
    try:
        root = ElementTree.fromstring(xml or "")
    except ElementTree.ParseError:
        return
    for top in root.iter():
        if _local(top) != "subform" or top.get("name") != "topmostSubform":
            continue
        for page in top:
            if _local(page) == "subform" and (page.get("name") or "").startswith("Page"):
                for field in page.iter() if descendants else page:
                    if _local(field) == "field" and field.get("name"):
                        yield page.get("name"), field.get("name")
        return


def page_summaries(fields: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, page, n) of form_fields() for all `pages` (doc_id, page)."""
    return pages.join(fields, ["doc_id", "page"], "left").groupBy("doc_id", "page").agg(F.count("name").alias("n"))
