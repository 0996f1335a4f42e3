"""Whole tasks on forms: placement checks, transfer of fields, page replacement, embedded templates, automatic forms."""

from __future__ import annotations

from xml.etree import ElementTree

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.operators import cluster, naming, resolve, widgets
from quillgrid.plans.detect import detect
from quillgrid.sources import pdf, pdf_writer
from quillgrid.sources.batches import map_groups, map_rows

#: Pixels of the shortest run that counts as an underline.
LEAST_UNDERLINE = 8


def placement(specs: DataFrame, runs: DataFrame, pages: DataFrame, dpi: float = 150.0, bottom: float = 2.0, width: float = 5.0, ratio: float = 0.1) -> DataFrame:
    """(page, name, x, y, w, h, line_y, warnings) of text fields against the underlines of their pages' rasters.

    `runs` holds dark pixels (page, row, begin, end), pages is (page, width, height). The underline is the run near
    the field's bottom edge that overlaps it most. Warnings: no-underline, bottom-off-line (by over `bottom` points),
    width-off-line (by over `width` points and `ratio` of the field), printed-text-above. Fields that are alike are
    judged once; fields of unknown pages aren't.
    """
    keys, scale, c = ["page", "name", "x", "y", "w", "h"], dpi / 72.0, F.col
    pixel = lambda v: F.bround(v * scale).cast("int")
    tolerance = max(1, round(bottom * scale))
    sized = pages.select("page", c("width").alias("page_w"), c("height").alias("page_h"))
    framed = specs.where(c("type").isin("text", "textarea")).select(*keys).distinct().join(sized, "page")
    framed = framed.select(
        *keys, "page_h", F.greatest(F.lit(0), pixel(c("x"))).alias("left"), F.least(pixel(c("page_w")), pixel(c("x") + c("w"))).alias("right"),
        pixel(c("page_h") - c("y")).alias("base"), F.greatest(F.lit(0), pixel(c("page_h") - c("y") - c("h"))).alias("top"),
    )
    dark = runs.select(c("page").alias("p"), "row", "begin", "end")
    overlap = F.least("end", "right") - F.greatest("begin", "left")
    near = framed.join(dark.where(c("end") - c("begin") >= LEAST_UNDERLINE), (c("page") == c("p")) & (F.abs(c("row") - c("base")) <= tolerance) & (overlap > 0))
    near = near.select(*keys, overlap.alias("overlap"), (c("end") - c("begin")).alias("width"), F.abs(c("row") - c("base")).alias("distance"), "row", "begin")
    lines = cluster.best_line(near, keys).select(*keys, c("row").alias("line"), c("width").alias("line_w"))
    lined = framed.join(lines, keys, "left")
    stop = F.greatest(c("top"), c("line") - max(2, round(1.5 * scale)))
    above = lined.where(stop > c("top")).join(dark, (c("page") == c("p")) & (c("row") >= c("top")) & (c("row") < stop) & (overlap > 0))
    area = (stop - c("top")) * (c("right") - c("left"))
    printed = above.groupBy(*keys, area.alias("area")).agg(F.sum(overlap).alias("ink")).where((c("ink") > 12) & (c("ink") > F.floor(c("area") * 0.002)))
    marked = lined.join(printed.select(*keys, F.lit(True).alias("printed")), keys, "left").withColumn("line_y", c("page_h") - c("line") / scale)
    tests = [
        ("no-underline", c("line").isNull()),
        ("bottom-off-line", F.abs(c("line_y") - c("y")) > bottom),
        ("width-off-line", F.abs(c("line_w") / scale - c("w")) > F.greatest(F.lit(width), F.abs("w") * ratio)),
        ("printed-text-above", c("printed")),
    ]
    warnings = F.filter(F.array(*[F.when(t, F.lit(name)) for name, t in tests]), lambda x: x.isNotNull())
    return marked.select(*keys, "line_y", warnings.alias("warnings"))


def _fields(own: DataFrame) -> DataFrame:
    """Fields of widgets; rows of pages stay, with their size and the type page."""
    page = F.col("ft").eqNullSafe(pdf.PAGE)
    own = widgets.inferred(own).where(page | F.expr("inferred is not null and trim(name) <> ''"))
    low, high = (lambda a, b: F.least(F.col(a), F.col(a) + F.col(b))), lambda b: F.abs(F.col(b))
    sides = [F.when(page, F.col(c)).otherwise(F.round(v, 2)).alias(c) for c, v in (("x", low("x", "w")), ("y", low("y", "h")), ("w", high("w")), ("h", high("h")))]
    return own.select("path", "page", F.trim("name").alias("name"), F.when(page, pdf.PAGE).otherwise(F.col("inferred")).alias("type"), *sides, F.lit("").alias("value"))


def extracted(found: DataFrame) -> DataFrame:
    """(path, page, name, type, x, y, w, h, value) of the widgets of fillable files; unnamed and unknown ones aren't taken."""
    return _fields(pdf.widgets(found))


def _mismatches(own: list[tuple], theirs: list[tuple], tolerance: float = 2.0):
    """J15 as in rules.layout_mismatches: (page, reason) of one path's pages (page, width, height)."""
    sizes: dict[int, list[tuple]] = {}
    for page, *size in theirs:
        sizes.setdefault(page, []).append(size)
    for page, width, height in own:
        for w, h in sizes.get(page, ()):
            if abs(width - w) > tolerance or abs(height - h) > tolerance:
                yield page, "page-size"
    yield from ((page, "page-count") for page, *_ in own if page not in sizes)
    held = {page for page, *_ in own}
    yield from ((page, "page-count") for page, *_ in theirs if page not in held)


def transferred(template: DataFrame, target: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files, mismatches): `target` files with the fields of the `template` files of the same path.

    Files whose pages differ in number or size are listed as mismatches (path, page, reason) and left out. Each file
    is read once, and of a template only page sizes and fields are dealt.
    """
    specs = _fields(pdf.pages_and_widgets(template))

    def build(paths, contents, rows):
        files = [pdf.File(content) if content[:4] == b"%PDF" else None for content in contents]
        own = [(page, w, h) for page, _, kind, _, _, w, h, _ in rows if kind == pdf.PAGE]
        fields = [r for r in rows if r[2] != pdf.PAGE]
        theirs = [size for f in files if f for size in f.sizes()]
        if contents and fields and next(_mismatches(own, theirs), None) is None:
            for content, file in zip(contents, files):
                yield paths[0], pdf_writer.Builder(content, file).built(fields)

    def sized(found, target):
        return pdf.page_lists(found).select("path", F.lit(target).alias("target"), "page", "width", "height")

    def compare(paths, targets, *columns):
        n = targets.index(True) if True in targets else len(targets)
        rows = [*zip(*columns)]
        if n < len(rows):
            yield from ((paths[0], *r) for r in _mismatches(rows[:n], [r for r in rows[n:] if r[0] is not None]))

    # a target's row without a page says that there is the file
    both = sized(template, False).where("page is not null").unionByName(sized(target, True)).where("path is not null")
    wrong = map_groups(both, "path", ["target", "page", "width", "height"], compare, "path string, page int, reason string")
    return pdf_writer.with_specs(target, specs, build, "path string, content binary"), wrong


def stripped(found: DataFrame) -> DataFrame:
    """(path, content, had_form): PDF files without their embedded form packets; other files are left out."""

    def strip(path, content):
        if content[:4] == b"%PDF":
            yield path, pdf_writer.without_form(content), next(iter(pdf.File(content).packets()), None) is not None

    return map_rows(found.select("path", "content"), strip, "path string, content binary, had_form boolean")


def embedded(found: DataFrame, templates: DataFrame) -> DataFrame:
    """K8: (path, content): PDF files with the templates (path, xml) as their form packet, in place of any other."""

    def embed(path, content, xml):
        yield path, pdf_writer.with_template(content, xml.encode())

    return map_rows(found.select("path", "content").join(templates.select("path", "xml"), "path"), embed, "path string, content binary")


def _local(element) -> str:
    return element.tag.rpartition("}")[2] if isinstance(element.tag, str) else ""


def _with_page(xml: str, page: str, fragment: str) -> str:
    root, new = ElementTree.fromstring(xml), ElementTree.fromstring(fragment)
    if _local(new) != "subform" or new.get("name") not in (None, page):
        raise ValueError(f"the fragment isn't a subform of {page}")
    for field in [f for f in new.iter() if _local(f) == "field"]:
        font = next((e for e in field.iter() if _local(e) == "font"), None)
        (ElementTree.SubElement(field, field.tag[: -len("field")] + "font") if font is None else font).set("typeface", "Arial")
    for top in root.iter():
        if _local(top) == "subform" and top.get("name") == "topmostSubform":
            for i, own in enumerate(top):
                if _local(own) == "subform" and own.get("name") == page:
                    new.set("name", page)
                    top[i] = new
                    return ElementTree.tostring(root, encoding="unicode")
    raise ValueError(f"the form has no {page}")


def replaced_pages(forms: DataFrame, fragments: DataFrame) -> DataFrame:
    """(doc_id, xml): forms (doc_id, xml) with pages put in place of theirs by fragments (doc_id, page, xml).

    A fragment is a subform of the page's name or of none; its fields get the font Arial. A page that the form
    doesn't have, or another element, fails the query. Forms without fragments stay as they are.
    """
    kind = forms.schema["doc_id"].dataType.simpleString()
    held = fragments.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", F.col("xml").alias("fragment")))).alias("fragments"))  # one form's

    def replace(doc, xml, parts):
        for part in parts or ():
            xml = _with_page(xml, part["page"], part["fragment"])
        yield doc, xml

    return map_rows(forms.select("doc_id", "xml").join(held, "doc_id", "left"), replace, f"doc_id {kind}, xml string")


def auto_form(items: DataFrame, known: DataFrame, aliases: DataFrame, label_aliases: DataFrame) -> DataFrame:
    """(page, name, type, x, y, w, h, label, matched, method): detected fields with the dictionary's names.

    items are those of pdf.drawn_items(); known names (name), aliases (alias, canonical) and label_aliases (alias,
    canonical) as resolve.resolved() takes them. Names that repeat on a page are told apart in reading order.
    """
    fields = detect(items).withColumnRenamed("name", "detected")
    names = resolve.resolved(fields.withColumnRenamed("detected", "name"), known, aliases, label_aliases)
    names = names.select(F.struct("name", "type", "label").alias("key"), F.col("resolved").alias("name"), "matched", "method")
    keyed = fields.withColumn("key", F.struct(F.col("detected").alias("name"), "type", "label"))
    joined = keyed.join(names, "key").select("page", "name", "type", "x", "y", "w", "h", "label", "matched", "method")
    unique = naming.unique_names(joined, [F.desc("y"), F.col("x"), F.col("w"), F.col("h")], "duplicate", ["page"])
    return unique.select("page", F.col("unique_name").alias("name"), "type", "x", "y", "w", "h", "label", "matched", "method")


def dictionary(curated: DataFrame, mapped: DataFrame) -> DataFrame:
    """(alias, canonical): the curated aliases, and those mapped ones that no curated row names; ambiguous ones go."""
    own = resolve.unambiguous(curated)
    return own.unionByName(resolve.unambiguous(mapped).join(own.select("alias"), "alias", "left_anti"))
