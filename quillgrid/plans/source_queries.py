"""Registered queries of the readers, writers and label functions, each with its DuckDB twin.

Files are made from the fixtures as rows of a path and a content, one file per page or per few pages, and read by the
operators as they would be from a file system; the twins say from the fixtures alone what must come out.
"""

from __future__ import annotations

import io
import zipfile
import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid.functions import signatures
from quillgrid.functions import text as T
from quillgrid.operators import reports, rules, widgets
from quillgrid.operators.materialise import shared_path
from quillgrid.plans import forms
from quillgrid.plans.fixtures import fixture, with_fixtures
from quillgrid.plans.registry import _query
from quillgrid.sources import documents, pdf, pdf_writer, sinks, tables
from quillgrid.sources.batches import map_groups, map_rows

HEADER = "page,name,type,x,y,w,h,value"


def _files(rows: DataFrame, key: str, order: str, line: Column, head: Column, ending: str = "csv", newline: str = "\n") -> DataFrame:
    """(path, content): one file for each value of `key`, its lines in order below the head."""
    held = rows.select(key, F.struct(F.col(order).alias("o"), line.alias("line")).alias("s")).groupBy(key).agg(F.array_sort(F.collect_list("s")).alias("s"))  # one page's
    body = F.array_join(F.transform("s", lambda s: s.line), newline)
    return held.select(F.concat(F.lit("f"), F.col(key).cast("string"), F.lit(f".{ending}")).alias("path"), F.encode(F.concat(head, F.lit(newline), body, F.lit(newline)), "UTF-8").alias("content"))


# --- field-spec files -------------------------------------------------------------------------------------

_BAD = "seq % 11 = 0 or seq % 13 = 0 or seq % 17 = 0 or seq % 19 = 0"
#: A row's line, as SQL that Spark and DuckDB both run; it settles the order of rows of the same place.
_LINE = """concat_ws(',', if(seq % 17 = 0, 'p', cast(page as string)), if(seq % 11 = 0, ' ', name), if(seq % 13 = 0, 'blob', if(type = 'checkbox', 'CHK ', type)),
        if(seq % 19 = 0, 'nan', cast(x as string)), cast(y as string), if(seq % 7 = 0, ' 1e2', cast(w as string)), cast(h as string), concat('v', seq))"""
_PLAIN_LINE = "concat_ws(',', page, name, if(seq % 5 = 0, '', type), x, y, w, h, '')"
_NUMBERED = f"--cte r as (select *, 1 + row_number() over (partition by page order by seq, {_LINE}) as row from field_specs)"


def _spec_rows(specs: DataFrame) -> DataFrame:
    """Files with bad cells of every kind, some without a required or the optional column."""
    own = F.expr(_LINE)
    head = F.expr(f"concat('﻿', case page % 10 when 3 then 'page,name,type,x,y,w,height,value' when 4 then 'page,name,type,x,y,w,h,extra' else '{HEADER}' end)")
    held = specs.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("seq", own.alias("line")))).alias("s"))  # one page's
    body = F.array_join(F.transform("s", lambda s: s.line), "\r\n")
    found = held.select(F.concat(F.lit("f"), F.col("page").cast("string"), F.lit(".csv")).alias("path"), F.encode(F.concat(head, F.lit("\r\n"), body, F.lit("\r\n")), "UTF-8").alias("content"))
    return tables.csv_rows(found)


@_query(
    "csv_specs",
    f"""{_NUMBERED} select 'f' || page || '.csv' as path, row, page, name, type, x, y, case when seq % 7 = 0 then 100 else w end as w, h,
      case when page % 10 = 4 then '' else 'v' || seq end as value from r where page % 10 <> 3 and not ({_BAD})""",
    "field_specs",
)
def csv_specs(specs):
    return tables.field_specs(_spec_rows(specs))[0]


@_query(
    "csv_spec_issues",
    f"""{_NUMBERED} select 'f' || page || '.csv' as path, 1 as row, case page % 10 when 3 then 'ERROR' else 'WARN' end as severity,
      case page % 10 when 3 then 'missing-columns' else 'missing-optional-columns' end as code, null as field from (select distinct page from field_specs) where page % 10 in (3, 4)
      union all select 'f' || page || '.csv', row, 'ERROR', case when seq % 11 = 0 then 'empty-required-cell' when seq % 13 = 0 then 'unsupported-type' else 'invalid-number' end,
      case when seq % 11 = 0 then null else name end from r where page % 10 <> 3 and ({_BAD})""",
    "field_specs",
)
def csv_spec_issues(specs):
    return tables.field_specs(_spec_rows(specs))[1]


@_query("csv_strict_specs", f"--cte r as (select *, 1 + row_number() over (partition by page order by seq, {_PLAIN_LINE}) as row from field_specs) select 'f' || page || '.csv' as path, row, page, name, case when seq % 5 = 0 then 'text' else type end as type, x, y, w, h, '' as value from r", "field_specs")
def csv_strict_specs(specs):
    return tables.strict_field_specs(tables.csv_rows(_files(specs, "page", "seq", F.expr(_PLAIN_LINE), F.lit(HEADER))))


@_query("csv_specs_written", "select page, name, type, x, y, w, h, 'v' || seq as value from field_specs", "field_specs")
def csv_specs_written(specs):
    """K1: written as CSV to the shared folder and read again."""
    folder = shared_path(specs.sparkSession, "specs")
    sinks.write_csv(specs.withColumn("value", F.concat(F.lit("v"), F.col("seq").cast("string"))), folder, sinks.SPEC_COLUMNS)
    rows = tables.csv_rows(tables.files(specs.sparkSession, folder, "*.csv"))
    return tables.field_specs(rows)[0].drop("path", "row")


# --- names in files ---------------------------------------------------------------------------------------


def _name_files(specs: DataFrame) -> DataFrame:
    listed = F.concat(F.col("name"), F.lit(", "), F.col("type"))
    coded = F.concat(F.lit("x."), F.col("name"), F.lit('.Value = "A'), F.col("name"), F.lit('"; // no_'), F.col("name"))
    return _files(specs, "page", "seq", F.when(F.col("page") % 2 == 0, listed).otherwise(coded), F.when(F.col("page") % 2 == 0, "field_name,type").otherwise("code"))


@_query("known_name_files", "select distinct 'f' || page || '.csv' as path, name from field_specs", "field_specs")
def known_name_files(specs):
    return tables.known_names(_name_files(specs))


@_query("name_token_files", "select distinct 'f' || page || '.csv' as path, name from field_specs", "field_specs")
def name_token_files(specs):
    return tables.name_tokens(_name_files(specs))


@_query("example_name_files", "select distinct 'f' || page || '.xml' as path, name from field_specs where page % 3 > 0 and seq % 4 > 0", "field_specs")
def example_name_files(specs):
    quoted = F.expr("if(seq % 4 = 0, concat('<fields name=\"', name, '\"/>'), concat('<field w=\"1\"\n name=', if(seq % 2 = 0, '\"', '\\''), name, if(seq % 2 = 0, '\"', '\\''), '/>'))")
    found = _files(specs, "page", "seq", quoted, F.lit("<form>"), "xml")
    return tables.example_names(found.withColumn("path", F.expr("if(cast(substring(path, 2, length(path) - 5) as bigint) % 3 = 0, concat(path, '.bin'), path)")))


_ALIAS_ROWS = """--cte k as (select name, row_number() over (order by name) - 1 as i from known_names),
a as (select lower(trim(o_orderpriority)) as label, 'old' || (o_orderkey % 40) as name, k.name as target from orders join k on k.i = (o_orderkey % 40) % 5),
every as (select 'name' as kind, lower(name) as alias, target from a union all select 'label', trim(regexp_replace(label, '[ :-]+', ' ', 'g')), target from a where target <> 'BUILDING' or label like '%low%')
select kind, alias, min(target) as canonical from every group by all having count(distinct target) = 1"""


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _alias_rows(spark, sf_dir):
    known = fixture(spark, sf_dir, "known_names")
    names = F.array(*[F.lit(r.name) for r in known.orderBy("name").collect()])  # five market segments
    orders = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), "o_orderpriority", names.alias("names"))
    target = F.expr("names[cast((k % 40) % 5 as int)]")
    label = F.when((target == "BUILDING") & ~F.lower("o_orderpriority").contains("low"), "").otherwise(F.concat(F.lit(" "), F.col("o_orderpriority"), F.lit(": ")))
    line = F.concat_ws(",", label, F.concat(F.lit("old"), (F.col("k") % 40).cast("string")), F.lower(target))
    return known, _files(orders.withColumn("f", F.floor(F.col("k") / 64)), "f", "k", line, F.lit("label,name,field_name"))


def semantic_alias_files(spark, sf_dir):
    known, found = _alias_rows(spark, sf_dir)
    return tables.semantic_aliases(tables.csv_rows(found), known)


_query("semantic_alias_files", with_fixtures(_ALIAS_ROWS, "known_names"))(semantic_alias_files)


# --- workbooks --------------------------------------------------------------------------------------------

_XLSX = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def _workbook(rows) -> bytes:
    """A workbook of one sheet: first columns shared, others inline, empty cells left out."""
    shared, body = [], ""
    for n, cells in enumerate(rows, 1):
        body += f'<row r="{n}">'
        for i, cell in enumerate(cells):
            if cell and i:
                body += f'<c r="{chr(65 + i)}{n}" t="inlineStr"><is><t>{cell}</t></is></c>'
            elif cell:
                shared.append(cell)
                body += f'<c r="A{n}" t="s"><v>{len(shared) - 1}</v></c>'
        body += "</row>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {_XLSX}>" + "".join(f"<si><t>{s}</t></si>" for s in shared) + "</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {_XLSX}><sheetData>{body}</sheetData></worksheet>")
    return out.getvalue()


def _workbooks(specs: DataFrame) -> DataFrame:
    cells = F.expr("array(if(seq % 5 = 0, '', concat('root.', name, '[', seq % 3, ']')), if(seq % 7 = 0, concat(name, ' / nothing'), if(seq % 3 = 0, 'gone', upper(name))), if(seq % 2 = 0, 'Direct match', 'Unclear'))")
    held = specs.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("seq", cells.alias("cells")))).alias("rows"))  # one page's

    def build(path, rows):
        yield path, _workbook([("Current field", "Suggested code field", "Status"), *(r["cells"] for r in rows)])

    return map_rows(held.select(F.concat(F.lit("f"), F.col("page").cast("string"), F.lit(".xlsx")).alias("path"), "rows"), build, "path string, content binary")


_SHEET = """--cte c as (select page, case when seq % 5 = 0 then '' else 'root.' || name || '[' || (seq % 3) || ']' end as a,
  case when seq % 7 = 0 then name || ' / nothing' when seq % 3 = 0 then 'gone' else upper(name) end as b, case when seq % 2 = 0 then 'Direct match' else 'Unclear' end as c, seq, name from field_specs),
  s as (select 'f' || page || '.xlsx' as path, 1 + row_number() over (partition by page order by seq, a, b, c) as row, a, b, c, seq, name from c) """


@_query("sheet_cells", _SHEET + "select path, row, a || '|' || b || '|' || c as cells from s union all select distinct path, 1, 'Current field|Suggested code field|Status' from s", "field_specs")
def sheet_cells(specs):
    return tables.sheet_rows(_workbooks(specs)).select("path", "row", F.array_join("cells", "|").alias("cells"))


@_query(
    "sheet_aliases",
    _SHEET
    + """, d as (select a, name from s where c = 'Direct match' and (seq % 7 = 0 or seq % 3 <> 0) and a <> ''),
  e as (select unnest([a, regexp_replace(a, '\\[\\d+\\]', '', 'g'), split_part(regexp_replace(a, '\\[\\d+\\]', '', 'g'), '.', 2)]) as alias, name from d)
  select lower(alias) as alias, min(name) as canonical from e group by lower(alias) having count(distinct name) = 1""",
    "field_specs",
)
def sheet_aliases(specs):
    return tables.mapping_aliases(tables.sheet_rows(_workbooks(specs)), specs.select("name").distinct())


# --- words, layouts, forms --------------------------------------------------------------------------------

_WORDS = """--cte w as (select *, cast(floor(page / 4) as bigint) as doc_id, case when seq % 9 = 0 then '________ a' when seq % 5 = 0 then 'a < b' else text end as word from anchors),
p as (select doc_id, page, row_number() over (partition by doc_id order by page) as n, count(*) as held from w group by doc_id, page),
q as (select w.*, n, (select count(*) from w b where b.doc_id = w.doc_id and (b.page, b.seq) < (w.page, w.seq)) + n as line from w join p using (doc_id, page)) """


def _word_lines(anchors: DataFrame) -> DataFrame:
    text = F.expr("case when seq % 9 = 0 then '________ a' when seq % 5 = 0 then 'a &lt; b' else text end")
    word = F.concat(F.lit('<word xMin="'), F.col("x"), F.lit('" yMin="'), F.col("y"), F.lit('" xMax="'), F.col("x") + 30, F.lit('" yMax="'), F.col("y") + 10, F.lit('">'), text, F.lit("</word>"))
    own = anchors.withColumn("doc_id", F.floor(F.col("page") / 4)).select("doc_id", F.struct("page", "seq", word.alias("line")).alias("s"))
    starts = anchors.select("page").distinct().select(F.floor(F.col("page") / 4).alias("doc_id"), F.struct("page", F.lit(-1).cast("long").alias("seq"), F.concat(F.lit('<page width="612" height="'), 700 + F.col("page") % 3, F.lit('">')).alias("line")).alias("s"))
    held = own.unionByName(starts).groupBy("doc_id").agg(F.array_sort(F.collect_list("s")).alias("s"))  # one document's
    return held.select("doc_id", F.posexplode(F.transform("s", lambda s: s.line)).alias("line", "text"))


@_query("word_boxes", _WORDS + "select doc_id, n as page, line as seq, cast(700 + page % 3 as double) as page_height, word as text, x as x0, y as y0, x + 30 as x1, y + 10 as y1 from q", "anchors")
def word_boxes(anchors):
    return documents.word_boxes(_word_lines(anchors))


@_query("word_anchors", _WORDS + "select doc_id, n as page, line as seq, word as text, x, cast(700 + page % 3 as double) - y - 10 as y from q where seq % 9 > 0", "anchors")
def word_anchors(anchors):
    return documents.word_anchors(documents.word_boxes(_word_lines(anchors)))


@_query(
    "layout_json_items",
    """--cte b as (select *, row_number() over (partition by page order by seq, type, x, y, x + w, y + h) - 1 as i from boxes)
    select page as doc_id, 1 as page, 'word' as kind, i as seq, type as text, cast(case when page % 2 = 0 then 792 else 400 end as double) as page_height,
      x / 2 as x0, y / 2 as y0, (x + w) / 2 as x1, (y + h) / 2 as y1 from (select *, case when page % 2 = 0 then 1.0 else 2.0 end as s from b)
    union all select page, 1, 'mark', i, 'on', cast(case when page % 2 = 0 then 792 else 400 end as double), x / 2, y / 2, (x + w) / 2, (y + h) / 2 from b where w / 2 between 5 and 30 and h / 2 between 5 and 30""",
    "boxes",
)
def layout_json_items(boxes):
    polygon = F.array(F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("h"), F.col("x"), F.col("y") + F.col("h"))
    held = boxes.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("seq", F.struct(F.col("type").alias("text"), polygon.alias("polygon")).alias("w")))).alias("s"))  # one page's
    words = F.transform("s", lambda s: s.w)
    marks = F.transform(words, lambda w: F.struct(F.lit("on").alias("state"), w.polygon.alias("polygon")))
    even = F.col("page") % 2 == 0
    wide, high = F.when(even, 1224.0).otherwise(1000.0), F.when(even, 1584.0).otherwise(800.0)
    one = F.struct(F.lit(1).alias("page"), wide.alias("width"), high.alias("height"), words.alias("words"), F.array().cast("array<struct<text: string, polygon: array<double>>>").alias("lines"), marks.alias("marks"))
    layouts = held.select(F.col("page").alias("doc_id"), F.to_json(F.struct(F.array(one).alias("pages"))).alias("json"))
    sizes = layouts.where("doc_id % 2 = 1").select("doc_id", F.lit(1).alias("page"), F.lit(500.0).alias("width"), F.lit(400.0).alias("height"))
    return documents.layout_items(layouts, sizes)


_DOCS = """--cte f as (select *, cast(floor(page / 4) as bigint) as doc_id from field_specs where page in (select page from pages)),
g as (select *, row_number() over (partition by page order by y desc, x, name, type, w, h) as i from f) """


def _templates(specs, pages):
    doc = lambda df: df.withColumn("doc_id", F.floor(F.col("page") / 4))
    return sinks.templates(doc(specs), doc(pages))


@_query(
    "form_template_sizes",
    _DOCS
    + """, m as (select doc_id, sum(length('<field name="' || name || '"' || format(' x="{:.4f}mm" y="{:.4f}mm" w="{:.4f}mm" h="{:.4f}mm"', x * 0.3528, (792 - y - h) * 0.3528, w * 0.3528, h * 0.3528) || '></field>')
      + length(case type when 'checkbox' then '<ui><checkButton/></ui><items><text>1</text><text>0</text></items>' when 'image' then '<ui><imageEdit/></ui><value><image/></value>'
        else '<ui><textEdit/></ui><font typeface="Arial" size="10pt"/>' end)) as fields from f group by doc_id),
    d as (select cast(floor(page / 4) as bigint) as doc_id, sum(length('<subform name="Page' || page || '"></subform>')) as pages from pages group by 1)
    select doc_id, cast(coalesce(fields, 0) + pages + length('<xdp:xdp xmlns:xdp="http://ns.adobe.com/xdp/"><template xmlns="http://www.xfa.org/schema/xfa-template/2.5/"><subform name="topmostSubform"></subform></template></xdp:xdp>') as int) as chars from d left join m using (doc_id)""",
    "field_specs",
    "pages",
)
def form_template_sizes(specs, pages):
    return _templates(specs, pages).select("doc_id", F.length("xml").alias("chars"))


@_query("form_field_names", _DOCS + "select doc_id, 'Page' || page as page, row_number() over (partition by doc_id order by page, i) - 1 as seq, name from g", "field_specs", "pages")
def form_field_names(specs, pages):
    return documents.form_fields(_templates(specs, pages))


# --- PDF files --------------------------------------------------------------------------------------------


def _flat(items, width: int, height: int, packed: bool) -> bytes:
    """A one-page file that draws boxes, some in white, and writes texts."""
    parts = []
    for i, (x, y, w, h, text) in enumerate(items):
        if text is not None:
            parts.append(f"BT /F1 10 Tf {x} {y} Td ({text}) Tj ET")
        elif i % 3 == 0:
            parts.append(f"q 2 0 0 2 0 0 cm {x / 2} {y / 2} {w / 2} {h / 2} re S Q")
        else:
            parts.append(f"{'1 g ' if w == 50 else '0 g '}{x} {y} {w} {h} re f")
    stream = "\n".join(parts).encode()
    kind, stream = (b" /Filter /FlateDecode", zlib.compress(stream)) if packed else (b"", stream)
    objects = [
        b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 /MediaBox [0 0 %d %d] >>" % (width, height),
        b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R /Resources << /Font << /F1 << /FirstChar 65 /Widths [500 600] >> /F2 << /DescendantFonts [<< /DW 900 /W [3 [250 300] 10 12 %d] >>] >> >> >> >>" % width,
        b"<< /Length %d%s >>\nstream\n%s\nendstream" % (len(stream), kind, stream),
    ]
    return b"%PDF-1.7\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i, o) for i, o in enumerate(objects, 1)) + b"trailer << /Root 1 0 R >>"


def _pdfs(boxes: DataFrame, anchors: DataFrame | None = None) -> DataFrame:
    items = boxes.select("page", "seq", *[F.col(c).cast("int").alias(c) for c in "xywh"], F.lit(None).cast("string").alias("text"))
    if anchors is not None:
        zero = F.lit(0).alias
        items = items.unionByName(anchors.select("page", (F.col("seq") + 10**12).alias("seq"), F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), zero("w"), zero("h"), "text"))

    def build(pages, _, *rows):
        page = pages[0]
        yield f"f{page}.pdf", _flat(zip(*rows), 600 + page % 3, 792, page % 2 == 0)

    return map_groups(items, "page", ["seq", *"xywh", "text"], build, "path string, content binary")


@_query("pdf_page_sizes", "select 'f' || page || '.pdf' as path, 1 as page, cast(600 + page % 3 as double) as width, cast(792 as double) as height from boxes group by page", "boxes")
def pdf_page_sizes(boxes):
    return pdf.page_sizes(_pdfs(boxes))


@_query(
    "pdf_drawn_items",
    """--cte b as (select *, row_number() over (partition by page order by seq, x, y, w, h) - 1 as i from boxes),
    k as (select *, case when w between 6 and 20 and h between 6 and 20 and abs(w - h) / greatest(w, h) < 0.3 then 'checkbox' when w >= 40 and h between 9 and 120 then 'rect' end as kind from b where i % 3 = 0 or w <> 50)
    select 'f' || page || '.pdf' as path, 1 as page, kind, x, y, w, h, null as text from k where kind is not null
    union all select 'f' || page || '.pdf', 1, 'anchor', x, y, 0, 0, text from anchors where page in (select page from boxes)""",
    "boxes",
    "anchors",
)
def pdf_drawn_items(boxes, anchors):
    return pdf.drawn_items(_pdfs(boxes, anchors.join(boxes.select("page").distinct(), "page", "left_semi"))).drop("seq")


def _built(specs: DataFrame, boxes: DataFrame) -> tuple[DataFrame, DataFrame]:
    own = specs.where("w > 0").select(F.concat(F.lit("f"), F.col("page").cast("string"), F.lit(".pdf")).alias("path"), F.lit(1).alias("page"), "name", "type", "x", "y", "w", "h")
    return own, pdf_writer.fillable_files(_pdfs(boxes), own)


@_query(
    "pdf_form_widgets",
    """select 'f' || page || '.pdf' as path, 1 as page, name, case type when 'text' then '/Tx' else '/Btn' end as ft, case type when 'image' then 65536 else 0 end as ff, x, y, w, h,
      case when lower(name) like '%signature%' then 'image' else type end as inferred from field_specs where w > 0 and page in (select page from boxes)""",
    "field_specs",
    "boxes",
    by_page="boxes",
)
def pdf_form_widgets(specs, boxes):
    return widgets.inferred(pdf.widgets(_built(specs, boxes)[1]))


@_query(
    "pdf_widget_issues",
    """--cte s as (select page, name, type, case when page % 50 = 7 then null else page end as kept from field_specs where w > 0),
    n as (select name, count(*) as expected, count(kept) as actual, max(case type when 'image' then 1 else 0 end) as image from s group by name)
    select 'ERROR' as severity, 'field-name-count-mismatch' as code, cast(null as bigint) as page, name as field from n where expected <> actual
    union all select 'ERROR', 'field-count-mismatch', null, null from (select sum(expected) as e, sum(actual) as a from n) where e <> a
    union all select 'WARN', 'pdf-duplicate-name', null, name from n where actual > 1
    union all select 'ERROR', 'pdf-image-button-format', null, s.name from s join n on n.name = s.name where kept is not null and image = 1 and (type <> 'image' or page % 20 = 3)
    union all select 'ERROR', 'pdf-image-signature-format', null, name from s where kept is not null and lower(name) like 'img%signature%' and type <> 'image'
    union all select 'ERROR', 'pdf-field-covers-original-content', null, name from s where kept is not null and type = 'text' and page % 20 = 5
    union all select 'ERROR', 'pdf-checkbox-appearance', null, s.name from s join n on n.name = s.name where kept is not null and type = 'checkbox' and page % 20 = 6""",
    "field_specs",
)
def pdf_widget_issues(specs):
    own = specs.where("w > 0").select("page", "name", "type")
    built = widgets.attributes(own.where("page % 50 <> 7"))
    spoiled = built.withColumn("style", F.when(F.col("page") % 20 != 3, F.col("style"))).withColumn("has_bc", (F.col("page") % 20 == 5) & (F.col("type") == "text"))
    spoiled = spoiled.withColumn("appearances", F.when(F.col("page") % 20 != 6, F.col("appearances")))
    return rules.widget_rules(own, spoiled)


@_query(
    "pdf_font_advances",
    """select seq as id, round(sum((case seq % 3 when 0 then 0.25 when 1 then 0.3 else 0.9 end) + (600 + page % 3) / 1000.0 + 0.9), 6) as em from boxes group by seq""",
    "boxes",
)
def pdf_font_advances(boxes):
    own = boxes.select(F.col("seq").alias("id"), F.concat(F.lit("f"), F.col("page").cast("string"), F.lit(".pdf")).alias("path"), F.lit(1).alias("page"), F.lit("F2").alias("font"))
    units = own.withColumn("code", F.explode(F.array(F.when(F.col("id") % 3 == 2, 99).otherwise((F.col("id") % 3 + 3).cast("int")), F.lit(11), F.lit(77))))
    return pdf.advances(units, pdf.font_widths(_pdfs(boxes))).select("id", F.round("em", 6).alias("em"))


@_query(
    "cid_texts",
    """select seq, case when seq % 4 = 0 then null else repeat(cast(cast(seq % 200 as int) as varchar) || ' ', 9) || cast(cast(seq % 250 as int) as varchar)
      || case when seq % 4 = 1 then ' ' || cast(cast(256 + seq % 250 as int) as varchar) else '' end end as units from boxes""",
    "boxes",
)
def cid_texts(boxes):
    byte = lambda c: F.lpad(F.hex(c.cast("long")), 4, "0")
    digits = F.concat(F.repeat(byte(F.col("seq") % 200), 9), byte(F.col("seq") % 250), F.when(F.col("seq") % 4 == 1, byte(256 + F.col("seq") % 250)).when(F.col("seq") % 4 == 0, F.lit("00")).otherwise(""))
    return boxes.select("seq", F.array_join(pdf.cid_units(F.unhex(digits)), " ").alias("units"))


# --- whole tasks ------------------------------------------------------------------------------------------


@_query(
    "placement_check",
    """--cte f as (select distinct page, name, x, y, w, h, x as l, least(width, x + w) as r, height - y as base, greatest(0, height - y - h) as top, height from field_specs join pages using (page) where type = 'text'),
    n as (select f.*, row, "end" - "begin" as lw, row_number() over (partition by page, name, x, y, w, h order by least("end", r) - greatest("begin", l) desc, "end" - "begin" desc, abs(row - base), row, "begin") as rank
      from f join ink using (page) where "end" - "begin" >= 8 and abs(row - base) <= 2 and least("end", r) > greatest("begin", l)),
    m as (select f.*, n.row as line, n.lw from f left join n on rank = 1 and (n.page, n.name, n.x, n.y, n.w, n.h) = (f.page, f.name, f.x, f.y, f.w, f.h)),
    p as (select m.page, m.name, m.x, m.y, m.w, m.h from m join ink on ink.page = m.page and ink.row >= top and ink.row < line - 2 and least("end", r) > greatest("begin", l)
      group by m.page, m.name, m.x, m.y, m.w, m.h, (line - 2 - top) * (r - l) having sum(least("end", r) - greatest("begin", l)) > greatest(12, floor((line - 2 - top) * (r - l) * 0.002)))
    select page, name, x, y, w, h, height - line as line_y, concat_ws(',', case when line is null then 'no-underline' end, case when abs(height - line - y) > 2 then 'bottom-off-line' end,
      case when abs(lw - w) > greatest(5, w * 0.1) then 'width-off-line' end, case when (page, name, x, y, w, h) in (select (page, name, x, y, w, h) from p) then 'printed-text-above' end) as warnings from m""",
    "field_specs",
    "ink",
    "pages",
)
def placement_check(specs, ink, pages):
    return forms.placement(specs, ink, pages, dpi=72.0).withColumn("warnings", F.array_join("warnings", ","))


@_query("ink_skipped", "select 'WARN' as severity, 'original-content-check-skipped' as code, page, null as field from pages where page in (select page from field_specs where type in ('text', 'image')) and page not in (select page from ink where page % 7 > 0)", "field_specs", "ink", "pages")
def ink_skipped(specs, ink, pages):
    return rules.ink_skipped(specs, ink.where("page % 7 > 0"), pages)


def _wider(found: DataFrame) -> DataFrame:
    """Files of which some have a wider page."""
    page = F.regexp_extract("path", r"(\d+)", 1).cast("long")
    box = F.concat(F.lit("MediaBox [0 0 "), (600 + page % 3).cast("string"))
    wide = F.replace(F.hex("content"), F.hex(F.encode(box, "UTF-8")), F.hex(F.encode(F.concat(F.lit("MediaBox [0 0 "), (610 + page % 3).cast("string")), "UTF-8")))
    return found.withColumn("content", F.when(page % 9 == 4, F.unhex(wide)).otherwise(F.col("content")))


@_query(
    "transferred_fields",
    """select 'f' || page || '.pdf' as path, 1 as page, name, case when lower(name) like '%signature%' then 'image' else type end as type, x, y, w, h from field_specs where w > 0 and page % 9 <> 4 and page in (select page from boxes)""",
    "field_specs",
    "boxes",
    by_page="boxes",
)
def transferred_fields(specs, boxes):
    files, _ = forms.transferred(_built(specs, boxes)[1], _wider(_pdfs(boxes)))
    return forms.extracted(files).drop("value")


@_query("transfer_mismatches", "select 'f' || page || '.pdf' as path, 1 as page, 'page-size' as reason from field_specs where w > 0 and page % 9 = 4 and page in (select page from boxes) group by page", "field_specs", "boxes", by_page="boxes")
def transfer_mismatches(specs, boxes):
    return forms.transferred(_built(specs, boxes)[1], _wider(_pdfs(boxes)))[1]


@_query(
    "replaced_form_pages",
    _DOCS
    + """, n as (select doc_id, page, name, i from g where page % 3 > 0 union all select cast(floor(page / 4) as bigint), page, 'new' || i, i from pages, (select unnest([1, 2]) as i) where page % 3 = 0)
    select doc_id, 'Page' || page as page, row_number() over (partition by doc_id order by page, i) - 1 as seq, name from n""",
    "field_specs",
    "pages",
)
def replaced_form_pages(specs, pages):
    page = F.concat(F.lit("Page"), F.col("page").cast("string"))
    fragment = F.concat(F.lit('<subform name="'), page, F.lit('"><field name="new1"/><area><field name="new2"/></area></subform>'))
    fragments = pages.where("page % 3 = 0").select(F.floor(F.col("page") / 4).alias("doc_id"), page.alias("page"), fragment.alias("xml"))
    return documents.form_fields(forms.replaced_pages(_templates(specs, pages), fragments), descendants=True)


def _with_templates(boxes: DataFrame) -> DataFrame:
    found = _pdfs(boxes)
    xml = F.concat(F.lit("<template><subform name='"), F.col("path"), F.lit("'/></template>"))
    some = found.where("path like '%2.pdf' or path like '%7.pdf'").select("path", xml.alias("xml"))
    return forms.embedded(found, some).unionByName(found.join(some, "path", "left_anti").select("path", "content"))


@_query("embedded_templates", """select 'f' || page || '.pdf' as path, 'template' as name, '<template><subform name=''f' || page || '.pdf''/></template>' as xml from boxes where page % 10 in (2, 7) group by page""", "boxes")
def embedded_templates(boxes):
    return pdf.template_packet(pdf.form_packets(_with_templates(boxes))).drop("seq")


@_query("stripped_files", "select 'f' || page || '.pdf' as path, page % 10 in (2, 7) as had_form, false as has_form, 1 as pages from boxes group by page", "boxes")
def stripped_files(boxes):
    out = forms.stripped(_with_templates(boxes))
    held = pdf.form_packets(out).select("path", F.lit(True).alias("has_form")).distinct()
    sizes = pdf.page_sizes(out).groupBy("path").agg(F.count(F.lit(1)).alias("pages"))
    return out.join(held, "path", "left").join(sizes, "path").select("path", "had_form", F.coalesce("has_form", F.lit(False)).alias("has_form"), "pages")


# --- reports ----------------------------------------------------------------------------------------------

_MAPPED = "--cte m as (select *, case when seq % 3 = 0 then 'label ' || (seq % 10) else '' end as label, seq % 4 > 0 as matched, case when seq % 4 > 0 then 'exact' else 'generated' end as method from field_specs) "


def _mapped(specs):
    return specs.select("*", F.expr("if(seq % 3 = 0, concat('label ', seq % 10), '')").alias("label"), F.expr("seq % 4 > 0").alias("matched"), F.expr("if(seq % 4 > 0, 'exact', 'generated')").alias("method"))


@_query("mapping_report", _MAPPED + "select page, name, type, x, y, w, h, label as detected_label, case when matched then 'yes' else 'no' end as known_name_matched, method as match_method from m", "field_specs")
def mapping_report(specs):
    return reports.mapping_rows(_mapped(specs))


@_query("match_rate", _MAPPED + "select format('Field names: {} of {} matched; the others keep generated names and need mapping.', count(*) filter (matched), count(*)) as message from m", "field_specs")
def match_rate(specs):
    return reports.match_rate(_mapped(specs))


@_query("conversion_rows", _MAPPED + "select name as original_name, upper(name) as canonical_name, case when matched then 'yes' else 'no' end as matched, case when seq % 2 = 0 then 'yes' else 'no' end as changed, method from m", "field_specs")
def conversion_rows(specs):
    return sinks.yes_no(_mapped(specs).select(F.col("name").alias("original_name"), F.upper("name").alias("canonical_name"), "matched", F.expr("seq % 2 = 0").alias("changed"), "method"))


_LAYOUT = """--cte items as (select page, 'mark' as item_type, x, y, cast(null as double) as w, h, p_name as text from boxes join part on p_partkey = seq % 40 + 1 where seq % 5 = 0),
names as (select distinct p_name as name from part where p_partkey <= 30),
words as (select text, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{2,}'))) as word from (select distinct text from items)),
tokens as (select name, unnest(list_distinct(regexp_extract_all(lower(name), '[a-z0-9]{2,}'))) as word from names),
sizes as (select text as t, count(*) as n from words group by text), lengths as (select name, count(*) as n from tokens group by name),
scores as (select text, tokens.name, count(*) / greatest(any_value(sizes.n), any_value(lengths.n)) as score from words join tokens using (word) join sizes on sizes.t = text join lengths on lengths.name = tokens.name group by text, tokens.name),
best as (select text, string_agg(name, ';' order by score desc, name) as names from (select *, row_number() over (partition by text order by score desc, name) as place from scores) where place <= 5 group by text),
rows as (select cast(page as varchar) as page, item_type, items.text as text_or_label, format('{:.2f}', x) as x, format('{:.2f}', y) as y, '' as w, format('{:.2f}', h) as h, coalesce(names, '') as suggested_names from items left join best on best.text = items.text) """


def _layout(spark, sf_dir):
    part = _read(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("text"))
    boxes = fixture(spark, sf_dir, "boxes").where("seq % 5 = 0")
    items = boxes.join(part, F.col("p_partkey") == F.col("seq") % 40 + 1).select("page", F.lit("mark").alias("item_type"), "x", "y", F.lit(None).cast("double").alias("w"), "h", "text")
    return reports.layout_rows(items, part.where("p_partkey <= 30").select(F.col("text").alias("name")).distinct())


def layout_report(spark, sf_dir):
    return _layout(spark, sf_dir)


def layout_report_json(spark, sf_dir):
    found = sinks.layout_json(_layout(spark, sf_dir), 30, ["slow"])
    kind = "struct<known_field_count: int, warnings: array<string>, rows: array<struct<page: string, x: string>>>"
    read = F.from_json("json", kind)
    return found.select("page", read["known_field_count"].alias("names"), F.array_join(read["warnings"], ",").alias("warnings"), F.size(read["rows"]).alias("n"))


_query("layout_report", with_fixtures(_LAYOUT + "select * from rows", "boxes"))(layout_report)
_query("layout_report_json", with_fixtures(_LAYOUT + "select page, 30 as names, 'slow' as warnings, cast(count(*) as int) as n from rows group by page", "boxes"))(layout_report_json)

# --- labels -----------------------------------------------------------------------------------------------

_FROM, _TO = "abdefghiklmnoprstuvwxyz", "אבדהפגחיקלמנועפרסתוטצזש"


def hebrew_labels(spark, sf_dir):
    label = F.translate("p_name", _FROM, _TO)
    latin = F.translate(label, "".join(chr(0x05D0 + i) for i in range(27)), "".join(chr(0xE0 + i) for i in range(27)))
    part = _read(spark, sf_dir, "part")
    own = part.select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(label).alias("label"), F.when(F.col("p_partkey") % 2 == 0, latin).otherwise(F.lit("à b")).alias("latin"))
    return own.select("p_partkey", T.has_hebrew(F.col("label")).alias("hebrew"), F.reverse("label").alias("turned"), T.repaired_hebrew(F.col("latin")).alias("repaired"), F.array_join(T.label_keys(F.col("label")), "|").alias("keys"))


_query(
    "hebrew_labels",
    f"""with l as (select p_partkey, case when p_partkey % 3 = 0 then p_name else translate(p_name, '{_FROM}', '{_TO}') end as label, translate(p_name, '{_FROM}', '{_TO}') as own from part),
    n as (select *, p_partkey % 3 > 0 as hebrew, trim(regexp_replace(lower(label), '[\\s:-]+', ' ', 'g')) as key, trim(regexp_replace(lower(reverse(label)), '[\\s:-]+', ' ', 'g')) as back from l)
    select p_partkey, hebrew, reverse(label) as turned, case when p_partkey % 2 = 0 then own else chr(224) || ' b' end as repaired,
      array_to_string([k for k in [key, case when position(' ' in key) = 0 and length(key) > 3 and key[1] in ('ב', 'ה', 'ל') then key[2:] else '' end,
        case when hebrew and back <> key then back else '' end, case when hebrew and position(' ' in back) = 0 and length(back) > 3 and back[1] in ('ב', 'ה', 'ל') then back[2:] else '' end] if k <> ''], '|') as keys from n""",
)(hebrew_labels)


_SIGNED = ("Signature:", "sign", "(חתימה)", "המיתח", "design by", "by", "Name of owner", "החתום מטה", "Sign here please", "12 34", "חתם", "signed on")


def signature_words(spark, sf_dir):
    word = F.element_at(F.array(*map(F.lit, _SIGNED)), (F.col("o_orderkey") % len(_SIGNED) + 1).cast("int"))
    own = _read(spark, sf_dir, "orders").select("o_orderkey", word.alias("word"))
    return own.select("o_orderkey", signatures.context_direction(F.col("word")).alias("near"), signatures.word_direction(F.col("word")).alias("alone"), signatures.label_direction(F.col("word")).alias("first"), signatures.may_become_image(F.col("word")).alias("image"))


_query(
    "signature_words",
    """with s(i, near, alone, first, image) as (values (0, 'ltr', 'ltr', 'ltr', true), (1, 'ltr', 'ltr', 'ltr', true), (2, 'rtl', 'rtl', 'rtl', true), (3, 'rtl', 'rtl', 'rtl', true),
      (4, 'ltr', 'ltr', null, false), (5, null, null, null, true), (6, null, null, null, false), (7, 'rtl', null, 'rtl', true), (8, 'ltr', 'ltr', 'ltr', true), (9, null, null, null, true), (10, 'rtl', 'rtl', 'rtl', true), (11, 'ltr', 'ltr', 'ltr', true))
    select o_orderkey, near, alone, first, image from orders join s on s.i = o_orderkey % 12""",
)(signature_words)
