"""Registered queries of the form operators over the fixtures, each with its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.functions import geometry as G
from quillgrid.functions import text as T
from quillgrid.operators import cluster, naming, patterns, resolve, rules, spatial
from quillgrid.plans.fixtures import fixture, with_fixtures

Query = Callable[[SparkSession, str], DataFrame]
FLAGSHIP = "issue_summary"
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(name: str, sql: str, *fixtures: str, by_page: str | None = None):
    """Registers a function of the fixtures' tables, one of them dealt by page, or of (spark, sf_dir) without fixtures."""

    def add(f):
        if fixtures:
            _QUERIES[name] = lambda spark, sf_dir: f(*[fixture(spark, sf_dir, n, n == by_page) for n in fixtures])
            _SQL[name] = with_fixtures(sql, *fixtures)
        else:
            _QUERIES[name] = f
            _SQL[name] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    from quillgrid.plans import source_queries  # noqa: F401  (registers its own)

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from quillgrid.plans import source_queries  # noqa: F401

    return dict(_SQL)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_BOX = "a.page, a.seq, a.x, a.y, a.w, a.h, a.type"
_OVERLAP = "a.page = b.page and a.x < b.x + b.w and a.x + a.w > b.x and a.y < b.y + b.h and a.y + a.h > b.y"
_LEN = r"length(regexp_replace(b.text, '[^\p{L}\p{Nd}]', '', 'g'))"
_NUMBER = r"regexp_full_match(b.text, '\s*\d+(\.\d+)*\.?\s*')"

# --- rules ---------------------------------------------------------------------------------------------


@_query("dup_cell", "select page, name, x, y, w, h, count(*) as n from field_specs group by all having count(*) > 1", "field_specs")
def dup_cell(specs):
    return rules.duplicate_cells(specs)


@_query(
    "dup_name",
    "select name, count(*) as n, count(distinct type) as types from field_specs group by name having count(*) > 1",
    "field_specs",
)
def dup_name(specs):
    return specs.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("type").alias("types")).where("n > 1")


_ROW_RULES = """
  select 'ERROR' as severity, 'invalid-page' as code, cast(null as bigint) as page, name as field from field_specs where page < 1
  union all select 'ERROR', 'invalid-size', page, name from field_specs where w <= 0 or h <= 0
  union all select 'WARN', 'small-text-height', page, name from field_specs where w > 0 and h > 0 and type in ('text', 'textarea') and h < 10
  union all select 'WARN', 'small-textarea-height', page, name from field_specs where w > 0 and h > 0 and type = 'textarea' and h < 16
  union all select 'WARN', 'checkbox-size', page, name from field_specs where w > 0 and h > 0 and type = 'checkbox' and (w < 6 or h < 6 or w > 30 or h > 30)
  union all select 'WARN', 'small-image-field', page, name from field_specs where w > 0 and h > 0 and type = 'image' and (w < 20 or h < 12)
  union all select 'WARN', 'small-beneficiary-field', page, name from field_specs where w > 0 and h > 0 and name like 'txtBeneficiary%' and h < 20
  union all select 'ERROR', 'signature-format', page, name from field_specs where lower(name) like 'img%signature%' and type <> 'image'
  union all select 'WARN', 'image-name-format', page, name from field_specs where type = 'image' and name not like 'img%'
"""


@_query("size_rules", f"select * from ({_ROW_RULES})", "field_specs")
def size_rules(specs):
    return rules.row_rules(specs)


_NAME_RULES = """
  select 'WARN' as severity, 'duplicate-name' as code, cast(null as bigint) as page, name as field from field_specs group by name having count(*) > 1
  union all select 'WARN', 'duplicate-name-mixed-types', null, name from field_specs group by name having count(*) > 1 and count(distinct type) > 1
  union all select 'WARN', 'duplicate-signature-name', null, name from field_specs where lower(name) like 'img%signature%' group by name having count(*) > 1
"""


@_query("name_rules", f"select * from ({_NAME_RULES})", "field_specs")
def name_rules(specs):
    return rules.duplicate_rules(specs)


_CELLS = r"""--cte cells as (select distinct page, cast(regexp_extract(name, '^txtBeneficiary(\d+)', 1) as int) as row, regexp_extract(name, '^txtBeneficiary\d+(.*)$', 1) as col
  from field_specs where name like 'txtBeneficiary%'),
cols as (select unnest(['Name', 'ID', 'DOB', 'CitizenshipCountry', 'TaxResidencyCountry', 'BenefitPercent']) as col),
wanted as (select page, first + i as row, col from (select page, min(row) as first from cells group by page), (select unnest([0, 1, 2]) as i), cols),
gaps as (select page, row, col from wanted except select page, row, col from cells),
lacks as (select page, row, cols.col from (select distinct page, row from cells), cols except select page, row, col from cells)
"""


@_query("missing_cells", _CELLS + 'select page, row, col from gaps', "field_specs")
def missing_cells(specs):
    return rules.missing_cells(rules.beneficiary_cells(specs)).withColumnRenamed("column", "col")


@_query("missing_columns", _CELLS + "select page, row, string_agg(col, ',' order by col) as missing from lacks group by page, row", "field_specs")
def missing_columns(specs):
    found = rules.missing_columns(rules.beneficiary_cells(specs))
    return found.select("page", "row", F.array_join("missing", ",").alias("missing"))


_BOUNDS = """
  select 'ERROR' as severity, 'page-out-of-range' as code, f.page, f.name as field from field_specs f where f.page >= 1 and f.page not in (select page from pages)
  union all select 'ERROR', 'field-out-of-page', f.page, f.name from field_specs f join pages p on p.page = f.page
  where x < 0 or y < 0 or x + w > width + 0.5 or y + h > height + 0.5
"""


@_query("field_out_of_page", f"select * from ({_BOUNDS})", "field_specs", "pages")
def field_out_of_page(specs, pages):
    return rules.bounds_rules(specs, pages)


_ALL_RULES = f"""{_CELLS}, issues as ({_ROW_RULES} union all {_NAME_RULES} union all {_BOUNDS}
  union all select 'ERROR', 'duplicate-cell', page, name from (select page, name from field_specs group by page, name, x, y, w, h having count(*) > 1)
  union all select 'ERROR', 'incomplete-beneficiary-table', page, null from (select distinct page from gaps)
  union all select 'ERROR', 'incomplete-beneficiary-row', page, null from (select distinct page, row from lacks))
"""


@_query("issue_summary", _ALL_RULES + "select severity, code, count(*) as n from issues group by severity, code", "field_specs", "pages")
def issue_summary(specs, pages):
    return rules.summary(rules.validate(specs, pages))


@_query("verdict", _ALL_RULES + "select count(*) filter (severity = 'ERROR') as errors, count(*) filter (severity = 'WARN') as warnings, count(*) > 0 as failed from issues", "field_specs", "pages")
def verdict(specs, pages):
    return rules.verdict(rules.validate(specs, pages), strict=True)


@_query(
    "field_over_ink",
    """--cte f as (select page, name, x, y, w, h, seq, type, least(3.0, w / 4, h / 4) as m, width, height from field_specs join pages using (page) where type in ('text', 'image')),
g as (select *, greatest(0, least(cast(round_even(x + m, 0) as int), cast(width as int))) as l, greatest(0, least(cast(round_even(x + w - m, 0) as int), cast(width as int))) as r,
  greatest(0, least(cast(round_even(height - y - h + m, 0) as int), cast(height as int))) as t, greatest(0, least(cast(round_even(height - y - m, 0) as int), cast(height as int))) as b from f),
q as (select distinct page, name, x, y, w, h, l, r, t, b from g where r > l and b > t),
u as (select page, name, x, y, w, h, (select sum(least(i."end", q.r) - greatest(i.begin, q.l)) from (select distinct * from ink) i where i.page = q.page and i.row >= q.t and i.row < q.b and i.begin < q.r and i."end" > q.l) as dark, (r - l) * (b - t) as area from q)
select 'WARN' as severity, 'field-over-original-content' as code, page, name as field from u where dark >= 20 and dark >= area * 0.08""",
    "field_specs", "pages", "ink",
)
def field_over_ink(specs, pages, ink):
    return rules.ink_rules(specs.dropDuplicates(["page", "name", "x", "y", "w", "h"]), ink.distinct(), pages)


@_query(
    "count_compare",
    """--cte a as (select name, count(*) as expected from field_specs group by name), b as (select name, count(*) as actual from field_specs where type <> 'image' group by name)
select coalesce(a.name, b.name) as name, coalesce(expected, 0) as expected, coalesce(actual, 0) as actual from a full join b on a.name = b.name where coalesce(expected, 0) <> coalesce(actual, 0)""",
    "field_specs",
)
def count_compare(specs):
    return rules.count_compare(specs, specs.where("type <> 'image'"))


@_query("type_counts", "select type, count(*) as n from field_specs group by type", "field_specs")
def type_counts(specs):
    return specs.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@_query("page_field_counts", "select p.page, count(f.name) as n from pages p left join field_specs f on f.page = p.page group by p.page", "pages", "field_specs")
def page_field_counts(pages, specs):
    return pages.select("page").join(specs.select("page", "name"), "page", "left").groupBy("page").agg(F.count("name").alias("n"))


@_query(
    "widget_attributes",
    """select page, name, x, y, w, h, case type when 'text' then '/Tx' else '/Btn' end as ft, case type when 'image' then 65536 else 0 end as ff,
  case when type = 'image' or lower(name) like '%signature%' then 'image' when type = 'checkbox' then 'checkbox' else 'text' end as inferred from field_specs""",
    "field_specs",
)
def widget_attributes(specs):
    from quillgrid.operators import widgets

    return widgets.inferred(widgets.attributes(specs)).select("page", "name", "x", "y", "w", "h", "ft", "ff", "inferred")


# --- spatial joins -------------------------------------------------------------------------------------


@_query("overlap_anti", f"select {_BOX} from boxes a where type = 'text' and not exists (select 1 from boxes b where b.type = 'image' and {_OVERLAP})", "boxes")
def overlap_anti(boxes):
    return spatial.not_overlapping(boxes.where("type = 'text'"), boxes.where("type = 'image'"))


@_query("overlap_pairs", f"select a.page, count(*) as n from boxes a join boxes b on a.type = 'text' and b.type = 'image' and {_OVERLAP} group by a.page", "boxes")
def overlap_pairs(boxes):
    pairs = spatial.overlapping_pairs(boxes.where("type = 'text'"), boxes.where("type = 'image'"))
    return pairs.groupBy(F.col("a.page").alias("page")).agg(F.count(F.lit(1)).alias("n"))


@_query("point_in_box", f"select {_BOX} from boxes a where exists (select 1 from anchors b where b.page = a.page and b.x between a.x and a.x + a.w and b.y between a.y and a.y + a.h)", "boxes", "anchors")
def point_in_box(boxes, anchors):
    return spatial.containing(boxes, anchors)


@_query(
    "nearest_label",
    f"""--cte s as (select {_BOX}, b.seq as bs, b.text, case when a.y - b.y > 0 and a.y - b.y <= 28 and b.x between a.x - 10 and a.x + a.w + 10 then (a.y - b.y) + abs(b.x - (a.x + a.w / 2)) * 0.1
   when b.y - (a.y + a.h) >= -a.h then greatest(a.x - b.x, b.x - (a.x + a.w), 0) + abs(b.y - (a.y + a.h)) + abs(b.x - (a.x + a.w / 2)) * 0.1 end as score
   from boxes a join anchors b on a.page = b.page and {_LEN} > 0 and not {_NUMBER}),
best as (select page, seq, x, y, w, h, type, arg_min(text, (score, bs)) as label from s where score is not null group by all)
select {_BOX}, coalesce(best.label, '') as label from boxes a left join best using (page, seq, x, y, w, h, type)""",
    "boxes", "anchors",
)
def nearest_label(boxes, anchors):
    return spatial.nearest_label(boxes, anchors)


_BELOW = "b.page = a.page and b.x between a.x - 10 and a.x + a.w + 10 and b.y >= a.y - 28 and b.y < a.y"
_BESIDE = """b.page = a.page and b.y between a.y - 10 and a.y + case when a.h <= 12 and a.w > 220 then 8.0 else a.h + 12 end
  and (a.x - b.x between 0 and 180 or b.x - (a.x + a.w) between 0 and 180)"""
_SHORT = f"group by all having count(*) <= 3 and max(b.y) - min(b.y) <= 5 and sum({_LEN}) between 2 and"


def _short(test: str, longest: int, boxes: str = "boxes") -> str:
    return f"select {_BOX} from {boxes} a join anchors b on {test} and {_LEN} > 0 and not {_NUMBER} {_SHORT} {longest}"


_CONFLICT = f"""inside as (select {_BOX} from boxes a where exists (select 1 from anchors b where b.page = a.page and b.x between a.x + 2 and a.x + a.w - 2 and b.y between a.y + 2 and a.y + a.h - 2)),
shorts as ({_short(_BELOW, 80)}),
under as (select {_BOX} from boxes a where exists (select 1 from anchors b where {_BELOW} and {_LEN} > 0)),
conflict as (select * from inside union (select * from under except select * from shorts))
"""


@_query("label_context", f"select * from ({_short(_BELOW, 80)}) union select * from ({_short(_BESIDE, 40)})", "boxes", "anchors")
def label_context(boxes, anchors):
    return spatial.with_label(boxes, anchors)


@_query("text_conflicts", f"--cte {_CONFLICT} select * from conflict", "boxes", "anchors")
def text_conflicts(boxes, anchors):
    return spatial.with_conflict(boxes, anchors)


_PEERS = "b.page = a.page and abs(a.y - b.y) <= 2 and abs(a.h - b.h) <= 3"
_COLUMN = "b.page = a.page and abs(a.x - b.x) <= 2 and abs(a.w - b.w) <= 3 and abs(a.h - b.h) <= 6"


@_query("row_peers", f"select {_BOX}, count(*) as peers from boxes a join boxes b on a.w <= 220 and b.w <= 220 and {_PEERS} group by all", "boxes")
def row_peers(boxes):
    return spatial.row_peers(boxes)


@_query("column_cells", f"select {_BOX}, count(*) as cells from boxes a join boxes b on {_COLUMN} group by all", "boxes")
def column_cells(boxes):
    return spatial.column_cells(boxes)


_STACKED = f"""flat as (select * from boxes where h <= 12 and w >= 180),
ys as (select {_BOX}, list_sort(list(b.y)) as ys from flat a join flat b on a.page = b.page and abs(a.x - b.x) <= 8 and abs(a.w - b.w) <= 12 group by all),
tops as (select page, seq, x, y, w, h, type, list_max(ys) as top from ys where len(ys) >= 2 and list_max(ys) - list_min(ys) <= 80
  and len(list_filter(range(2, len(ys) + 1), lambda i: ys[i] - ys[i - 1] between 8 and 24)) > 0),
stacked as (select {_BOX} from tops a where exists (select 1 from anchors b where b.page = a.page and {_LEN} > 0 and not {_NUMBER} and b.x between a.x - 40 and a.x + a.w + 40 and b.y > a.top and b.y <= a.top + 40))
"""


@_query("stacked_lines", f"--cte {_STACKED} select * from stacked", "boxes", "anchors")
def stacked_lines(boxes, anchors):
    return spatial.stacked_lines(boxes, anchors)


@_query(
    "fillable_boxes",
    f"""--cte {_CONFLICT}, {_STACKED}, free as (select * from boxes except select * from conflict),
blank as (select * from free where not (h <= 12 and w >= 450)),
direct as (select * from ({_short(_BELOW, 80, "blank")}) union select * from ({_short(_BESIDE, 40, "blank")})),
rows_ as (select {_BOX} from free a join free b on a.w <= 220 and b.w <= 220 and {_PEERS} group by all having count(*) between 2 and 3),
peer as (select {_BOX} from rows_ a where exists (select 1 from direct b where {_PEERS} and b.w <= 220 and (a.seq, a.x, a.y, a.w, a.h, a.type) <> (b.seq, b.x, b.y, b.w, b.h, b.type))),
above as (select {_BOX} from blank a where w <= 180 and h <= 20 and exists (select 1 from anchors b where b.page = a.page and {_LEN} > 0 and not {_NUMBER} and b.y - (a.y + a.h) > 0 and b.y - (a.y + a.h) <= 12 and b.x between a.x - 10 and a.x + a.w + 10)),
cells as (select {_BOX} from free a join free b on {_COLUMN} group by all having count(*) >= 3),
tabled as (select {_BOX} from cells a where w <= 220 and h <= 32 and exists (select 1 from conflict b where b.page = a.page and abs(a.y - b.y) <= 3 and abs(a.h - b.h) <= 6 and (a.seq, a.x, a.y, a.w, a.h, a.type) <> (b.seq, b.x, b.y, b.w, b.h, b.type))),
every as (select *, 0 as i, 'direct' as stage from direct union all select *, 1, 'stacked' from stacked union all select *, 2, 'peer' from peer union all select *, 3, 'above' from above union all select *, 4, 'table' from tabled)
select page, seq, x, y, w, h, type, arg_min(stage, i) as stage from every where (page, seq, x, y, w, h, type) in (select (page, seq, x, y, w, h, type) from blank) group by page, seq, x, y, w, h, type""",
    "boxes", "anchors",
)
def fillable_boxes(boxes, anchors):
    return spatial.fillable(boxes, anchors)


@_query(
    "source_priority",
    f"""--cte t as (select * from boxes where type = 'text'), c as (select {_BOX} from boxes a where type = 'checkbox' and not exists (select 1 from t b where {_OVERLAP})),
i as (select {_BOX} from boxes a where type = 'image' and not exists (select 1 from t b where {_OVERLAP}) and not exists (select 1 from c b where {_OVERLAP}))
select *, 'geometry' as source from t union all select *, 'underline' from c union all select *, 'visual' from i""",
    "boxes",
)
def source_priority(boxes):
    part = lambda t: boxes.where(F.col("type") == t)
    return spatial.by_priority([("geometry", part("text")), ("underline", part("checkbox")), ("visual", part("image"))])


@_query(
    "grouped_checkboxes",
    f"""select {_BOX} from boxes a where exists (select 1 from boxes b where b.page = a.page and abs(a.w - b.w) <= 3 and abs(a.h - b.h) <= 3 and (
  (abs(a.x - b.x) <= greatest(4, least(a.w, b.w) * 0.5) and greatest(a.y - b.y - b.h, b.y - a.y - a.h, 0) > 0 and greatest(a.y - b.y - b.h, b.y - a.y - a.h, 0) <= 40)
  or (abs(a.y - b.y) <= greatest(4, least(a.h, b.h) * 0.5) and greatest(a.x - b.x - b.w, b.x - a.x - a.w, 0) > 0 and greatest(a.x - b.x - b.w, b.x - a.x - a.w, 0) <= 50)))""",
    "boxes",
)
def grouped_checkboxes(boxes):
    return spatial.grouped_checkboxes(boxes)


@_query(
    "context_rows",
    """--cte m as (select b.cid, a.page, a.name, a.x, a.y, a.w, a.h, a.seq, a.type, case when b.y between a.y and a.y + a.h then 0.0 else least(abs(b.y - a.y), abs(b.y - (a.y + a.h))) end as far
  from field_specs a join contexts b on a.page = b.page and a.type = 'text' and a.w >= 70 and case when abs(b.y - a.y) <= 8 then
   (b.direction <> 'rtl' or b.x0 - (a.x + a.w) between 0 and 90) and (b.direction <> 'ltr' or a.x - b.x1 between 0 and 90)
   else case when b.y between a.y and a.y + a.h then 0.0 else least(abs(b.y - a.y), abs(b.y - (a.y + a.h))) end <= 50 and greatest(a.x - b.x1, b.x0 - (a.x + a.w), 0) <= 300 end),
r as (select *, min(far) over (partition by cid) as nearest from m), k as (select *, count(*) over (partition by cid) as n from r where abs(far - nearest) <= 3)
select cid, page, name, x, y, w, h, seq, type, far from k where n >= 2 or nearest <= 50""",
    "field_specs", "contexts",
)
def context_rows(specs, contexts):
    return spatial.context_rows(specs, contexts)


@_query("synthesis_anchors", "select a.* from anchors a where not exists (select 1 from boxes b where b.page = a.page and a.y between b.y - 10 and b.y + b.h + 10 and abs(b.x - a.x) <= 300)", "anchors", "boxes")
def synthesis_anchors(anchors, boxes):
    return spatial.without_box_on_line(anchors, boxes)


@_query(
    "square_from_segments",
    """--cte f as (select * from segments where abs(y0 - y1) <= 0.5), v as (select * from segments where abs(x0 - x1) <= 0.5),
q as (select distinct b.page, b.x0 as x, b.y0 as y, b.x1 - b.x0 as w, t.y0 - b.y0 as h from f b join f t on t.page = b.page and abs(t.x0 - b.x0) <= 1 and abs(t.x1 - b.x1) <= 1 and t.y0 > b.y0)
select * from q where w between 6 and 20 and h between 6 and 20 and abs(w - h) / greatest(w, h) < 0.3
  and exists (select 1 from v where v.page = q.page and abs(v.x0 - q.x) <= 1 and abs(v.y0 - q.y) <= 1 and abs(v.y1 - q.y - q.h) <= 1)
  and exists (select 1 from v where v.page = q.page and abs(v.x0 - q.x - q.w) <= 1 and abs(v.y0 - q.y) <= 1 and abs(v.y1 - q.y - q.h) <= 1)""",
    "segments",
)
def square_from_segments(segments):
    return spatial.squares(segments)


@_query(
    "uncovered_lines",
    """--cte l as (select distinct page, x, y, w from boxes where type = 'checkbox')
select a.* from l a where not exists (select 1 from boxes b where b.type = 'text' and b.page = a.page and abs(a.x - b.x) <= 5 and abs(a.w - b.w) <= 5 and a.y between b.y - 20 and b.y + b.h + 20)""",
    "boxes",
)
def uncovered_lines(boxes):
    return spatial.uncovered_lines(boxes.where("type = 'checkbox'").select("page", "x", "y", "w"), boxes.where("type = 'text'"))


@_query("page_partition", "select f.page, count(*) as n from field_specs f join pages p on p.page = f.page group by f.page", "field_specs", "pages")
def page_partition(specs, pages):
    return specs.join(pages.select("page"), "page").groupBy("page").agg(F.count(F.lit(1)).alias("n"))


# --- order-dependent operators -------------------------------------------------------------------------


@_query(
    "gap_cluster",
    """--cte d as (select distinct page, x from boxes), n as (select *, case when x - lag(x) over (partition by page order by x) > 3 then 1 else 0 end as new from d),
c as (select *, sum(new) over (partition by page order by x rows unbounded preceding) as cluster from n)
select page, x, round(avg(x) over (partition by page, cluster), 2) as snapped from c""",
    "boxes",
)
def gap_cluster(boxes):
    return cluster.snapped(boxes)


for _dialect, _suffix in (("underscore", "'_' || n"), ("number", "(n + 1)"), ("duplicate", "'_duplicate' || n")):

    @_query(
        f"unique_suffix_{_dialect}",
        f"""--cte d as (select distinct page, seq, x, y, name from field_specs), r as (select *, row_number() over (partition by name order by page, seq, x, y) - 1 as n from d)
select page, seq, x, y, name, case when n = 0 then name else name || {_suffix} end as unique_name from r""",
        "field_specs",
    )
    def unique_suffix(specs, dialect=_dialect):
        own = specs.select("page", "seq", "x", "y", "name").distinct()
        return naming.unique_names(own, [F.col(c) for c in ("page", "seq", "x", "y")], dialect, part="page")


@_query(
    "dark_runs",
    """with o as (select user_id, value, row_number() over (partition by user_id order by ts, event_id) as pos from events),
s as (select user_id, pos, pos - row_number() over (partition by user_id order by pos) as island from o where value > 100)
select user_id, min(pos) as begin, count(*) as n from s group by user_id, island having count(*) >= 3""",
)
def dark_runs(spark, sf_dir):
    from pyspark.sql.window import Window

    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    ordered = _read(spark, sf_dir, "events").select("user_id", "value", pos.alias("pos"))
    return cluster.runs(ordered.where("value > 100"), ["user_id"], "pos", 3)


@_query(
    "merged_runs",
    """--cte o as (select page, list(struct_pack(y0 := row, y1 := row, x0 := x0, x1 := x1) order by row, x0, x1) as rs from runs group by page),
f as (select page, list_reduce(list_transform(rs, lambda r: [r]), lambda acc, r: case when r[1].y0 <= acc[len(acc)].y1 + 2
  and (least(acc[len(acc)].x1, r[1].x1) - greatest(acc[len(acc)].x0, r[1].x0)) * 4 >= least(acc[len(acc)].x1 - acc[len(acc)].x0, r[1].x1 - r[1].x0) * 3
  then list_concat(acc[1 : len(acc) - 1], [struct_pack(y0 := acc[len(acc)].y0, y1 := r[1].y0, x0 := least(acc[len(acc)].x0, r[1].x0), x1 := greatest(acc[len(acc)].x1, r[1].x1))])
  else list_concat(acc, r) end) as ls from o)
select page, l.y0, l.y1, l.x0, l.x1 from (select page, unnest(ls) as l from f)""",
    "runs",
)
def merged_runs(runs):
    return cluster.merged_runs(runs)


@_query(
    "greedy_dedupe",
    """--cte o as (select page, list(struct_pack(x := x, y := y, w := w, h := h) order by x, y, w, h) as bs from (select distinct page, x, y, w, h from boxes) group by page),
f as (select page, list_reduce(list_transform(bs, lambda b: [b]), lambda acc, b: case when len(list_filter(acc, lambda k: b[1].x < k.x + k.w and b[1].x + b[1].w > k.x and b[1].y < k.y + k.h and b[1].y + b[1].h > k.y)) > 0 then acc else list_concat(acc, b) end) as ks from o)
select page, k.x, k.y, k.w, k.h from (select page, unnest(ks) as k from f)""",
    "boxes",
)
def greedy_dedupe(boxes):
    own = boxes.select("page", "x", "y", "w", "h").distinct()
    return cluster.greedy_kept(own, G.overlaps, ["x", "y", "w", "h"])


@_query("reading_order", "select *, row_number() over (order by page, y desc, x, w, h, seq, type) as place from boxes", "boxes")
def reading_order(boxes):
    from quillgrid.operators.order import numbered

    return numbered(boxes, [F.col("page"), F.desc("y"), F.col("x"), F.col("w"), F.col("h"), F.col("seq"), F.col("type")], "page", "place")


@_query(
    "best_line",
    """--cte c as (select page, x0, x1, row, greatest(0, least(x1, 300) - greatest(x0, 100)) as overlap, x1 - x0 as width, abs(row - 20) as distance from (select distinct * from runs)),
r as (select *, row_number() over (partition by page order by overlap desc, width desc, distance, row, x0) as k from c where overlap > 0)
select page, row, x0 as begin, overlap, width, distance from r where k = 1""",
    "runs",
)
def best_line(runs):
    c = F.col
    overlap = F.greatest(F.lit(0), F.least(c("x1"), F.lit(300)) - F.greatest(c("x0"), F.lit(100)))
    found = runs.distinct().select("page", "row", c("x0").alias("begin"), overlap.alias("overlap"), (c("x1") - c("x0")).alias("width"), F.abs(c("row") - 20).alias("distance"))
    return cluster.best_line(found.where("overlap > 0"), ["page"])


# --- names and labels ----------------------------------------------------------------------------------

_SHORT_STEPS = r"""--cte r as (select distinct trim(name) as o from raw_names),
b as (select o, regexp_replace(o, '\[\d+\]', '', 'g') as s from r), c as (select o, s, regexp_extract(s, '[^.]*$') as e from b),
t as (select o, 0 as pos, 'exact' as method, o as v from c union all select o, 1, 'strip-indexes', s from c union all select o, 2, 'base-name', e from c union all select o, 3, 'strip-number-suffix', regexp_replace(e, '_\d+$', '') from c),
u as (select o, v, min(pos) as pos, arg_min(method, pos) as method from t where v <> '' group by o, v),
k as (select lower(name) as key, min(name) as name from known_names group by 1),
h as (select o, arg_min(k.name, pos) as name, arg_min(method, pos) as method from u join k on lower(v) = key group by o)
select r.o as original_name, coalesce(h.name, r.o) as canonical_name, h.name is not null as matched, coalesce(h.name, r.o) <> r.o as changed, coalesce(method, 'unmatched') as method from r left join h on h.o = r.o"""


@_query("resolve_cascade", _SHORT_STEPS, "raw_names", "known_names")
def resolve_cascade(names, known):
    return resolve.first_match(names, resolve.merged_names([("code", known)]), resolve.short_cascade, "code")


_LONG_STEPS = r"""--cte r as (select distinct trim(name) as o from raw_names), b as (select o, regexp_replace(o, '\[\d+\]', '', 'g') as s from r),
c as (select o, s, regexp_extract(s, '[^.]*$') as e from b), d as (select *, regexp_replace(e, '_DUPLICATED_\d+$', '', 'i') as once from c),
t as (select o, 0 as pos, 'exact' as method, o as v from d union all select o, 1, 'path-last-segment', case when contains(o, '.') then regexp_extract(o, '[^.]*$') else '' end from d
  union all select o, 2, 'strip-indexes', s from d union all select o, 3, 'path-last-segment-strip-indexes', case when contains(s, '.') then e else '' end from d union all select o, 4, 'base-name', e from d
  union all select o, 5, 'strip-duplicated-suffix', once from d union all select o, 6, 'strip-number-suffix', regexp_replace(once, '_\d+$', '') from d),
u as (select o, v, min(pos) as pos, arg_min(method, pos) as method from t where v <> '' group by o, v),
k as (select lower(name) as key, min(name) as name from known_names group by 1),
h as (select o, arg_min(k.name, pos) as name, arg_min(method, pos) as method from u join k on lower(v) = key group by o),
m as (select r.o as original_name, coalesce(h.name, r.o) as canonical_name, h.name is not null as matched, coalesce(h.name, r.o) <> r.o as changed, coalesce(method || ':examples', 'unmatched') as method from r left join h on h.o = r.o)
"""


@_query("truth_match", _LONG_STEPS + "select * from m", "raw_names", "known_names")
def truth_match(names, known):
    return resolve.first_match(names, resolve.merged_names([("examples", known)]), resolve.long_cascade, "code")


@_query("conversion_report", _LONG_STEPS + "select count(*) as total, count(*) filter (matched) as matched, count(*) filter (changed) as changed, count(*) filter (not matched) as unmatched from m", "raw_names", "known_names")
def conversion_report(names, known):
    from quillgrid.operators.reports import conversion_totals

    return conversion_totals(truth_match(names, known))


@_query("alias_unambiguous", "select alias, min(canonical) as canonical from alias_pairs group by alias having count(distinct canonical) = 1", "alias_pairs")
def alias_unambiguous(pairs):
    return resolve.unambiguous(pairs)


_TOKENS = r"list_distinct(list_transform(regexp_extract_all({0}, '[A-Za-z0-9][A-Za-z0-9]+'), lambda t: lower(t)))"
_SPLIT = "replace(regexp_replace(regexp_replace(name, '^(txt|chk|img)', ''), '([a-z])([A-Z])', '\\1 \\2', 'g'), '_', ' ')"
_SCORES = f"""--cte a as (select label, {_TOKENS.format("label")} as t from (select distinct label from part_labels)), b as (select name, {_TOKENS.format(_SPLIT)} as t from part_names),
s as (select a.label, b.name, len(a.t) as m, len(b.t) as n, count(*) as common from (select label, t, unnest(t) as k from a) a join (select name, t, unnest(t) as k from b) b on a.k = b.k group by a.label, b.name, a.t, b.t),
"""


@_query(
    "token_match",
    _SCORES + """q as (select label, name, common / greatest(m, n) + case when common = m then 0.25 else 0.0 end as score from s), r as (select *, row_number() over (partition by label order by score desc, name) as k from q),
z as (select label, max(name) filter (k = 1) as name, max(score) filter (k = 1) as score, max(score) filter (k = 2) as second from r group by label)
select label, name, score from z where score >= 0.75 and (second is null or second < score - 0.1)""",
    "part_labels", "part_names",
)
def token_match(labels, names):
    return resolve.token_match(labels, names)


@_query(
    "top5_suggestions",
    _SCORES + "r as (select label, name, common / greatest(m, n) as score, row_number() over (partition by label order by common / greatest(m, n) desc, name) as place from s) select label, cast(place as int) as place, name, score from r where place <= 5",
    "part_labels", "part_names",
)
def top5_suggestions(labels, names):
    return resolve.suggestions(labels, names)


@_query(
    "label_lookup",
    with_fixtures(
        r"""--cte n as (select label, trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(label)), '[\s:_-]+', ' ', 'g'), '[^\p{L}\p{N}_ ]+', '', 'g'), ' +', ' ', 'g')) as key from (select distinct upper(label) as label from part_labels)),
l as (select trim(regexp_replace(lower(alias), '[\s:_-]+', ' ', 'g')) as key, canonical from (select concat(p_name, '-', p_type) as alias, p_brand as canonical from part)),
g as (select key, min(canonical) as canonical from l group by key having count(distinct canonical) = 1)
select n.label, g.canonical from n join g on g.key = n.key""",
        "part_labels",
    ),
)
def label_lookup(spark, sf_dir):
    labels = fixture(spark, sf_dir, "part_labels").select(F.upper("label").alias("label"))
    aliases = _read(spark, sf_dir, "part").select(F.concat("p_name", F.lit("-"), "p_type").alias("alias"), F.col("p_brand").alias("canonical"))
    return resolve.label_lookup(labels, aliases)


@_query(
    "classify_label",
    r"""with l as (select p_partkey, case p_partkey % 6 when 0 then 'Sign here: ' when 1 then 'Birth DATE ' when 2 then 'E-mail of ' when 3 then 'Account ' when 4 then '☐ ' else '' end || p_name as label from part)
select p_partkey, label, case when label like '☐%' then 'checkbox' when regexp_matches(label, '(?i)signature|sign here') then 'signature' when regexp_matches(label, '(?i)\bdate\b') then 'date' else 'text' end as type,
  case when label like '☐%' then 12.0::double when regexp_matches(label, '(?i)signature|sign here') then 180.0 when regexp_matches(label, '(?i)\bdate\b') then 80.0 when regexp_matches(label, '(?i)\baddress\b') then 240.0
  when regexp_matches(label, '(?i)\bphone\b|\bfax\b') then 120.0 when regexp_matches(label, '(?i)\be-?mail\b') then 180.0 when regexp_matches(label, '(?i)\bid\b') then 100.0 when regexp_matches(label, '(?i)account') then 140.0 when regexp_matches(label, '(?i)amount') then 100.0 else 150.0 end as width from l""",
)
def classify_label(spark, sf_dir):
    start = "case p_partkey % 6 when 0 then 'Sign here: ' when 1 then 'Birth DATE ' when 2 then 'E-mail of ' when 3 then 'Account ' when 4 then '☐ ' else '' end"
    return patterns.classify(_read(spark, sf_dir, "part").selectExpr("p_partkey", f"concat({start}, p_name) as label"))


@_query("tokens", r"select doc_id, unnest(list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z0-9][A-Za-z0-9]+'), lambda t: lower(t)))) as token from documents")
def tokens(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", F.explode(T.tokens(F.col("text"))).alias("token"))


@_query("attr_extract", """select page_id, unnest(list_distinct(regexp_extract_all(html, 'href="([^"]*)"', 1))) as href from pages""")
def attr_extract(spark, sf_dir):
    found = F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)))
    return _read(spark, sf_dir, "pages").select("page_id", F.explode(found).alias("href"))


@_query("camel_split", rf"with n as (select distinct 'txt' || replace(c_name, '#', 'No') || c_mktsegment as name from customer) select name, {_SPLIT} as words from n")
def camel_split(spark, sf_dir):
    name = F.concat(F.lit("txt"), F.replace(F.col("c_name"), F.lit("#"), F.lit("No")), F.col("c_mktsegment"))
    return _read(spark, sf_dir, "customer").select(name.alias("name")).distinct().withColumn("words", T.split_name(F.col("name")))


@_query(
    "label_normalise",
    r"with l as (select distinct '  ' || p_type || ': ' || p_name || '_(' || p_brand || ')' as label from part) select label, trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(label)), '[\s:_-]+', ' ', 'g'), '[^\p{L}\p{N}_ ]+', '', 'g'), ' +', ' ', 'g')) as key from l",
)
def label_normalise(spark, sf_dir):
    label = F.concat(F.lit("  "), "p_type", F.lit(": "), "p_name", F.lit("_("), "p_brand", F.lit(")"))
    return _read(spark, sf_dir, "part").select(label.alias("label")).distinct().withColumn("key", T.normal_label(F.col("label")))


@_query(
    "generated_names",
    r"""with l as (select distinct p_name || '/' || p_type as label, case p_size % 3 when 0 then 'text' when 1 then 'checkbox' else 'signature' end as type from part),
w as (select label, type, list_transform(regexp_extract_all(regexp_replace(label, '[^\p{L}\p{N}_\s."]+', ' ', 'g'), '[^ ]+'), lambda t: regexp_replace(t, '[^A-Za-z0-9]+', '', 'g')) as ws from l),
b as (select label, type, left(array_to_string(list_transform(ws, lambda t: upper(t[1]) || t[2:]), ''), 32) as base from w)
select label, type, case type when 'text' then 'txt' when 'checkbox' then 'chk' else 'img' end || case when regexp_matches(base, '[A-Za-z]') then base else 'Field' end as name from b""",
)
def generated_names(spark, sf_dir):
    kind = "case p_size % 3 when 0 then 'text' when 1 then 'checkbox' else 'signature' end as type"
    return naming.generated(_read(spark, sf_dir, "part").selectExpr("concat(p_name, '/', p_type) as label", kind).distinct())


@_query(
    "slug_names",
    r"""with l as (select distinct lower(p_type) || ' 2nd o''' || p_name as label from part),
w as (select label, list_transform(regexp_extract_all(lower(label), '\p{L}+|[^\p{L}]+'), lambda t: upper(t[1]) || t[2:]) as ws from l)
select label, 'txt' || left(regexp_replace(array_to_string(ws, ''), '[^A-Za-z0-9]+', '', 'g'), 32) as name from w""",
)
def slug_names(spark, sf_dir):
    labels = _read(spark, sf_dir, "part").selectExpr("concat(lower(p_type), ' 2nd o''', p_name) as label").distinct()
    return labels.withColumn("name", T.slug_name(F.col("label"), "txt"))


@_query(
    "text_predicates",
    r"""with d as (select doc_id, unnest(string_split(text, chr(10))) as line from documents), l as (select distinct line from d),
s as (select line, length(regexp_replace(line, '[^\p{L}\p{Nd}]', '', 'g')) as size, length(regexp_replace(line, '[^\p{L}]', '', 'g')) as letters, length(regexp_replace(line, '[^\p{Nd}]', '', 'g')) as digits,
  coalesce(list_max(list_transform(regexp_extract_all(line, '_+'), lambda t: length(t))), 0) as run from l)
select line, cast(size as int) as size, regexp_full_match(line, '\s*\d+(\.\d+)*\.?\s*') as is_number, run >= 8 and run * 20 >= greatest(length(line), 1) * 9 as fill_line, letters >= 2 and digits * 5 <= letters + digits as worded from s""",
)
def text_predicates(spark, sf_dir):
    line = F.col("line")
    lines = _read(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("line")).distinct()
    letters, digits = F.length(F.regexp_replace(line, r"[^\p{L}]", "")), F.length(F.regexp_replace(line, r"[^\p{Nd}]", ""))
    worded = (letters >= 2) & (digits * 5 <= letters + digits)
    return lines.select("line", T.effective_length(line).alias("size"), T.is_section_number(line).alias("is_number"), T.is_fill_line(line).alias("fill_line"), worded.alias("worded"))


@_query(
    "scalar_forms",
    """select p_partkey, case p_partkey % 4 when 0 then 'text' when 1 then 'checkbox' when 2 then 'image' else 'textarea' end as type,
  p_partkey % 3 = 0 as truth, cast((p_size % 26) * 26 + 26 as int) as col, '<b>"' || p_name || '"&</b>' as html from part""",
)
def scalar_forms(spark, sf_dir):
    kind = F.expr("case p_partkey % 4 when 0 then 'tx' when 1 then 'chk' when 2 then 'img' else 'textarea' end")
    word = F.expr("case p_partkey % 3 when 0 then ' Yes ' when 1 then 'no' else '' end")
    cell = F.expr("concat(char(65 + p_size % 26), 'A', p_size)")
    html = F.concat(F.lit("&lt;b&gt;&quot;"), "p_name", F.lit("&quot;&amp;&lt;/b&gt;"))
    return _read(spark, sf_dir, "part").select("p_partkey", T.normal_type(kind).alias("type"), T.truthy(word).alias("truth"), T.column_index(cell).alias("col"), T.html_unescaped(html).alias("html"))


@_query(
    "moved_boxes",
    """select page, seq, least(2 * x, 2 * (x + w)) + 5 as x, least(-y, -(y + h)) + 700 as y, 2 * w as w, h as h, type from boxes""",
    "boxes",
)
def moved_boxes(boxes):
    lit = lambda *v: F.struct(*[F.lit(float(x)).alias(n) for x, n in zip(v, "abcdef")])
    m = G.concatenated(lit(2, 0, 0, 1, 0, 0), lit(1, 0, 0, -1, 5, 700))
    own = boxes.withColumn("m", m).withColumn("b", G.moved_box(F.col("m"), G.Box()))
    return own.select("page", "seq", "b.x", "b.y", "b.w", "b.h", "type")


@_query("box_overlap", f"""select a.page, count(*) as n, sum(case when (least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * (least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) >= 0.9 * least(a.w * a.h, b.w * b.h) then 1 else 0 end)::bigint as near from boxes a join boxes b on a.seq < b.seq and {_OVERLAP} group by a.page""", "boxes")
def box_overlap(boxes):
    pairs = spatial.overlapping_pairs(boxes, boxes).where("a.seq < b.seq")
    near = F.count_if(G.overlap_ratio(G.Box("a"), G.Box("b")) >= 0.9)
    return pairs.groupBy(F.col("a.page").alias("page")).agg(F.count(F.lit(1)).alias("n"), near.alias("near"))


_WORDS = """with t as (select doc_id as page, string_split(text, ' ') as ws from documents), w as (select page, unnest(ws) as text, unnest(range(0, len(ws))) as pos from t),
words as (select page, pos as seq, text, cast((pos % 10) * 60 as double) as x0, cast(floor(pos / 10) * 14 as double) as y0, cast((pos % 10) * 60 + least(length(text), 9) * 6 as double) as x1, cast(floor(pos / 10) * 14 + 12 as double) as y1 from w)
"""


def _words(spark, sf_dir):
    split = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("page"), F.posexplode(F.split("text", " ", -1)).alias("pos", "text"))
    c, line = F.col("pos") % 10 * 60, F.floor(F.col("pos") / 10) * 14
    return split.select("page", F.col("pos").cast("long").alias("seq"), "text", c.cast("double").alias("x0"), line.cast("double").alias("y0"), (c + F.least(F.length("text"), F.lit(9)) * 6).cast("double").alias("x1"), (line + 12).cast("double").alias("y1"))


@_query("words_layout", _WORDS + "select page, count(*) as n, max(x1) as max_x, max(y1) as max_y from words group by page")
def words_layout(spark, sf_dir):
    return _words(spark, sf_dir).groupBy("page").agg(F.count(F.lit(1)).alias("n"), F.max("x1").alias("max_x"), F.max("y1").alias("max_y"))


@_query("same_line_words", _WORDS + "select a.page, count(*) as n from words a join words b on a.page = b.page and a.y0 = b.y0 and a.seq <> b.seq and greatest(a.x0 - b.x1, b.x0 - a.x1, 0) <= 220 group by a.page")
def same_line_words(spark, sf_dir):
    places = _words(spark, sf_dir).select("page", "seq", "x0", "x1", "y0", "y1")  # only what the pairs are counted by
    return spatial.same_line_words(places).groupBy(F.col("a.page").alias("page")).agg(F.count(F.lit(1)).alias("n"))


@_query(
    "segment_walk",
    _WORDS + """, l as (select page, y0, list(struct_pack(x0 := x0, x1 := x1, text := text) order by x1 desc) as ws from words where seq % 10 < 6 and text <> '' group by page, y0)
select page, y0, array_to_string(list_reverse(list_transform(list_filter(range(1, len(ws) + 1), lambda i: len(list_filter(range(1, i + 1), lambda j: case when j = 1 then 360 - ws[1].x1 > 90 else ws[j - 1].x0 - ws[j].x1 > 60 end)) = 0), lambda i: ws[i].text)), ' ') as label from l""",
)
def segment_walk(spark, sf_dir):
    near = _words(spark, sf_dir).where("seq % 10 < 6 and text <> ''").withColumn("edge", F.lit(360.0))
    return cluster.walked_labels(near, ["page", "y0"])


@_query(
    "layout_mismatches",
    """--cte b as (select page, width + page % 5 as width, height from pages where width + page % 5 < 616)
select coalesce(a.page, b.page) as page, case when b.page is null then 'page-count' else 'page-size' end as reason from pages a left join b on a.page = b.page where b.page is null or abs(a.width - b.width) > 2""",
    "pages",
)
def layout_mismatches(pages):
    other = pages.withColumn("width", F.col("width") + F.col("page") % 5).where("width < 616")
    return rules.layout_mismatches(pages, other)


@_query(
    "underline_boxes",
    """with w as (select p_partkey as seq, cast(floor(p_partkey / 20) as bigint) as page, p_name || ':' || repeat('_', cast(5 + p_size % 12 as int)) as text, cast((p_partkey % 20) * 10 as double) as x0, cast(p_size as double) as y1 from part),
r as (select *, x0 + length(text) * 8 as x1, length(regexp_extract(text, '_+')) as run from w)
select page, seq, round(x0 + (length(text) - run) * 8.0, 1) as x, round(800 - y1, 1) as y, cast(round(run * 8.0, 1) as double) as w, 12.0::double as h from r where run >= 8 and run * 8.0 >= 40""",
)
def underline_boxes(spark, sf_dir):
    from quillgrid.operators import words

    text = "concat(p_name, ':', repeat('_', cast(5 + p_size % 12 as int)))"
    x0 = "cast((p_partkey % 20) * 10 as double)"
    own = _read(spark, sf_dir, "part").selectExpr("p_partkey as seq", "cast(floor(p_partkey / 20) as bigint) as page", "800.0D as page_height", f"{text} as text", f"{x0} as x0", f"{x0} + length({text}) * 8 as x1", "cast(p_size as double) - 10 as y0", "cast(p_size as double) as y1")
    return words.underline_boxes(own)


@_query(
    "merged_names",
    """with n as (select lower(c_mktsegment) as key, c_mktsegment as name, 0 as i, 'code' as source from customer union all select lower(p_type), p_type, 1, 'examples' from part union all select lower(c_mktsegment), lower(c_mktsegment), 1, 'examples' from customer)
select key, arg_min(name, (i, name)) as name, arg_min(source, (i, name)) as source from n group by key""",
)
def merged_names(spark, sf_dir):
    segments = _read(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("name"))
    types = _read(spark, sf_dir, "part").select(F.col("p_type").alias("name"))
    return resolve.merged_names([("code", segments), ("examples", types.unionAll(segments.select(F.lower("name").alias("name"))))])


@_query(
    "carried_pages",
    """with l as (select user_id as doc_id, event_id as line, case when value > 150 then value end as height from events)
select doc_id, line, height, count(height) over w as page, last_value(height ignore nulls) over w as page_height from l window w as (partition by doc_id order by line rows unbounded preceding)""",
)
def carried_pages(spark, sf_dir):
    lines = _read(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("line"), F.when(F.col("value") > 150, F.col("value")).alias("height"))
    return cluster.carried(lines)


@_query(
    "millimetre_boxes",
    "select page, seq, type, x * 0.3528 as x, (792.0 - y - h) * 0.3528 as y, w * 0.3528 as w, h * 0.3528 as h from boxes",
    "boxes",
)
def millimetre_boxes(boxes):
    return boxes.select("page", "seq", "type", G.millimetres(G.Box(), F.lit(792.0)).alias("m")).select("page", "seq", "type", "m.*")
