"""Form tables projected from the star-schema tables, as SQL that Spark and DuckDB both run.

All rows are used. A page is 16 orders, so pages keep their size when the tables grow. Coordinates are whole
numbers, so rounding can't differ between engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE = "cast(floor(l_orderkey / 16) as bigint)"
BOX_COLUMNS = f"""{PAGE} as page, l_orderkey * 10 + l_linenumber as seq,
  cast((l_partkey % 56) * 10 as double) as x, cast((l_suppkey % 75) * 10 as double) as y,
  cast(floor(l_quantity) * 10 as double) as w, cast(6 + l_linenumber * 3 as double) as h,
  case l_returnflag when 'A' then 'text' when 'N' then 'checkbox' else 'image' end as type"""
PREFIX = "case l_returnflag when 'A' then 'txt' when 'N' then 'chk' else 'img' end"

FIXTURES = {
    "boxes": f"select distinct {BOX_COLUMNS} from {{lineitem}}",
    "field_specs": f"""select {BOX_COLUMNS}, case when l_partkey % 50 < 12 and l_returnflag = 'A'
      then concat('txtBeneficiary', cast(1 + l_linenumber % 3 as {{text}}), case l_partkey % 6 when 0 then 'Name' when 1 then 'ID' when 2 then 'DOB' when 3 then 'CitizenshipCountry' when 4 then 'TaxResidencyCountry' else 'BenefitPercent' end)
      when l_partkey % 50 = 13 then 'imgPersonSignature'
      else concat({PREFIX}, 'F', cast(l_partkey % 50 as {{text}})) end as name from (select * from {{lineitem}} union all select * from {{lineitem}} where l_partkey % 40 = 7)""",
    "anchors": """select cast(floor(o_orderkey / 16) as bigint) as page, o_orderkey as seq,
      cast((o_custkey % 60) * 10 as double) as x, cast((cast(floor(o_totalprice) as bigint) % 79) * 10 as double) as y,
      case when o_custkey % 7 = 0 then '12.3' when o_custkey % 11 = 0 then '--' else concat(o_orderpriority, ' ', o_orderstatus) end as text from {orders}""",
    "pages": "select distinct cast(floor(o_orderkey / 16) as bigint) as page, 612.0 as width, 792.0 as height from {orders} where o_orderkey >= 16",
    "raw_names": """select case o_orderkey % 5 when 0 then concat('root.BUILDING[', cast(o_custkey % 9 as {text}), ']') when 1 then concat('root.furniture_', cast(o_custkey % 9 as {text}))
      when 2 then 'Machinery' when 3 then concat('page.HOUSEHOLD_duplicated_', cast(o_custkey % 3 as {text})) else concat('root.zzz', cast(o_custkey as {text})) end as name from {orders}""",
    "known_names": "select distinct c_mktsegment as name from {customer}",
    "part_labels": "select p_partkey, concat(p_name, ' ', p_type) as label from {part}",
    "part_names": "select distinct p_name as name from {part}",
    "alias_pairs": "select lower(concat(p_name, ' ', cast(p_size as {text}))) as alias, p_brand as canonical from {part}",
    "contexts": """select o_orderkey as cid, cast(floor(o_orderkey / 16) as bigint) as page, cast((o_custkey % 60) * 10 as double) as x0, cast((o_custkey % 60) * 10 + 50 as double) as x1,
      cast((cast(floor(o_totalprice) as bigint) % 79) * 10 as double) as y, case o_custkey % 3 when 0 then 'rtl' when 1 then 'ltr' else 'any' end as direction from {orders}""",
    "segments": f"""select distinct {PAGE} as page, cast((l_partkey % 6) * 12 as double) as x0, cast((l_suppkey % 6) * 12 as double) as y0,
      cast((l_partkey % 6) * 12 + case when l_linenumber % 2 = 0 then 12 else 0 end as double) as x1, cast((l_suppkey % 6) * 12 + case when l_linenumber % 2 = 0 then 0 else 12 end as double) as y1 from {{lineitem}}""",
    "runs": f"""select {PAGE} as page, cast(l_suppkey % 40 as bigint) as row, cast((l_partkey % 20) * 10 as bigint) as x0, cast((l_partkey % 20) * 10 + floor(l_quantity) * 4 as bigint) as x1 from {{lineitem}}""",
    "ink": f"""select {PAGE} as page, cast(l_suppkey % 792 as bigint) as row, cast(l_partkey % 500 as bigint) as begin, cast(l_partkey % 500 + floor(l_quantity) * 2 as bigint) as end from {{lineitem}}""",
}


def sql(name: str) -> str:
    """A fixture as DuckDB SQL."""
    return FIXTURES[name].format(**{t: t for t in ("lineitem", "orders", "customer", "part")}, text="varchar").replace(" as end from", ' as "end" from')


def fixture(spark: SparkSession, sf_dir: str, name: str, by_page: bool = False) -> DataFrame:
    """A fixture as a Spark table; `by_page` deals the line items by their page, so rows alike and pages meet by one shuffle."""
    query = FIXTURES[name].replace("{text}", "string").replace(" as end from", " as `end` from")
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "orders", "customer", "part") if f"{{{t}}}" in query}
    if by_page:
        tables["lineitem"] = tables["lineitem"].repartition(F.expr(PAGE))
    return spark.sql(query, **tables)


def with_fixtures(query: str, *names: str) -> str:
    """DuckDB SQL with the fixtures as common table expressions."""
    return "with " + ", ".join(f"{n} as ({sql(n)})" for n in names) + (", " if query.lstrip().startswith("--cte") else " ") + query.replace("--cte", "", 1)
