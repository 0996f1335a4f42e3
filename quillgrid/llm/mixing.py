"""Mixing sources to target weights by capped water-filling, in DataFrame operations only.

Every source's share of the total follows its weight; a source whose share exceeds `epochs` times its size
is clamped there, and the excess goes to the others by weight, until none is above. A source is then taken
in whole repetitions, and for the fraction that remains in a seeded order of its documents, passing over each that
is longer than what is still missing; one more document, the one nearest to the rest, closes the gap.

The order is that of a seeded MD5 of id and text. Running totals along it are taken in two levels, inside hash
buckets and over the buckets' sums, so a source with a large share of all rows is spread over many tasks. A round
takes documents up to the first that is too long; the next one goes on behind it with those alone that still fit,
so what is missing shrinks by about half each time.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgrid.llm.common import SPACE, cut

WEIGHTS, TOTAL, EPOCHS, SEED = (5, 2, 1), 1.5, 2.0, 42


def targets(sources: DataFrame, total: float, weights: tuple[int, ...] = WEIGHTS, epochs: float = EPOCHS) -> DataFrame:
    """`sources` (source, source_size and others) with target: water-filling under caps.

    Weights repeat along the sources in order of code points, null last. Each round is one aggregation;
    only its sums reach the driver. The rounds are at most the sources, usually two or three.
    """
    place = Window.orderBy(F.col("source").asc_nulls_last())  # one row per source
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(place) - 1, F.lit(len(weights))) + 1)
    state = cut(sources.withColumn("weight", weight).withColumn("cap", epochs * F.col("source_size")))
    level = 0.0
    full = F.lit(False)
    before = -1
    while True:
        r = state.agg(
            F.sum(F.when(full, F.col("cap")).otherwise(0.0)).alias("cap"),
            F.sum(F.when(full, 0).otherwise(F.col("weight"))).alias("weight"),
            F.count_if(full).alias("n"),
        ).first()
        if r.n == before or not r.weight:
            break
        before = r.n
        level = (total - r.cap) / r.weight
        full = F.lit(level) * F.col("weight") > F.col("cap")
    target = F.when(full, F.col("cap")).otherwise(F.lit(level) * F.col("weight"))
    return state.select(*sources.columns, F.least(target, F.col("cap")).alias("target"))


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    total: float = TOTAL,
    epochs: float = EPOCHS,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per input row: id, size, source_size, target, taken.

    size counts the text's runs of anything but ASCII white space (null: 0); source_size sums it over the
    row's source, a null source being one of its own. target is the source's share of `total` times all
    sizes; taken is 0, size or a multiple of it, at most ceil(epochs) times. Rows that repeat an id count each;
    which of several rows of the same id, text and source is taken is left open. With nothing but empty texts all
    targets are 0; an empty table gives an empty result. Other columns are ignored.
    """
    name = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    digest = F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    rows = cut(
        docs.select(
            F.col(id_col).alias("id"),
            F.col(source_col).alias("source"),
            F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n")).alias("s"),
            F.coalesce(F.regexp_count(text_col, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long").alias("size"),
            F.md5(F.concat(F.lit(f"{seed}:"), name, F.lit(":"), digest).cast("binary")).alias("order"),
        )
    )
    digits = max(1, math.ceil(math.log(max(rows.count(), 1) / 20_000 + 1, 16)))
    rows = rows.withColumn("b", F.substring("order", 1, digits))
    queue = cut(rows.withColumn("r", F.row_number().over(Window.partitionBy("s", "b").orderBy("order", "id", "size"))).drop("order"))
    cells = cut(queue.groupBy("s", "b").agg(F.first("source").alias("source"), F.sum("size").alias("held")))
    sources = cells.groupBy("source").agg(F.first("s").alias("s"), F.sum("held").alias("source_size"))
    everything = sources.agg(F.sum("source_size")).first()[0] or 0
    goals = targets(sources, total * everything, weights, epochs)
    size = F.col("source_size")
    goals = goals.withColumn("whole", F.when(size > 0, F.floor(F.col("target") / size)).otherwise(0).cast("long"))
    goals = cut(goals.withColumn("budget", F.col("target") - F.col("whole") * size).drop("source"))
    cells = cells.select("s", "b")
    steps = filled(queue.where("size > 0").select("s", "b", "r", "size"), cells, goals.select("s", F.col("budget").alias("left")))
    ways = steps.groupBy("s").agg(F.collect_list(F.struct("begin", "end", "left")).alias("steps"), F.min("rest").alias("gap"))  # one row a round
    facts = cells.join(goals, "s").join(ways, "s", "left")
    place = F.struct("b", "r")
    within = lambda t: (t.begin < place) & (t.end.isNull() | (place < t.end)) & (F.col("size") <= t.left)
    more = F.coalesce(F.exists("steps", within), F.lit(False)) & (F.col("size") > 0)
    queued = cut(queue.join(facts, ["s", "b"]).withColumn("more", more).drop("steps"))
    off = F.abs(F.col("size") - F.col("gap"))
    spare = queued.where((F.col("size") > 0) & ~F.col("more") & (off < F.col("gap")))
    picks = spare.groupBy("s").agg(F.min(F.struct(off.alias("off"), "b", "r")).alias("p")).select("s", "p.b", "p.r", F.lit(True).alias("last"))
    extra = (F.col("more") | F.coalesce("last", F.lit(False))).cast("long")
    return queued.join(picks, ["s", "b", "r"], "left").select(
        F.col("id").alias(id_col),
        "size",
        "source_size",
        "target",
        ((F.col("whole") + extra) * F.col("size")).alias("taken"),
    )


def filled(queue: DataFrame, cells: DataFrame, budgets: DataFrame) -> DataFrame:
    """How budgets (s, left) are filled along queue (s, b, r, size): (s, begin, end, left, rest), a row for each round.

    Of the rows between the places `begin` and `end` (b, r), those of at most `left` are taken; a null `end` is that
    of the queue. `rest`, the least of a source, is what remains of its budget. cells are the queue's (s, b).
    """
    start = F.struct(F.lit("").alias("b"), F.lit(0).alias("r"))
    state = cut(budgets.withColumn("begin", start))
    kind = "struct<b: string, r: int>"
    steps = state.select("s", "begin", F.lit(None).cast(kind).alias("end"), "left", F.col("left").alias("rest")).where("false")
    while True:
        known = cells.join(state, "s")
        queue = cut(queue.join(known, ["s", "b"]).where((F.col("size") <= F.col("left")) & (F.struct("b", "r") > F.col("begin"))).select("s", "b", "r", "size"))
        sums = queue.groupBy("s", "b").agg(F.sum("size").alias("held"))
        along = Window.partitionBy("s").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("base", F.coalesce(F.sum("held").over(along), F.lit(0))).drop("held")
        inside = Window.partitionBy("s", "b").orderBy("r").rowsBetween(Window.unboundedPreceding, 0)
        ends = queue.withColumn("own", F.sum("size").over(inside)).join(sums.join(state, "s"), ["s", "b"])
        fits = F.col("base") + F.col("own") <= F.col("left")
        place = F.when(~fits, F.struct("b", "r"))
        got = ends.groupBy("s").agg(F.sum(F.when(fits, F.col("size")).otherwise(0)).alias("got"), F.min(place).alias("end"))
        state = cut(state.join(got, "s").withColumn("rest", F.col("left") - F.col("got")))
        if state.isEmpty():
            return steps
        steps = cut(steps.unionByName(state.select("s", "begin", "end", "left", "rest")))
        state = state.where("end is not null").select("s", F.col("rest").alias("left"), F.col("end").alias("begin"))


SQL = r"""
with recursive
d as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size,
         md5('42:' || coalesce(cast(doc_id as varchar), 'null') || ':' || md5(coalesce(text, ''))) as o
  from documents
),
s as (select source, cast(sum(size) as bigint) as source_size from d group by source),
w as (select *, 2.0 * source_size as cap, [5, 2, 1][1 + (row_number() over (order by encode(source) nulls last) - 1) % 3] as weight from s),
p as (
  select *, coalesce(sum(cap) over (order by cap / weight, source rows between unbounded preceding and 1 preceding), 0) as c,
         sum(weight) over (order by cap / weight, source rows between current row and unbounded following) as m
  from w
),
level as (select (1.5 * (select sum(source_size) from s) - c) / m as v from p where (1.5 * (select sum(source_size) from s) - c) / m * weight <= cap order by cap / weight, source limit 1),
t as (select source, source_size, least(cap, coalesce((select cast(v as double) from level), 1e300) * weight) as target from w),
g as (select *, cast(case when source_size > 0 then floor(target / source_size) else 0 end as bigint) as whole from t),
b as (select *, target - whole * source_size as budget from g),
q as (
  select d.doc_id, d.source, d.size, b.source_size, b.target, b.whole, b.budget,
         row_number() over (partition by d.source order by o, doc_id, size) as pos
  from d join b on d.source is not distinct from b.source
),
f as (
  select source, 0 as pos, any_value(budget) as rest, false as more from q group by source
  union all
  select q.source, q.pos, case when q.size <= f.rest then f.rest - q.size else f.rest end, q.size <= f.rest and q.size > 0
  from f join q on q.source is not distinct from f.source and q.pos = f.pos + 1
),
gap as (select source, min(rest) as v from f group by source),
k as (
  select q.source, arg_min(q.pos, (abs(size - v), q.pos)) as pos
  from q join gap on gap.source is not distinct from q.source
  join f on f.source is not distinct from q.source and f.pos = q.pos
  where size > 0 and not more and abs(size - v) < v group by q.source
)
select q.doc_id, size, source_size, cast(target as double) as target,
       (whole + cast(f.more or k.pos is not null as bigint)) * size as taken
from q join f on f.source is not distinct from q.source and f.pos = q.pos
left join k on k.source is not distinct from q.source and k.pos = q.pos
"""
