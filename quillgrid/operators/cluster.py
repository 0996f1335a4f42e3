"""Order-dependent operators: gaps and islands, runs, greedy folds, walks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgrid.functions import geometry as G

SNAP = 3.0


def snapped(values: DataFrame, page: str = "page", value: str = "x", most: float = SNAP) -> DataFrame:
    """(page, value, snapped): distinct values, a cluster ending where the next is over `most` away.

    A cluster chains on its last value, so it may span more; the snapped value is the cluster's mean,
    rounded to two places.
    """
    own = values.select(page, value).distinct()
    order = Window.partitionBy(page).orderBy(value)
    new = F.coalesce((F.col(value) - F.lag(value).over(order) > most).cast("int"), F.lit(0))
    cluster = F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    marked = own.withColumn("new", new).withColumn("cluster", cluster)
    return marked.select(page, value, F.round(F.avg(value).over(Window.partitionBy(page, "cluster")), 2).alias("snapped"))


def runs(bits: DataFrame, row: list[str], pos: str, least: int) -> DataFrame:
    """(row, begin, n) of runs of at least `least` neighbouring positions, one row of `bits` per set one."""
    order = Window.partitionBy(*row).orderBy(pos)
    island = bits.withColumn("island", F.col(pos) - F.row_number().over(order))
    found = island.groupBy(*row, "island").agg(F.min(pos).alias("begin"), F.count(F.lit(1)).alias("n"))
    return found.where(F.col("n") >= least).drop("island")


def merged_runs(found: DataFrame, page: str = "page") -> DataFrame:
    """Lines (page, y0, y1, x0, x1) of runs (page, row, x0, x1).

    In order of row and start a run joins the line before it, and only that, if it is at most two rows on and
    shares three quarters of the narrower one.
    """
    items = F.array_sort(F.collect_list(F.struct("row", "x0", "x1")))
    line = "struct<y0:bigint,y1:bigint,x0:bigint,x1:bigint>"
    start = F.array().cast(f"array<{line}>")

    def add(lines: Column, r: Column) -> Column:
        last = F.element_at(lines, F.when(F.size(lines) > 0, -1).otherwise(F.lit(None)))
        shared = F.least(last.x1, r.x1) - F.greatest(last.x0, r.x0)
        narrow = F.least(last.x1 - last.x0, r.x1 - r.x0)
        joins = (F.size(lines) > 0) & (r.row <= last.y1 + 2) & (shared * 4 >= narrow * 3)
        one = F.struct(last.y0.alias("y0"), r.row.alias("y1"), F.least(last.x0, r.x0).alias("x0"), F.greatest(last.x1, r.x1).alias("x1"))
        new = F.struct(r.row.alias("y0"), r.row.alias("y1"), r.x0.alias("x0"), r.x1.alias("x1"))
        kept = F.when(joins, F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0)))).otherwise(lines)
        return F.concat(kept, F.array(F.when(joins, one).otherwise(new).cast(line)))

    folded = found.groupBy(page).agg(F.aggregate(items, start, add).alias("lines"))
    return folded.select(page, F.inline("lines"))


def greedy_kept(boxes: DataFrame, duplicates, order: list[str], page: str = "page") -> DataFrame:
    """Boxes that are no duplicate of a kept one before them, in `order` within a page.

    `duplicates(a, b)` gives the test on two boxes; it is folded over the page's boxes in order.
    """
    item = F.struct(*order, *[c for c in ("x", "y", "w", "h") if c not in order])
    items = F.array_sort(F.collect_list(item))
    kind = boxes.select(item.alias("i")).schema["i"].dataType.simpleString()
    start = F.array().cast(f"array<{kind}>")
    keep = lambda kept, b: F.when(F.exists(kept, lambda k: duplicates(_Item(b), _Item(k))), kept).otherwise(F.array_append(kept, b))
    return boxes.groupBy(page).agg(F.aggregate(items, start, keep).alias("kept")).select(page, F.inline("kept"))


class _Item(G.Box):
    """A box held in a struct."""

    def __init__(self, value: Column):
        self.x, self.y, self.w, self.h = value.x, value.y, value.w, value.h
        self.right, self.top = self.x + self.w, self.y + self.h


def walked_labels(pairs: DataFrame, keys: list[str], reach: float = 2) -> DataFrame:
    """(keys, label): words left of a box, walked outward until a gap is too wide.

    `pairs` holds a box's keys, its left edge `edge`, and a same-line word's x0, x1 and text. Words that reach
    over the boundary by more than `reach` points are skipped; the first gap may be 90 points, later ones 60.
    """
    items = F.array_sort(F.collect_list(F.struct((-F.col("x1")).alias("far"), "x0", "text")))
    state = "struct<at:double,n:int,stop:boolean,words:array<struct<x0:double,text:string>>>"
    start = F.struct(F.col("edge").cast("double").alias("at"), F.lit(0).alias("n"), F.lit(False).alias("stop"), F.array().cast("array<struct<x0:double,text:string>>").alias("words")).cast(state)

    def step(s: Column, w: Column) -> Column:
        wide = s.at + w.far
        skip = s.stop | (wide < -reach)
        end = wide > F.when(s.n == 0, 90.0).otherwise(60.0)
        took = F.struct(w.x0.cast("double").alias("at"), (s.n + 1).alias("n"), F.lit(False).alias("stop"), F.array_append(s.words, F.struct(w.x0.cast("double").alias("x0"), w.text.alias("text"))).alias("words")).cast(state)
        halted = F.struct(s.at.alias("at"), s.n.alias("n"), F.lit(True).alias("stop"), s.words.alias("words")).cast(state)
        return F.when(skip, s).when(end, halted).otherwise(took)

    held = pairs.groupBy(*keys, "edge").agg(items.alias("items"))
    done = held.withColumn("s", F.aggregate("items", start, step))
    return done.select(*keys, F.array_join(F.transform(F.array_sort("s.words"), lambda w: w.text), " ").alias("label"))


def carried(lines: DataFrame, order: str = "line", document: str = "doc_id") -> DataFrame:
    """`lines` (document, line, height, null but on page lines) with the page number and height they are under."""
    upto = Window.partitionBy(document).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    page = F.count("height").over(upto)
    return lines.withColumn("page", page).withColumn("page_height", F.last("height", True).over(upto))


def best_line(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the run with the most overlap, then width, then nearness, then row and start."""
    order = Window.partitionBy(*keys).orderBy(F.desc("overlap"), F.desc("width"), "distance", "row", "begin")
    return candidates.withColumn("rank", F.row_number().over(order)).where("rank = 1").drop("rank")
