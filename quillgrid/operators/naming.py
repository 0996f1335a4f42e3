"""Unique names in several dialects, and names made from labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgrid.functions import text as T

#: How the n-th repetition (from 0) of a name is told apart.
DIALECTS = {
    "underscore": lambda name, n: F.concat(name, F.lit("_"), n.cast("string")),
    "number": lambda name, n: F.concat(name, (n + 1).cast("string")),
    "duplicate": lambda name, n: F.concat(name, F.lit("_duplicate"), n.cast("string")),
}


def unique_names(specs: DataFrame, order: list[Column], dialect: str = "underscore", document: list[str] | None = None, part: str | None = None) -> DataFrame:
    """`specs` with `unique_name`: repetitions of a name within a document, in order, are numbered.

    With `part`, the column that `order` starts with, rows are numbered inside a part and the parts' counts give the
    offsets, so a name that many rows have is numbered by many tasks.
    """
    keys = [*(document or []), "name"]
    if part is None:
        n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
        numbered = specs.withColumn("n", n)
    else:
        before = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
        counts = specs.groupBy(*keys, part).agg(F.count(F.lit(1)).alias("held")).withColumn("n0", F.coalesce(F.sum("held").over(before), F.lit(0)))
        starts = counts.select(*[F.col(k).alias(f"__{k}") for k in (*keys, part)], "n0")
        same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in (*keys, part)]
        inside = F.row_number().over(Window.partitionBy(*keys, part).orderBy(*order[1:]))
        numbered = specs.join(starts, same).withColumn("n", F.col("n0") + inside - 1).select(*specs.columns, "n")
    return numbered.withColumn("unique_name", F.when(F.col("n") == 0, F.col("name")).otherwise(DIALECTS[dialect](F.col("name"), F.col("n")))).drop("n")


def issued_names(fields: DataFrame, known: DataFrame, order: list[str], document: str = "doc_id") -> DataFrame:
    """`fields` (document, name, order) with `issued`: a canonical name's repeats take a known numbered variant.

    The n-th use, n from 2, tries name_(n-1), then the name with n; the first that is known and not yet issued
    in the document is taken, else the name is used again. What was issued before decides, so a document's
    names are folded in order. Only the known variants of a document's own repeats come to it, by a join.
    """
    uses = fields.groupBy(document, "name").agg(F.count(F.lit(1)).alias("uses")).where("uses > 1")
    each = uses.select(document, "name", F.explode(F.sequence(F.lit(1).cast("long"), F.col("uses") - 1)).alias("i"))
    variants = each.select(document, F.explode(F.array(F.concat("name", F.lit("_"), F.col("i").cast("string")), F.concat("name", (F.col("i") + 1).cast("string")))).alias("name"))
    own = variants.join(known.select("name").distinct(), "name").groupBy(document).agg(F.collect_set("name").alias("variants"))  # one document's
    own = own.select(F.col(document).alias("__document"), "variants")
    item = F.struct(*order, "name")
    held = fields.groupBy(document).agg(F.array_sort(F.collect_list(item)).alias("items"))
    held = held.join(own, F.col(document).eqNullSafe(F.col("__document")), "left").withColumn("known", F.coalesce("variants", F.array().cast("array<string>")))
    state = "struct<issued: array<string>, counts: map<string,int>>"
    start = F.struct(F.array().cast("array<string>").alias("issued"), F.create_map().cast("map<string,int>").alias("counts")).cast(state)

    def step(s: Column, f: Column) -> Column:
        name = f["name"]
        n = F.coalesce(F.element_at(s["counts"], name), F.lit(0)) + 1
        counted = F.map_concat(F.map_filter(s["counts"], lambda k, v: k != name), F.map_from_arrays(F.array(name), F.array(n)))
        tried = F.array(F.concat(name, F.lit("_"), (n - 1).cast("string")), F.concat(name, n.cast("string")))
        free = F.filter(tried, lambda t: F.array_contains(F.col("known"), t) & ~F.map_contains_key(s["counts"], t))
        taken = F.when(n == 1, name).when(F.size(free) > 0, F.get(free, F.lit(0))).otherwise(name)
        own = F.when((n > 1) & (F.size(free) > 0), F.map_concat(counted, F.map_from_arrays(F.array(taken), F.array(F.lit(1))))).otherwise(counted)
        return F.struct(F.array_append(s["issued"], taken).alias("issued"), own.alias("counts")).cast(state)

    folded = held.withColumn("issued", F.aggregate("items", start, step)["issued"])
    pairs = folded.select(document, F.explode(F.arrays_zip("items", "issued")).alias("z"))
    return pairs.select(document, "z.items.*", F.col("z.issued").alias("issued"))


def generated(fields: DataFrame) -> DataFrame:
    """`fields` (label, type) with `name`: the type's prefix and the label's base."""
    prefix = F.coalesce(T.mapped(F.col("type"), T.TYPE_PREFIXES, F.lit("txt")), F.lit("txt"))
    return fields.withColumn("name", F.concat(prefix, T.base_from_label(F.col("label"))))


def reading_order(page: str = "page") -> list[Column]:
    """O1: by page, from top to bottom, from left to right."""
    return [F.col(page), F.desc("y"), F.col("x")]
