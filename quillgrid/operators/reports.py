"""Reports on conversions, mappings and layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid.operators import resolve


def conversion_totals(matches: DataFrame) -> DataFrame:
    """One row with total, matched, changed and unmatched names."""
    return matches.agg(F.count(F.lit(1)).alias("total"), F.count_if("matched").alias("matched"), F.count_if("changed").alias("changed"), F.count_if(~F.col("matched")).alias("unmatched"))


def match_rate(specs: DataFrame, flag: str = "matched") -> DataFrame:
    """One row with the message on how many fields have known names."""
    n, m = F.count(F.lit(1)), F.count_if(flag)
    every = F.format_string("Field names: all %d matched.", m)
    some = F.format_string("Field names: %d of %d matched; the others keep generated names and need mapping.", m, n)
    return specs.agg(F.when(n == m, every).otherwise(some).alias("message"))


def mapping_rows(specs: DataFrame) -> DataFrame:
    """K2: the mapping report's columns; specs: page, name, type, x, y, w, h, label, matched, method."""
    flag = F.when(F.col("matched"), "yes").otherwise("no")
    return specs.select("page", "name", "type", "x", "y", "w", "h", F.col("label").alias("detected_label"), flag.alias("known_name_matched"), F.col("method").alias("match_method"))


def _two(value: Column) -> Column:
    return F.coalesce(F.format_string("%.2f", value.cast("double")), F.lit(""))


def layout_rows(items: DataFrame, known: DataFrame) -> DataFrame:
    """K4, O2: layout items (page, item_type, text, x, y, w, h) as text with their best five names, in report order."""
    best = resolve.suggestions(items.select(F.col("text").alias("label")), known)
    joined = best.groupBy("label").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda s: s["name"]), ";").alias("names"))  # five at most
    out = items.join(joined, items["text"] == joined["label"], "left").orderBy("page", "item_type", F.desc("y"), "x")
    return out.select(F.col("page").cast("string").alias("page"), "item_type", F.col("text").alias("text_or_label"), *[F.when(F.col(c).isNull(), "").otherwise(_two(F.col(c))).alias(c) for c in "xywh"], F.coalesce("names", F.lit("")).alias("suggested_names"))
