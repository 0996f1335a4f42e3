"""A global row number without a single-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def numbered(df: DataFrame, order: list[Column], part: str, name: str) -> DataFrame:
    """`df` with `name`, the row's number from 1 in `order`, whose first column must be `part`.

    Rows are numbered inside a part; the parts' counts, one row each, give the offsets.
    """
    inside = Window.partitionBy(part).orderBy(*order[1:])
    counts = df.groupBy(part).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    starts = counts.select(part, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    return df.join(starts, part).withColumn(name, F.col("__before") + F.row_number().over(inside)).drop("__before")
