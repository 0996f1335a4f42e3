"""Exact deduplication by a heavy-hitter split, in DataFrame operations only.

A frequent-items sketch (Spark's approx_top_k, a mergeable Misra-Gries summary: one bounded sketch per
task) names the digests that may be frequent. Their exact counts and winners are then computed with
map-side aggregation; the verified winners, at most `max_heavy` rows, are broadcast, so copies in large
groups are settled where they are read. All other digests, whose groups the sketch's error bound keeps
small, go through one ordinary shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgrid.llm.common import SPACE, cut

#: Counters of each sketch: no digest above about rows / 3,000 escapes it.
COUNTERS = 4096
#: Most digests that are broadcast: 1,024 rows of under 100 bytes.
MAX_HEAVY = 1024
#: Copies from which a verified digest counts as heavy.
LEAST_COPIES = 64


def normalised(text: str) -> F.Column:
    """The text with each run of ASCII white space as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), f"[{SPACE}]+", " ")


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    counters: int = COUNTERS,
    max_heavy: int = MAX_HEAVY,
    least_copies: int = LEAST_COPIES,
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each white-space run became one space. keep_id is the smallest
    id of the group, group_size its rows. Null text counts as empty; very long texts are hashed whole.
    A null id never wins over another id; in a group of null ids only, keep_id is null. Where several
    rows repeat the winning id and text exactly one is kept. Other columns of `docs` are ignored, so
    their names can't clash. An empty table gives an empty result.
    """
    rows = cut(
        docs.select(
            F.col(id_col).alias("id"), F.unhex(F.sha2(normalised(text_col).cast("binary"), 256)).alias("digest")
        )
    )
    sketch = rows.agg(
        F.expr(f"approx_top_k(hex(digest), {max_heavy}, {counters})").alias("top")
    ).select(F.explode("top").alias("t"))
    named = sketch.where(F.col("t.count") >= least_copies).select(F.unhex("t.item").alias("digest"))
    named = F.broadcast(cut(named))  # at most max_heavy rows
    winners = (
        rows.join(named, "digest", "left_semi")
        .groupBy("digest")
        .agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .where(F.col("group_size") >= least_copies)
    )
    winners = F.broadcast(cut(winners))  # at most max_heavy rows
    marked = rows.join(winners, "digest", "left")
    copies = marked.where(F.col("group_size").isNotNull())
    lost = copies.where(~F.col("id").eqNullSafe(F.col("keep_id"))).withColumn("kept", F.lit(False))
    one = Window.partitionBy("digest").orderBy("id")
    won = copies.where(F.col("id").eqNullSafe(F.col("keep_id"))).withColumn(
        "kept", F.row_number().over(one) == 1
    )
    group = Window.partitionBy("digest")
    first = group.orderBy(F.col("id").asc_nulls_last())
    rest = (
        rows.join(winners.select("digest"), "digest", "left_anti")
        .withColumn("keep_id", F.min("id").over(group))
        .withColumn("group_size", F.count(F.lit(1)).over(group))
        .withColumn("kept", F.row_number().over(first) == 1)
    )
    out = lost.unionByName(won).unionByName(rest)
    return out.select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        "kept",
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


SQL = r"""
with d as (
  select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents
)
select doc_id, min(doc_id) over g as keep_id, count(*) over g as group_size,
       doc_id = min(doc_id) over g as kept, text_sha256
from d window g as (partition by text_sha256)
"""
