"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: ASCII white space of the contracts, as a Java regular expression class body.
SPACE = r"\x20\x09-\x0D"
#: Rows that a Python worker takes at a time.
ROWS_TOGETHER = 1_000
#: Rows for which packed() keeps a partition.
ROWS_PACKED = 5_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` under `sf_dir`, read by Spark so that any file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir, which driver and executors share.

    A folder of our own is set only where the session names none and everything runs in one process, as in tests;
    on a cluster without the setting an error says so.
    """
    sc = spark.sparkContext
    own = sc._jsc.sc().getCheckpointDir()
    if own.isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc._jsc.sc().isLocal():
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="quillgrid-"))
        own = sc._jsc.sc().getCheckpointDir()
    return own.get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise `df` in the shared checkpoint folder and cut its lineage, and its estimated size with it.

    A checkpoint takes its plan's estimate along, and a join's is the product of its sides'; over the rounds of a loop
    that number's digits multiply until they fill the driver's memory.
    """
    spark = df.sparkSession
    shared_folder(spark)
    kept = df.checkpoint(eager=True)._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(kept.queryExecution().toRdd(), kept.schema(), False), spark)


def packed(df: DataFrame, rows: int | None = None) -> DataFrame:
    """`df` in no more partitions than a shuffle makes, nor than its rows need if at most `rows`, without moving rows.

    A union has the partitions of both its sides; where a loop adds one to its state, their number would double with
    every round, and each costs a task and a file however empty it is.
    """
    most = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.coalesce(most if rows is None else min(most, buckets_for(rows, ROWS_PACKED, 1)))


def swept(spark: SparkSession) -> None:
    """Lets the shuffle files and checkpoints go that nothing holds any more: Spark removes them when the driver's
    garbage is collected, which may not happen for many rounds."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def written(df: DataFrame) -> DataFrame:
    """`df` as a table in the shared folder: read by columns, and smaller than a checkpoint."""
    folder = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def row_key(docs: DataFrame, text_col: str = "text") -> Column:
    """A digest of a whole row, never null: rows that are alike in every column share it, others don't."""
    short = [F.md5(F.col(c).cast("binary")).alias(c) if c == text_col else F.col(c) for c in docs.columns]
    return F.md5(F.to_json(F.struct(*short)).cast("binary"))


def buckets_for(rows: int, per_bucket: int = 20_000, least: int = 16, most: int = 1 << 20) -> int:
    """How many hash buckets keep each below about `per_bucket` rows, whatever the input's size."""
    return int(min(most, max(least, -(-rows // per_bucket))))


def spread_join(rows: DataFrame, facts: DataFrame, key: str | list[str], held: str = "held", most: int | None = None) -> DataFrame:
    """`rows` joined with `facts` (one row per `key`, `held` saying how many rows have it, never null keys).

    The facts of keys that hold a thousandth of the rows, a thousand keys at most, are broadcast, so a key with
    many of the rows isn't joined by one task. `held` itself is left out. `most`: how many facts there are at most.
    """
    keys = [key] if isinstance(key, str) else key
    facts = cut(packed(facts, most))
    total = facts.agg(F.sum(held)).first()[0] or 0
    hot = F.col(held) >= max(1000, -(-total // 1000))
    few = facts.where(hot)
    if few.isEmpty():
        return rows.join(facts.drop(held), keys)
    known = rows.join(F.broadcast(few.drop(held)), keys)
    others = rows.join(F.broadcast(few.select(*keys)), keys, "left_anti")
    return known.unionByName(others.join(facts.where(~hot).drop(held), keys))


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows, in batches of ROWS_TOGETHER at most, so that a worker's memory doesn't follow Spark's batches."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_TOGETHER):
            yield batch.slice(at, ROWS_TOGETHER)


def map_batches(
    df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str
) -> DataFrame:
    """mapInArrow with a function of one batch, of ROWS_TOGETHER rows at most; empty batches are skipped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            out = fn(batch)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def utf8(column: pa.Array) -> list[bytes | None]:
    """A string column's values as UTF-8 bytes, without decoding them."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def running_total(
    df: DataFrame, parts: list[str], bucket: str, order: list[Column], value: Column, name: str
) -> DataFrame:
    """Adds `name`: the sum of `value` over the earlier rows of the same `parts`, in (bucket, order).

    Two levels keep a hot part out of a single task: rows are summed inside (parts, bucket), and only
    the buckets' totals, one row each, are summed along a part. `bucket` must not decrease along the
    wanted order.
    """
    keys = [*parts, bucket]
    total = f"__total_{name}"
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*keys).agg(F.sum(value).alias(total))
    along = Window.partitionBy(*parts).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    before = f"__before_{name}"
    starts = sums.select(*keys, F.coalesce(F.sum(total).over(along), F.lit(0)).alias(before))
    same = None
    renamed = starts.select(*[F.col(k).alias(f"__k_{k}") for k in keys], before)
    for k in keys:
        test = F.col(k).eqNullSafe(F.col(f"__k_{k}"))
        same = test if same is None else same & test
    joined = df.join(renamed, same).drop(*[f"__k_{k}" for k in keys])
    return joined.withColumn(
        name, F.col(before) + F.coalesce(F.sum(value).over(inside), F.lit(0))
    ).drop(before)
