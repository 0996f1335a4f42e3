"""Python functions over rows that hold whole files, a few rows at a time."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows that are turned into Python objects together, and rows that are handed on together.
ROWS_IN, ROWS_OUT = 16, 1_000


def plain(column: pa.Array) -> list:
    """A column's values; numbers without nulls by way of numpy, which is faster."""
    if column.null_count or not (pa.types.is_integer(column.type) or pa.types.is_floating(column.type)):
        return column.to_pylist()
    return column.to_numpy(zero_copy_only=False).tolist()


def made(batches: Iterator[pa.RecordBatch], fn: Callable[..., Iterator[tuple]], fields: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_IN):
            rows = zip(*(c.to_pylist() for c in batch.slice(at, ROWS_IN).columns))
            out = itertools.chain.from_iterable(fn(*row) for row in rows)
            yield from handed_on(out, fields, ROWS_OUT)


def handed_on(out: Iterator[tuple], fields: pa.Schema, most: int) -> Iterator[pa.RecordBatch]:
    while some := list(itertools.islice(out, most)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some), fields)], schema=fields)


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[list]]:
    """The columns of each group, whose first row the last column numbers 1; a group may go on in the next batch."""
    held = None
    for batch in batches:
        *columns, numbers = batch.columns
        begins = np.flatnonzero(numbers.to_numpy() == 1).tolist()
        # files are copied a group at a time
        columns = [c if pa.types.is_binary(c.type) else plain(c) for c in columns]
        for at, stop in zip([0, *begins], [*begins, batch.num_rows]):
            if at == stop:
                continue
            part = [c[at:stop] if isinstance(c, list) else c.slice(at, stop - at).to_pylist() for c in columns]
            if numbers[at].as_py() > 1:
                for own, more in zip(held, part):
                    own.extend(more)
                continue
            if held:
                yield held
            held = part
    if held:
        yield held


def map_groups(df: DataFrame, key: str, order: Sequence[str | Column], fn: Callable[..., Iterator[tuple]], schema: str) -> DataFrame:
    """The rows that `fn` makes of the columns of each group of rows with an equal key, in order.

    Rows are dealt by the key, unless they are, and sorted; a worker holds one group as objects, and no array of a
    group's rows is made.
    """
    fields = to_arrow_schema(StructType.fromDDL(schema))
    most = ROWS_IN if any(pa.types.is_binary(f.type) for f in fields) else ROWS_OUT
    number = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    numbered = df.withColumn("__number", number)
    return numbered.mapInArrow(lambda batches: handed_on(itertools.chain.from_iterable(fn(*g) for g in groups(batches)), fields, most), schema)


def map_rows(df: DataFrame, fn: Callable[..., Iterator[tuple]], schema: str) -> DataFrame:
    """The rows that `fn` makes of each row's columns; a worker holds a few rows as objects, however large a batch is."""
    fields = to_arrow_schema(StructType.fromDDL(schema))
    return df.mapInArrow(lambda batches: made(batches, fn, fields), schema)
