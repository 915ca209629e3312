"""Rows made from rows, appended to the table they come from: a table function over Arrow batches with a filter on length."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows that a table function sees at once.
SLICE = 500


def generated(df: DataFrame, make: Callable[[pa.RecordBatch], pa.RecordBatch], schema: StructType | str | None = None) -> DataFrame:
    """The rows that a table function makes of each Arrow batch of a table; it may give any number of rows, of the table's own schema by default.

    The function sees SLICE rows at a time, wherever Spark has cut the table, so what it makes of a row must not depend on others; what it
    makes of one slice is handed on before the next, so a worker's memory doesn't grow with the table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, SLICE):
                yield make(batch.slice(begin, SLICE))

    return df.mapInArrow(run, schema or df.schema)


def with_generated(df: DataFrame, new: DataFrame, length: Column | None = None, most: int | None = None) -> DataFrame:
    """The table and behind it the new rows whose length is at most `most`; a null length is left out."""
    kept = new if length is None else new.where(length <= most)
    return df.unionByName(kept)


def first_again(df: DataFrame, *order: str) -> DataFrame:
    """The table with its first row appended: the generator that does nothing else. An empty table stays empty."""
    return df.unionByName(df.orderBy(*order).limit(1))


def upsampled(df: DataFrame, times: int, number: str = "copy") -> DataFrame:
    """Every row `times` times, with the number of the copy; no shuffle."""
    return df.select("*", F.explode(F.sequence(F.lit(1), F.lit(times))).alias(number)) if times > 0 else df.limit(0).withColumn(number, F.lit(0))
