"""Batch algebra on DataFrames. Row order is an explicit column, as Spark rows have none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.session import checkpointed

ROW = "row_idx"


def with_row_index(df: DataFrame, *order: str | Column, row: str = ROW) -> DataFrame:
    """Consecutive numbers from 0 in the order of the columns, without a single-task sort of all rows.

    Rows are range-partitioned and sorted; each partition's start is the sum of the
    counts before it, a table of one row a partition. The placed rows are written
    once, as two plans might place them differently. The order should be total:
    equal rows are numbered in any order.
    """
    spark = df.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    placed = checkpointed(placed.withColumn("_part", F.spark_partition_id()).withColumn("_seq", F.monotonically_increasing_id()))
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_seq").alias("_first"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return placed.join(F.broadcast(starts), "_part").withColumn(row, F.col("_start") + F.col("_seq") - F.col("_first")).drop("_part", "_seq", "_first", "_start")


def with_group_rank(df: DataFrame, groups: list[str], *order: str | Column, rank: str = "rank") -> DataFrame:
    """Consecutive numbers from 1 within each group. A large group lies in many range partitions, so none is sorted by one task; null is a group."""
    numbered = with_row_index(df, *groups, *order, row="_row")
    starts = numbered.groupBy(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)]).agg(F.min("_row").alias("_begin"))
    same = F.lit(True)
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return numbered.join(starts, same).withColumn(rank, F.col("_row") - F.col("_begin") + 1).select(*df.columns, rank)


def with_running_sum(df: DataFrame, value: str, *order: str | Column, out: str = "upto") -> DataFrame:
    """The sum of a column over this and all earlier rows, in parts: sums within range partitions, moved by the totals of the partitions before."""
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    placed = checkpointed(placed.withColumn("_part", F.spark_partition_id()).withColumn("_seq", F.monotonically_increasing_id()))
    totals = placed.groupBy("_part").agg(F.sum(value).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = F.sum(value).over(Window.partitionBy("_part").orderBy("_seq"))
    return placed.withColumn("_own", own).join(F.broadcast(starts), "_part").withColumn(out, F.col("_start") + F.col("_own")).drop("_part", "_seq", "_own", "_start")


def take_slice(df: DataFrame, start: int = 0, stop: int | None = None, step: int = 1, row: str = ROW) -> DataFrame:
    """The rows start, start + step, ... before stop, as Python slices of non-negative bounds do."""
    keep = (F.col(row) >= start) & (F.pmod(F.col(row) - start, F.lit(step)) == 0)
    return df.where(keep if stop is None else keep & (F.col(row) < stop))


def gather(df: DataFrame, indices: DataFrame, row: str = ROW) -> DataFrame:
    """Rows by a table (pos, idx): in the order of pos, repeated where an index is."""
    return indices.join(df, indices["idx"] == df[row]).drop("idx")


def repeat_rows(df: DataFrame, times: int | Column, interleave: bool = True, row: str = ROW, total: int | None = None) -> DataFrame:
    """Every row `times` times: next to each other, or the whole table again and again (needs `total` rows)."""
    n = F.lit(times) if isinstance(times, int) else times
    out = df.withColumn("_k", F.explode(F.sequence(F.lit(0), n - 1)) if isinstance(times, int) else F.explode(F.expr("filter(sequence(0, greatest(_n - 1, 0)), i -> i < _n)")))
    if interleave:
        return out.withColumn(row, F.col(row) * n + F.col("_k")).drop("_k")
    return out.withColumn(row, F.col("_k") * F.lit(total) + F.col(row)).drop("_k")


def chunk_of(n_rows: int, chunks: int, row: str = ROW) -> Column:
    """The number of the chunk of `chunks` equal ones; rows must divide evenly."""
    if n_rows % chunks:
        raise ValueError(f"{n_rows} rows can't make {chunks} equal chunks")
    return F.floor(F.col(row) / (n_rows // chunks)).cast("int")


def split_of(size: int, row: str = ROW) -> Column:
    """The number of the part of `size` rows; the last one may be short."""
    return F.floor(F.col(row) / size).cast("int")


def pad_to_divisor(df: DataFrame, n_rows: int, divisor: int, row: str = ROW) -> DataFrame:
    """Leading rows appended, cyclically, up to a multiple of the divisor; no rows stay none."""
    missing = -n_rows % divisor if n_rows else 0
    if not missing:
        return df
    rounds = -(-missing // n_rows)
    extra = df.withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(rounds)))).withColumn(row, F.col(row) + F.col("_k") * n_rows).drop("_k")
    return df.unionByName(extra.where(F.col(row) < n_rows + missing))


def unpad(df: DataFrame, n_rows: int, pad: int, row: str = ROW) -> DataFrame:
    return df.where(F.col(row) < n_rows - pad)


def unfold_columns(df: DataFrame, column: str, parts: int, row: str = ROW) -> DataFrame:
    """An array column cut into `parts` equal arrays, a row each."""
    size = F.floor(F.size(column) / parts)
    return df.select(
        *[c for c in df.columns if c != column], F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.slice(column, i * size + 1, size))).alias("part", column)
    )


def zip_union(left: DataFrame, right: DataFrame, row: str = ROW) -> DataFrame:
    """Two batches side by side by row. Columns of both must agree (nulls and NaNs are equal), else the job fails."""
    both = [c for c in left.columns if c in right.columns and c != row]
    other = right.withColumnsRenamed({c: f"_{c}" for c in both})
    joined = left.join(other, row)
    for c in both:
        checked = F.when(F.col(c).eqNullSafe(F.col(f"_{c}")), F.col(c)).otherwise(F.raise_error(F.lit(f"column {c} differs")))
        joined = joined.withColumn(c, checked).drop(f"_{c}")
    return joined


def concat(*parts: DataFrame, row: str = ROW) -> DataFrame:
    """Rows of all parts one after another, numbered on."""
    out, base = None, 0
    for p in parts:
        moved = p.withColumn(row, F.col(row) + base)
        base += p.count()
        out = moved if out is None else out.unionByName(moved)
    return out


def reorder(df: DataFrame, permutation: DataFrame, row: str = ROW) -> DataFrame:
    """Row i of the result is row permutation[i]: a table (pos, idx)."""
    return permutation.join(df, permutation["idx"] == df[row]).drop("idx", row).withColumnRenamed("pos", row)


def inverse(permutation: DataFrame) -> DataFrame:
    return permutation.select(F.col("idx").alias("pos"), F.col("pos").alias("idx"))


def group_index(df: DataFrame, label: str, out: str = "group_idx") -> DataFrame:
    """Labels as 0, 1, ... in their sorted order; the labels, not the rows, are ranked in one task."""
    labels = df.select(label).distinct().withColumn(out, F.dense_rank().over(Window.orderBy(label)) - 1)
    return df.join(labels, df[label].eqNullSafe(labels[label])).drop(labels[label])


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows, with repeats."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
