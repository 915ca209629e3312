"""Helpers shared by the corpus operators: tables, shared storage and checkpoints."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of bytes other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def quoted(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share, as the session's spark.checkpoint.dir names it.

    Where the setting is absent a local session (tests) gets a temporary folder, set
    on the context so that checkpoint() works as well; on a cluster that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if root:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(root)
        return root.rstrip("/")
    if context.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="weftline-"))
    return context.getCheckpointDir().rstrip("/")


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A fresh path below the shared folder; nothing is created yet."""
    return f"{shared_root(spark)}/{kind}-{uuid.uuid4().hex}"


#: Lets Spark remove a query's shuffle files when the query is over.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through reliable storage; readers survive lost executors.

    The shuffle files behind a stored table are of no more use, and go at once
    instead of when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    shared_root(spark)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        once = df.select("*")  # a query of its own, which takes the setting as it is now
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return once.checkpoint()


def write_binary_files(df: DataFrame, path: str) -> None:
    """Write the binary column `value` as files, one a partition, through Spark's own committer.

    The text sink ends every row with its line separator, so each value must end
    in a zero byte: that byte is cut here and the separator puts it back. This
    works on any file system that Spark knows, and failed or speculative tasks
    leave nothing behind.
    """
    body = F.expr("substring(value, 1, length(value) - 1)").cast("string")
    df.select(body.alias("value")).write.option("lineSep", "\u0000").text(path)


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """path and length of the files below a folder, without reading them."""
    return (
        spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
        .select("path", "length").where("length > 0")
    )


def give_back() -> None:
    """Give memory that a Python worker no longer uses back to the system, as workers live on when a task is over."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def partitions_for(spark: SparkSession, rows: int, per_partition: int, most: int = 100_000) -> int:
    """Partitions that hold about so many rows each; at least the session's shuffle setting."""
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(most, -(-rows // per_partition)))


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let Arrow batches hold few rows, as whole texts are wide; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(rows))


def small_or_shuffled(df: DataFrame, row_bytes: int, most_bytes: int = 8 << 20) -> DataFrame:
    """A table to join with: broadcast if its counted rows prove small, else left to a shuffle join.

    `df` should be cheap to count, such as a checkpointed table.
    """
    return F.broadcast(df) if df.count() * row_bytes <= most_bytes else df
