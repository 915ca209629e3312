"""A stream of epochs over a table of numbered rows, whose offset is an epoch and a position in it.

The source gives (epoch, position, row): which row of the table comes at which position. A stream over it resumes from its
progress log at the offset where it stopped; the rows are joined by their number, so the table itself is read by Spark.
After the last epoch comes one row with a null position, the end marker.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "epoch long, position long, row long"
#: Positions that a task makes at most.
CHUNK = 1_000_000


def mixed(x: np.ndarray, key: int, bits: int) -> np.ndarray:
    """A permutation of the numbers below 2 ** bits (bits even): four rounds that mix one half with a hash of the other."""
    half = np.uint64(bits // 2)
    mask = np.uint64((1 << bits // 2) - 1)
    left, right = x >> half, x & mask
    for i in range(4):
        h = (right + np.uint64(key & 0xFFFFFFFF) + np.uint64(i * 0x9E3779B9)) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        left, right = right, left ^ (h * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(40)) & mask
    return left << half | right


def permuted(positions: np.ndarray, rows: int, seed: int, epoch: int) -> np.ndarray:
    """The rows at positions of an epoch: each row once. Numbers that the permutation takes beyond the rows are taken on until they fall below."""
    bits = max(2, (max(rows, 2) - 1).bit_length())
    bits += bits % 2
    key = (seed * 1_000_003 + epoch * 7919 + 12345) & 0xFFFFFFFF
    with np.errstate(over="ignore"):
        out = mixed(positions.astype(np.uint64), key, bits)
        while (out >= rows).any():
            beyond = out >= rows
            out[beyond] = mixed(out[beyond], key, bits)
    return out.astype(np.int64)


class Span(InputPartition):
    def __init__(self, epoch: int, start: int, end: int, last: bool = False):
        self.epoch, self.start, self.end, self.last = epoch, start, end, last


class EpochReader(DataSourceStreamReader):
    """Offsets are {"epoch", "position"}; {"epoch": epochs, "position": 1} lies behind the end marker."""

    def __init__(self, options: dict):
        self.rows, self.epochs = int(options["rows"]), int(options.get("epochs", 1))
        self.seed = None if options.get("seed") is None else int(options["seed"])
        self.budget = int(options.get("budget", -1))

    def at(self, n: int) -> dict:
        """The offset after n samples; the marker counts as one."""
        whole = self.rows * self.epochs
        return {"epoch": self.epochs, "position": n - whole} if n >= whole else {"epoch": n // self.rows, "position": n % self.rows}

    def count(self, offset: dict) -> int:
        return offset["epoch"] * self.rows + offset["position"]

    def initialOffset(self) -> dict:  # noqa: N802
        return self.at(0)

    def latestOffset(self) -> dict:  # noqa: N802
        """As far as the budget of samples goes, or behind the end marker."""
        whole = self.rows * self.epochs + 1
        return self.at(whole if self.budget < 0 else min(self.budget, whole))

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out = []
        at, until = self.count(start), self.count(end)
        whole = self.rows * self.epochs
        while at < min(until, whole):
            epoch, position = divmod(at, self.rows)
            stop = min(self.rows, position + CHUNK, position + min(until, whole) - at)
            out.append(Span(epoch, position, stop))
            at += stop - position
        return [*out, Span(self.epochs, 0, 0, last=True)] if at < until else out

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        if partition.last:
            columns = [[partition.epoch], [None], [None]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["epoch", "position", "row"])
            return
        positions = np.arange(partition.start, partition.end)
        rows = positions if self.seed is None else permuted(positions, self.rows, self.seed, partition.epoch)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(positions), partition.epoch)), pa.array(positions), pa.array(rows)], ["epoch", "position", "row"])

    def commit(self, end: dict) -> None:
        pass


class EpochSource(DataSource):
    """Format "epochs" with options rows, epochs (1), seed (none: rows in order) and budget (samples that may be read so far; none: all)."""

    @classmethod
    def name(cls) -> str:
        return "epochs"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> EpochReader:  # noqa: N802
        return EpochReader(self.options)


def epochs(spark: SparkSession, rows: int, epochs: int = 1, seed: int | None = None, budget: int | None = None) -> DataFrame:
    """A stream of (epoch, position, row) and the end marker. An empty table has the marker only."""
    spark.dataSource.register(EpochSource)
    reader = spark.readStream.format("epochs").option("rows", max(rows, 0)).option("epochs", epochs if rows else 0)
    reader = reader if seed is None else reader.option("seed", seed)
    return (reader if budget is None else reader.option("budget", budget)).load()


def samples(stream: DataFrame, numbered: DataFrame, row: str = "row_idx") -> DataFrame:
    """The stream with the rows of a numbered table; the end marker has nulls and done is true."""
    return stream.join(numbered, F.col("row") == F.col(row), "left").drop(row).withColumn("done", F.col("position").isNull())
