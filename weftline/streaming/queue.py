"""Bounded queues, version lag and control variables as Structured Streaming operators.

The state of a key is bounded by the queue's capacity; keys spread over the state
store's partitions. Outputs are in append mode: what a queue lets go, and what it drops.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from weftline.operators.trajectories import dual_step
from weftline.streaming.audit import STORE

QUEUE_OUT = "queue string, seq long, payload string, param_version int, event string, produced long, dropped long"
ITEM = "seq long, payload string, param_version int"
#: Messages of a frame that a queue hands on.
FRAME_ROWS = 10_000


class Queues(StatefulProcessor):
    """A FIFO a key in a list of the state store, and its counters: what a batch needs is worked out for all its messages at once."""

    def __init__(self, capacity: int, release: int):
        self.capacity, self.release = capacity, release

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.items = handle.getListState("items", ITEM)
        self.counts = handle.getValueState("counts", "produced long, dropped long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        held = list(self.items.get()) if self.items.exists() else []
        produced, dropped = self.counts.get() if self.counts.exists() else (0, 0)
        # of what comes only numbers and Arrow texts are held; frames are as long as a batch
        seqs, texts, versions = ([np.array([m[0] for m in held], np.int64)], [pa.array([m[1] for m in held], pa.large_string())], [np.array([m[2] for m in held], np.int32)])
        for frame in rows:
            seqs.append(frame["seq"].to_numpy())
            texts.append(pa.array(frame["payload"], pa.large_string(), from_pandas=True))
            versions.append(frame["param_version"].to_numpy())
        seq, text, version = np.concatenate(seqs), pa.concat_arrays(texts), np.concatenate(versions)
        del seqs, texts, versions
        order = np.concatenate([np.arange(len(held)), len(held) + np.argsort(seq[len(held):], kind="stable")])
        new = len(order) - len(held)
        # the n-th message to go is pushed out by the n-th that comes when the queue is full
        gone = max(0, len(order) - self.capacity)
        left = order[gone + self.release :]
        if len(left):
            self.items.put([(int(q), p, int(v)) for q, p, v in zip(seq[left], text.take(pa.array(left)).to_pylist(), version[left], strict=True)])
        else:
            self.items.clear()
        self.counts.update((produced + new, dropped + gone))

        def frame_of(at: np.ndarray, event: str, made, lost) -> pd.DataFrame:
            return pd.DataFrame({"queue": key[0], "seq": seq[at], "payload": text.take(pa.array(at)).to_pandas(), "param_version": version[at], "event": event, "produced": made, "dropped": lost})

        for begin in range(0, gone, FRAME_ROWS):
            nth = np.arange(begin, min(gone, begin + FRAME_ROWS))
            yield frame_of(order[nth], "dropped", produced + max(0, self.capacity - len(held)) + nth, dropped + 1 + nth)
        yield frame_of(order[gone : gone + self.release], "taken", produced + new, dropped + gone)

    def close(self) -> None:
        pass


def bounded_queue(messages: DataFrame, capacity: int, release: int = 0) -> DataFrame:
    """A FIFO a queue key of columns (queue, seq, payload, param_version).

    Messages of a micro-batch enter in the order of seq. When the queue is full its
    OLDEST message is dropped and counted, and reported with event "dropped". After
    each micro-batch up to `release` messages leave from the head with event "taken".
    """
    messages.sparkSession.conf.set(*STORE)
    return messages.groupBy("queue").transformWithStateInPandas(Queues(capacity, release), QUEUE_OUT, "Append", "None")


def queue_statistics(events: DataFrame) -> DataFrame:
    """(queue, consumed, dropped, produced) of what a queue reported so far: produced as of the last message that left."""
    return events.groupBy("queue").agg(
        F.sum((F.col("event") == "taken").cast("long")).alias("consumed"), F.sum((F.col("event") == "dropped").cast("long")).alias("dropped"), F.max("produced").alias("produced"))


def fresh(messages: DataFrame, current_version: int, most_lag: int) -> DataFrame:
    """Messages whose parameter version lags by at most `most_lag`: staleness is by version, not by event time."""
    return messages.where(F.lit(current_version) - F.col("param_version") <= most_lag)


def staleness_budget(required, threshold, sync_steps):
    """How many samples may be produced before the next parameter sync; numbers or columns."""
    budget = required * (threshold + 1) * sync_steps
    return F.floor(budget).cast("bigint") if isinstance(budget, Column) else int(budget)


CONTROL_OUT = "name string, batch long, cost double, lam double, streak int, frozen boolean"
CONTROL_STATE = "lam double, batch long, streak int, frozen boolean"


def dual_variable(costs: DataFrame, lam: float = 1.0, rate: float = 0.01, budget: float = 0.05, most: float = 3.0, stall_after: int = 10, stall_cost: float = 0.5) -> DataFrame:
    """The multiplier of a cost constraint by name, moved once a micro-batch of (name, cost); see dual_step."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, batch, streak, frozen = state.get if state.exists else (lam, 0, 0, False)
        cost = float(pd.concat(list(frames))["cost"].mean())
        now, streak, frozen = dual_step(now, streak, frozen, cost, rate, budget, most, stall_after, stall_cost)
        state.update((now, batch + 1, streak, frozen))
        yield pd.DataFrame([(key[0], batch + 1, cost, now, streak, frozen)], columns=[c.split()[0] for c in CONTROL_OUT.split(", ")])

    return costs.groupBy("name").applyInPandasWithState(step, CONTROL_OUT, CONTROL_STATE, "append", GroupStateTimeout.NoTimeout)


def windowed_usage(events: DataFrame, lateness: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Events and their value by kind and window; rows later than the watermark are left out."""
    return (
        events.withWatermark("ts", lateness).groupBy(F.window("ts", width), "event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
        .select(F.col("window.start").alias("start"), "event_type", "n", "total")
    )


def drained(stream: DataFrame, path: str) -> DataFrame:
    """What a stream gives for all that is there now, written to Parquet with its own progress log and read back; a rerun takes up where it stopped."""
    query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start(f"{path}/rows")
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")
