"""Balanced partitions of sequences by workload, one bounded batch a task."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def workload(length: Column) -> Column:
    """The cost of a sequence: linear and quadratic parts of a transformer layer (fixed factor)."""
    return 24576 * length + length * length


def _even(costs: list[float], bins: int) -> None:
    if len(costs) % bins:
        raise ValueError(f"{len(costs)} items don't fill {bins} bins of equal size")


def greedy_bins(costs: list[float], bins: int, equal_size: bool = False) -> list[int]:
    """Items in their order go to the least loaded bin, the first of equal ones. For bins of equal size every item weighs more than all costs, so that counts come first."""
    extra = sum(costs) + 1 if equal_size else 0
    if equal_size:
        _even(costs, bins)
    loads, out = [(0.0, i) for i in range(bins)], []
    for cost in costs:
        load, b = heapq.heappop(loads)
        out.append(b)
        heapq.heappush(loads, (load + cost + extra, b))
    return out


def differencing_bins(costs: list[float], bins: int, equal_size: bool = False) -> list[int]:
    """Largest differencing: the two partial partitions of largest spread are merged, heaviest part with lightest. Bin 0 is the heaviest in the end.

    A part is (cost, count, items in the order of merging) and parts compare so. Each item begins a partition of its
    own; for bins of equal size `bins` items next to each other by cost begin one, a part each. Of equal spreads the one with the larger heaviest part goes first.
    """
    order = sorted(range(len(costs)), key=lambda i: (costs[i], i))
    empty = (0.0, 0, ())
    if equal_size:
        _even(costs, bins)
        begun = [[(costs[i], 1, ((i, costs[i]),)) for i in order[k : k + bins]] for k in range(0, len(order), bins)]
    else:
        begun = [[(costs[i], 1, ((i, costs[i]),))] + [empty] * (bins - 1) for i in order]

    def entry(parts: list) -> tuple:
        parts = sorted(parts, reverse=True)
        cost, count, items = parts[0]
        return parts[-1][0] - cost, -cost, -count, tuple((-i, -c) for i, c in items), parts

    heap = [entry(parts) for parts in begun]
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[-1], heapq.heappop(heap)[-1]
        heapq.heappush(heap, entry([(x + y, m + n, p + q) for (x, m, p), (y, n, q) in zip(a, reversed(b), strict=True)]))
    out = [0] * len(costs)
    for b, (_, _, items) in enumerate(heap[0][-1] if heap else []):
        for i, _ in items:
            out[i] = b
    return out


def balanced(df: DataFrame, batch: str, key: str, cost: str, bins: int, method: str = "differencing", equal_size: bool = False) -> DataFrame:
    """(batch, key, cost, bin) with bins of each batch balanced by cost, of equal numbers of items if asked for. Items come in the order of keys. A batch is what one step trains on, so it fits a task."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(batch, key, cost).schema) + ", bin int"
    assign = {"differencing": differencing_bins, "greedy": greedy_bins}[method]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key, kind="stable")
        return pdf.assign(bin=pd.Series(assign(pdf[cost].astype(float).tolist(), bins, equal_size), index=pdf.index, dtype="int32"))

    return df.select(batch, key, cost).groupBy(batch).applyInPandas(run, schema)


def micro_batches(df: DataFrame, batch: str, key: str, length: str, most_tokens: int) -> DataFrame:
    """(batch, key, length, micro): as many micro-batches as the tokens of a batch need, balanced by workload."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(batch, key, length).schema) + ", micro int"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key, kind="stable")
        lengths = pdf[length].astype(float).tolist()
        bins = max(1, int(-(-sum(lengths) // most_tokens)))
        cost = [24576 * x + x * x for x in lengths]
        return pdf.assign(micro=pd.Series(differencing_bins(cost, bins), index=pdf.index, dtype="int32"))

    return df.select(batch, key, length).groupBy(batch).applyInPandas(run, schema)


def over_workers(df: DataFrame, batch: str, key: str, length: str, workers: int) -> DataFrame:
    """(batch, key, length, worker, place): each worker gets equally many sequences of a batch and about the same work; `place` numbers the batch's sequences worker by worker."""
    cost = df.select(batch, key, length, workload(F.col(length).cast("double")).alias("_cost"))
    bins = balanced(cost, batch, key, "_cost", workers, equal_size=True).select(batch, key, F.col("bin").alias("worker"))
    place = F.row_number().over(Window.partitionBy(batch).orderBy("worker", key)) - 1
    return cost.drop("_cost").join(bins, [batch, key]).withColumn("place", place)


def zigzag(ranks: Column, bins: int) -> Column:
    """Places of bins in falling order of load that go forth and back, so that neighbours balance: 0 .. n-1, n-1 .. 0."""
    turn, at = F.floor(ranks / bins), F.pmod(ranks, F.lit(bins))
    return F.when(F.pmod(turn, F.lit(2)) == 0, at).otherwise(bins - 1 - at).cast("int")


def imbalance(df: DataFrame, part: str, length: str) -> DataFrame:
    """Largest and smallest sum of lengths over parts, and their difference."""
    g = df.groupBy(part).agg(F.sum(length).alias("total"))
    return g.agg(F.max("total").alias("greatest"), F.min("total").alias("least"), (F.max("total") - F.min("total")).alias("difference"))
