"""Ordered event logs: alignment, rewards, safety checks and potentials over sessions.

Rows are events (session, step order). Rules that look back over a session are
windows; greedy cursors are folds over one session's array inside the engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_order(session: str, *order: str) -> Window:
    return Window.partitionBy(session).orderBy(*order)


def sequences(df: DataFrame, session: str, name: str, *order: str) -> DataFrame:
    """A row a session with its names in order."""
    steps = F.array_sort(F.collect_list(F.struct(*[F.col(o).alias(f"o{i}") for i, o in enumerate(order)], F.col(name).alias("name"))))
    return df.groupBy(session).agg(F.transform(steps, lambda s: s["name"]).alias("names"))


def cursor(names: Column, required: list[str]) -> Column:
    """How many of the required names are met in this order, with others between."""
    need = F.array(*[F.lit(r) for r in required])
    return F.aggregate(names, F.lit(0), lambda at, x: F.when(F.get(need, at) == x, at + 1).otherwise(at))


def aligned(names: Column, required: list[str]) -> Column:
    """How many required names find a later event each: a name that finds none is skipped and the cursor stays."""
    need = F.array(*[F.lit(r) for r in required])
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("hits"))

    def step(s: Column, r: Column) -> Column:
        found = F.array_position(F.slice(names, s["at"] + 1, F.greatest(F.size(names) - s["at"], F.lit(0))), r).cast("int")
        return F.when(found > 0, F.struct((s["at"] + found).alias("at"), (s["hits"] + 1).alias("hits"))).otherwise(s)

    return F.aggregate(need, zero, step)["hits"]


def order_violated(names: Column, first: str, then: str) -> Column:
    """Whether `then` occurs with no `first` before it."""
    a, b = F.array_position(names, F.lit(first)), F.array_position(names, F.lit(then))
    return ((b > 0) & ((a == 0) | (a > b))).cast("int")


def repeated_effects(df: DataFrame, session: str, keys: list[str], *order: str) -> DataFrame:
    """Events whose (tool, arguments) occurred before in the session."""
    w = Window.partitionBy(session, *keys).orderBy(*order)
    return df.withColumn("occurrence", F.row_number().over(w)).where("occurrence > 1")


def created_and_deleted(df: DataFrame, session: str, entity: str, kind: str, created: str, deleted: str, *order: str) -> DataFrame:
    """Entities that a session creates after it deleted them, and those it creates and deletes at all."""
    marked = df.withColumn("_gone", F.max(F.when(F.col(kind) == deleted, F.lit(1)).otherwise(0)).over(
        Window.partitionBy(session, entity).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)))
    return marked.groupBy(session).agg(
        F.max(((F.col(kind) == created) & (F.coalesce("_gone", F.lit(0)) == 1)).cast("int")).alias("recreated"),
        F.sum((F.col(kind) == created).cast("long")).alias("created"), F.sum((F.col(kind) == deleted).cast("long")).alias("deleted"),
    )


def provenance(df: DataFrame, session: str, value: str, observation: str, step: str) -> DataFrame:
    """Adds `known`: whether the value occurs in an earlier observation of the session; values of under three characters pass.

    Each distinct observation of a session counts from its first step, and distinct
    values meet distinct observations, so a long session costs its distinct texts only.
    """
    first = df.groupBy(session, F.col(observation).alias("_seen")).agg(F.min(step).alias("_first")).where("_seen is not null")
    values = df.select(session, value).where(F.length(value) >= 3).distinct()
    since = values.join(first, session).where(F.contains("_seen", value)).groupBy(session, value).agg(F.min("_first").alias("_since"))
    return df.join(since, [session, value], "left").withColumn("known", F.coalesce((F.length(value) < 3) | (F.col("_since") < F.col(step)), F.lit(False))).drop("_since")


def efficiency(calls: Column, required: Column, alpha: float = 0.5, slack: float = 0.5) -> Column:
    """-alpha * max(0, calls - budget) / budget, with budget = required + ceil(slack * required)."""
    budget = F.greatest(required + F.ceil(slack * required), F.lit(1))
    return -alpha * F.greatest(calls - budget, F.lit(0)) / budget


def first_time_bonus(df: DataFrame, session: str, predicate: str, bonus: float, *order: str) -> DataFrame:
    """The bonus counts when a predicate is first met in a session, penalties would always: adds `bonus`."""
    first = F.row_number().over(Window.partitionBy(session, predicate).orderBy(*order)) == 1
    return df.withColumn("bonus", F.when(first, F.lit(bonus)).otherwise(F.lit(0.0)))


def potential_shaping(df: DataFrame, session: str, potential: str, gamma: float, *order: str) -> DataFrame:
    """gamma * next potential - potential by step; the potential after the end is 0."""
    after = F.coalesce(F.lead(potential).over(in_order(session, *order)), F.lit(0.0))
    return df.withColumn("shaping", gamma * after - F.col(potential))


def dual_step(lam: float, streak: int, frozen: bool, cost: float, rate: float, budget: float, most: float, stall_after: int, stall_cost: float) -> tuple[float, int, bool]:
    """One move of a multiplier, lambda + rate * (cost - budget), held within 0 and `most`, with protection against stalls.

    Batches with a cost above stall_cost that would raise lambda lengthen a streak,
    and from `stall_after` on lambda is frozen; batches with at most that cost shorten
    the streak, and below `stall_after` lambda thaws. A frozen lambda doesn't rise but may fall.
    """
    moved = lam + rate * (cost - budget)
    if cost > stall_cost:
        if moved > lam:
            streak += 1
            frozen = frozen or streak >= stall_after
    else:
        streak = max(0, streak - 1)
        frozen = frozen and streak >= stall_after
    return (lam if frozen and moved > lam else max(0.0, min(moved, most))), streak, frozen


def dual_ascent(
    df: DataFrame, key: str, order: str, cost: str, lam: float = 1.0, rate: float = 0.01, budget: float = 0.05, most: float = 3.0,
    stall_after: int = 10, stall_cost: float = 0.5,
) -> DataFrame:
    """key, order, lam, streak and frozen after each batch of (key, order, cost), a row a training step; see dual_step.

    A run's steps are a sequence by nature: runs are spread over tasks, each is
    ordered by the shuffle's sort and walked once. Null costs leave the state as it is.
    """
    kinds = {c: df.schema[c].dataType.simpleString() for c in (key, order)}

    def walk(rows):
        import pandas as pd

        rows = rows.sort_values(order, kind="stable")
        now, streak, frozen, out = lam, 0, False, []
        for c in rows[cost].tolist():
            if c is not None and c == c:
                now, streak, frozen = dual_step(now, streak, frozen, float(c), rate, budget, most, stall_after, stall_cost)
            out.append((now, streak, frozen))
        state = pd.DataFrame(out, columns=["lam", "streak", "frozen"], index=rows.index)
        return pd.concat([rows[[key, order]], state], axis=1)

    return df.select(key, order, cost).groupBy(key).applyInPandas(walk, f"{key} {kinds[key]}, {order} {kinds[order]}, lam double, streak int, frozen boolean")


def valid_replays(df: DataFrame, session: str, failed: Column, most: float = 0.3) -> DataFrame:
    """Sessions whose share of failed steps is at most `most`, with that share."""
    return df.groupBy(session).agg(F.avg(failed.cast("double")).alias("error_rate")).where(F.col("error_rate") <= most)
