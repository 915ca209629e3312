"""Entities under ordered mutations: a keyed table and a log of inserts, updates and deletes.

What a mutation comes to is told by windows over an entity's log, so any number of entities
change at once. Guards never raise: a mutation that may not apply gets an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

def apply_mutations(state: DataFrame, log: DataFrame, key: str = "id", value: str = "value") -> DataFrame:
    """(key, value, alive, outcomes): entities after a log of (key, seq, op, value).

    insert fails with already_exists on a living entity, update and delete fail
    with not_found on a missing one; failed mutations change nothing. Entities that
    only the state or only the log knows are kept; outcomes name each mutation's error or null.

    Whether an entity lives before a mutation is told by the last insert or delete
    before it, failed or not, else by the state: so all is one window by key.
    """
    kind = state.schema[value].dataType.simpleString()
    now = state.select(key, F.col(value).alias("_v"), F.lit(True).alias("_here"))
    steps = log.select(key, F.col("seq").cast("bigint").alias("seq"), "op", F.col(value).cast(kind).alias("_new")).join(now.select(key, "_here"), key, "left")
    w = Window.partitionBy(key).orderBy("seq", "op", "_new")
    turn = F.when(F.col("op") == "insert", F.lit(True)).when(F.col("op") == "delete", F.lit(False))
    alive = F.coalesce(F.last(turn, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("_here"), F.lit(False))
    error = (
        F.when((F.col("op") == "insert") & F.col("_alive"), F.lit("already_exists")).when(F.col("op").isin("update", "delete") & ~F.col("_alive"), F.lit("not_found"))
        .when(F.col("op").isNull() | ~F.col("op").isin("insert", "update", "delete"), F.lit("unknown_op"))
    )
    steps = steps.withColumns({"_alive": alive, "_turn": turn, "_k": F.row_number().over(w)}).withColumn("error", error)
    wrote = F.col("error").isNull() & (F.col("op") != "delete")
    ends = steps.groupBy(key).agg(
        F.max_by("_new", F.when(wrote, F.col("_k"))).alias("_last"), F.coalesce(F.max(wrote), F.lit(False)).alias("_wrote"),
        F.max_by("_turn", F.when(F.col("_turn").isNotNull(), F.col("_k"))).alias("_end"),
        F.array_sort(F.collect_list(F.struct("_k", "seq", "error"))).alias("_log"),
    )
    both = now.join(ends, key, "full_outer")
    return both.select(
        key, F.when(F.coalesce("_wrote", F.lit(False)), F.col("_last")).otherwise(F.col("_v")).alias(value), F.coalesce("_end", "_here", F.lit(False)).alias("alive"),
        F.transform(F.coalesce("_log", F.array().cast("array<struct<_k:int,seq:bigint,error:string>>")), lambda x: F.struct(x["seq"].alias("seq"), x["error"].alias("error"))).alias("outcomes"))


def guarded_transfers(accounts: DataFrame, transfers: DataFrame) -> DataFrame:
    """(src, dst, seq, amount, error): what a transfer may not do by the accounts as they are at the start.

    The first reason counts: not positive, unknown account, frozen account, balance too low.
    """
    a = accounts.select(F.col("id").alias("src"), F.col("balance").alias("_sb"), F.col("frozen").alias("_sf"))
    b = accounts.select(F.col("id").alias("dst"), F.col("frozen").alias("_df"))
    error = (
        F.when(F.col("amount") <= 0, F.lit("invalid_amount")).when(F.col("_sf").isNull() | F.col("_df").isNull(), F.lit("not_found"))
        .when(F.col("_sf") | F.col("_df"), F.lit("frozen")).when(F.col("_sb") < F.col("amount"), F.lit("insufficient_funds"))
    )
    return transfers.join(a, "src", "left").join(b, "dst", "left").select("src", "dst", "seq", "amount", error.alias("error"))


def state_delta(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """(key, change): created, deleted or changed entities between two states; equal ones are left out, nulls are equal."""
    a, b = before.select(key, F.col(value).alias("_a"), F.lit(1).alias("_x")), after.select(key, F.col(value).alias("_b"), F.lit(1).alias("_y"))
    change = F.when(F.col("_x").isNull(), "created").when(F.col("_y").isNull(), "deleted").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return a.join(b, key, "full_outer").select(key, change.alias("change")).where("change is not null")
