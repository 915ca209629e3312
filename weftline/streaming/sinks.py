"""Sinks that a replayed micro-batch leaves as they are: everything is kept by the number of its batch.

foreachBatch may hand a batch over again after a failure. What a batch writes goes to a folder of its own,
written anew by a replay, and a state that moves from batch to batch is made from that of the batch before. So a replay gives
what the first try gave.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.operators.batch import with_row_index
from weftline.operators.metrics import linear_percentile
from weftline.operators.trajectories import dual_step

CONTROL = "batch long, samples long, cost double, lam double, streak int, frozen boolean, skipped boolean"
#: Columns that may name the cost, the first that is there counts; then the field of the extra information.
COSTS = ("c_safety", "C_safety", "is_unsafe")
EXTRA = "reward_extra_info"


def batch_cost(batch: DataFrame) -> Column | None:
    """The column of a sample's cost, if the batch has one: 0 or 1."""
    for name in COSTS:
        if name in batch.columns:
            return F.col(name).cast("int")
    return F.get_json_object(EXTRA, "$.c_safety").cast("int") if EXTRA in batch.columns else None


def finished(spark: SparkSession, path: str, before: int = 1 << 62) -> list[str]:
    """The folders of all batches before one, in order; those of unfinished writes are passed over by their missing mark."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(root):
        return []
    names = [s.getPath().getName() for s in system.listStatus(root) if system.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return [f"{path}/{n}" for n in sorted(names) if n.startswith("batch-") and int(n.removeprefix("batch-")) < before]


def folder(path: str, batch: int) -> str:
    return f"{path}/batch-{batch:010d}"


def multiplier_sink(path: str, lam: float = 1.0, rate: float = 0.01, budget: float = 0.05, most: float = 3.0, stall_after: int = 10, stall_cost: float = 0.5) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that moves a multiplier by each batch's mean cost; see dual_step. Its table has a row a batch.

    A batch without costs leaves the multiplier as it is. `skipped` tells that a rise was held back.
    """

    def commit(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        cost = batch_cost(batch)
        seen = batch.agg(F.count(cost).alias("n"), F.avg(cost).alias("c")).first() if cost is not None else None
        past = finished(spark, path, number)
        now = spark.read.schema(CONTROL).parquet(past[-1]).first() if past else None
        state = (now.lam, now.streak, now.frozen) if now else (lam, 0, False)
        moved, skipped = state, False
        if seen and seen.n:
            moved = dual_step(*state, float(seen.c), rate, budget, most, stall_after, stall_cost)
            skipped = moved[2] and state[0] + rate * (seen.c - budget) > state[0]
        row = (number, seen.n if seen else 0, float(seen.c) if seen and seen.n else None, *moved, skipped)
        spark.createDataFrame([row], CONTROL).coalesce(1).write.mode("overwrite").parquet(folder(path, number))

    return commit


def batch_sink(path: str, required: int, metrics: dict[str, Column] | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that assembles training batches of `required` samples and keeps their statistics.

    Samples (seq, param_version, version_start, version_end, seconds and others) wait until `required` are there; each micro-batch writes the
    assembled ones (column `assembled` numbers the training batch) and those that still wait, in the order of seq, and
    one row a metric: versions, seconds and partial rollouts as metric_rows() has them, and `metrics`, aggregates over the assembled samples.
    """

    def commit(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in batch.schema.fields) + ", assembled long"
        past, pool, done = finished(spark, f"{path}/samples", number), batch, 0
        if past:
            waiting = spark.read.schema(kind).parquet(past[-1]).where("assembled is null").drop("assembled")
            pool = waiting.unionByName(batch)
            done = spark.read.schema(kind).parquet(*past).agg(F.coalesce(F.max("assembled"), F.lit(0))).first()[0]
        numbered = with_row_index(pool, "seq")
        whole = numbered.count() // required * required
        out = numbered.withColumn("assembled", F.when(F.col("row_idx") < whole, F.floor(F.col("row_idx") / required) + done + 1).cast("bigint")).drop("row_idx")
        out.write.mode("overwrite").parquet(folder(f"{path}/samples", number))
        ready = spark.read.schema(kind).parquet(folder(f"{path}/samples", number)).where("assembled is not null")
        metric_rows(ready, number, metrics).write.mode("overwrite").parquet(folder(f"{path}/metrics", number))

    return commit


METRICS = "batch long, key string, value double"


def metric_rows(ready: DataFrame, number: int, metrics: dict[str, Column] | None = None) -> DataFrame:
    """(batch, key, value): count, versions, mean, extremes and percentiles of seconds, and partial rollouts: how many, their share and the widest span of versions."""
    span = F.abs(F.col("version_end") - F.col("version_start"))
    one = ready.agg(
        F.count(F.lit(1)).cast("double").alias("samples"), F.countDistinct("param_version").cast("double").alias("param_version_diversity"), F.avg("seconds").alias("processing_time/avg"),
        F.max("seconds").alias("processing_time/max"), F.min("seconds").alias("processing_time/min"), F.sum((span > 0).cast("double")).alias("partial/total_partial_num"),
        F.avg((span > 0).cast("double")).alias("partial/partial_ratio"), F.max(span).cast("double").alias("partial/max_partial_span"), *[c.alias(k) for k, c in (metrics or {}).items()],
    )
    wide = one.crossJoin(F.broadcast(linear_percentile(ready, "seconds", {f"processing_time/tp{p}": p / 100 for p in (50, 95, 99)})))
    entries = F.array(*[F.struct(F.lit(c).alias("key"), F.col(f"`{c}`").cast("double").alias("value")) for c in wide.columns])
    return wide.where("samples > 0").select(F.lit(number).cast("bigint").alias("batch"), F.explode(entries).alias("m")).select("batch", "m.*")


def committed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all finished batches of a sink's table."""
    folders = finished(spark, path)
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def run(stream: DataFrame, sink: Callable[[DataFrame, int], None], progress: str) -> None:
    """Give a sink what is there now; a rerun takes up where it stopped."""
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()


def stall_streaks(df: DataFrame, key: str, order: str, rose: str, unsafe_rate: str, stall_after: int = 10, stall_cost: float = 0.5) -> DataFrame:
    """Adds streak and stalled: steps in which a multiplier rose while most groups were all unsafe lengthen the streak, others shorten it, never below 0.

    Such a walk held above 0 is its sum less the least sum so far: two windows by key, no loop.
    """
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    move = F.when(F.col(rose) & (F.col(unsafe_rate) > stall_cost), 1).otherwise(-1)
    walked = df.withColumn("_sum", F.sum(move).over(w)).withColumn("_least", F.least(F.min("_sum").over(w), F.lit(0)))
    return walked.withColumn("streak", (F.col("_sum") - F.col("_least")).cast("int")).withColumn("stalled", F.col("streak") >= stall_after).drop("_sum", "_least")
