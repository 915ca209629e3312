"""Orders of training rows: by number, by a seeded permutation, or drawn by priorities that scores move.

Priorities are a keyed table. A batch is drawn without replacement by exponential keys, -ln(u) / priority: the smallest are
the sample. Ranks run over range partitions, so neither the table nor a batch has to fit a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.batch import with_row_index
from weftline.operators.sampling import uniform


def epoch_order(df: DataFrame, key: str, shuffle: bool = True, seed: int = 1, epoch: int = 0) -> DataFrame:
    """The rows with `position` in an epoch: the order of keys, or of a hash of seed, epoch and key."""
    draw = [F.md5(F.concat(F.lit(f"{seed}:{epoch}:"), F.col(key).cast("string")))] if shuffle else []
    return with_row_index(df, *draw, key, row="position")


def exponential_key(key: Column, priority: Column, seed: int, step: int) -> Column:
    """The smaller, the earlier drawn; null, zero and negative priorities are never drawn."""
    u = uniform(F.concat(F.lit(f"{step}:"), key.cast("string")), seed)
    return F.when(priority > 0, -F.log(F.lit(1.0) - u) / priority)


def drawn(priorities: DataFrame, key: str, priority: str, n: int, seed: int = 1, step: int = 0) -> DataFrame:
    """The n rows of a step (all if fewer can be drawn), with their `position`: weighted sampling without replacement."""
    weighed = priorities.withColumn("_e", exponential_key(F.col(key), F.col(priority), seed, step)).where("_e is not null")
    return with_row_index(weighed, "_e", key, row="position").where(F.col("position") < n).drop("_e")


def reprioritised(priorities: DataFrame, key: str, priority: str, scores: DataFrame, score: str, rate: float = 0.5, target: float = 0.5, least: float = 0.01) -> DataFrame:
    """Priorities after a batch's scores: moved by `rate` towards 1 - 2 |score - target|, at least `least`, so that rows neither solved nor hopeless come first.

    A row scored several times counts with its mean; scores of unknown keys are passed over and unscored rows stay.
    """
    mean = scores.groupBy(F.col(key).alias("_key")).agg(F.avg(score).alias("_score"))
    aim = F.greatest(1 - 2 * F.abs(F.col("_score") - F.lit(target)), F.lit(least))
    moved = F.when(F.col("_score").isNull(), F.col(priority)).otherwise(F.greatest((1 - rate) * F.col(priority) + rate * aim, F.lit(least)))
    joined = priorities.join(mean, F.col(key) == F.col("_key"), "left")
    return joined.select(*[moved.alias(c) if c == priority else priorities[c] for c in priorities.columns])
