"""Seeded sampling, reweighting and controllers. Draws depend on hashes of keys, not on the order of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.advantages import with_totals
from weftline.operators.batch import with_row_index


def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) from an MD5 of seed and key."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 13), 16, 10).cast("bigint") / F.lit(float(2**52))


def mix_draw(key: Column, weights: dict[str, float], seed: int) -> Column:
    """A name drawn by weight: the first, in sorted order, whose cumulative share exceeds the key's number."""
    total, upto, u = sum(weights.values()), 0.0, uniform(key, seed)
    out, bounds = F.lit(sorted(weights)[-1]), []
    for name in sorted(weights):
        upto += weights[name] / total
        bounds.append((name, upto))
    for name, bound in reversed(bounds):
        out = F.when(u < bound, F.lit(name)).otherwise(out)
    return out


def reweighted(df: DataFrame, score: str, method: str = "pow", power: float = 2.0) -> DataFrame:
    """`weight` of a row for resampling: |score|^power, or 1 for the extremes of all scores and 0 between, or 0.4 for the highest and 0.1 for others."""
    if method == "pow":
        return df.withColumn("weight", F.pow(F.abs(score), F.lit(power)))
    total = with_totals(df, _hi=F.max(score), _lo=F.min(score))
    high, rest = {"max_min": (1.0, 0.0), "max_random": (0.4, 0.1)}[method]
    edge = (F.col(score) == F.col("_hi")) if method == "max_random" else (F.col(score) == F.col("_hi")) | (F.col(score) == F.col("_lo"))
    return total.withColumn("weight", F.when(edge, F.lit(high)).otherwise(F.lit(rest))).drop("_hi", "_lo")


def resampled(df: DataFrame, weight: str, key: str, n: int, seed: int, uid: str) -> DataFrame:
    """Copies of the rows of each group by weight, `n` expected a group, by systematic draws with a hashed offset."""
    w = Window.partitionBy(uid).orderBy(key)
    share = F.col(weight) / F.sum(weight).over(Window.partitionBy(uid)) * n
    upto = F.sum("_share").over(w)
    u = uniform(F.col(uid), seed)
    out = df.withColumn("_share", share).withColumn("_copies", (F.floor(upto + u) - F.floor(upto - F.col("_share") + u)).cast("int"))
    return out.where("_copies > 0").withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_copies")))).drop("_share", "_copies", "_k")


def token_covariance(df: DataFrame, a: str = "lp", b: str = "advantage") -> DataFrame:
    """Adds `cov`, (a - mean a)(b - mean b) over all tokens."""
    total = with_totals(df, _a=F.avg(a), _b=F.avg(b))
    return total.withColumn("cov", (F.col(a) - F.col("_a")) * (F.col(b) - F.col("_b"))).drop("_a", "_b")


def covariance_tokens(df: DataFrame, ratio: float, key: list[str], a: str = "lp", b: str = "advantage") -> DataFrame:
    """The int(n * ratio) tokens, at least one, of the highest covariance. Their number grows with the rows, so they are ranked over range partitions."""
    ranked = with_row_index(token_covariance(df, a, b), F.desc("cov"), *key, row="_rank")
    return ranked.where(F.col("_rank") < max(1, int(ranked.count() * ratio))).drop("_rank")


def clipped_covariance_tokens(df: DataFrame, ratio: float, key: list[str], low: float, high: float, seed: int = 0, a: str = "lp", b: str = "advantage") -> DataFrame:
    """max(int(n * ratio), 1) of the tokens with a covariance between two bounds, drawn in the order of a hash of their keys."""
    cov = token_covariance(df, a, b)
    inside = cov.where((F.col("cov") > low) & (F.col("cov") < high))
    draw = uniform(F.concat_ws(":", *[F.col(k).cast("string") for k in key]), seed)
    ranked = with_row_index(inside.withColumn("_u", draw), "_u", *key, row="_rank")
    return ranked.where(F.col("_rank") < max(1, int(df.count() * ratio))).drop("_rank", "_u")


def preferred(df: DataFrame, uid: str, score: str, pos: str) -> DataFrame:
    """Of each adjacent pair of rows of a group the index of the better one; the first of equal ones."""
    pair = F.floor((F.col(pos) - 1) / 2)
    best = F.row_number().over(Window.partitionBy(uid, "pair").orderBy(F.desc(score), F.col(pos)))
    out = df.withColumn("pair", pair).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(uid, "pair")))
    return out.withColumn("chosen", (best == 1).cast("int")).where("_n = 2").drop("_n")


def adaptive_controller(df: DataFrame, order: str, kl: str, steps: str, value: float = 0.2, target: float = 6.0, horizon: float = 10_000.0) -> DataFrame:
    """The coefficient after each batch: value * (1 + clip(kl / target - 1, -0.2, 0.2) * steps / horizon).

    A running product, taken as a sum of logarithms; batches are rows of training steps.
    """
    factor = 1 + F.greatest(F.least(F.col(kl) / target - 1, F.lit(0.2)), F.lit(-0.2)) * F.col(steps) / horizon
    return df.withColumn("value", F.lit(value) * F.exp(F.sum(F.log(factor)).over(Window.orderBy(order))))


def length_trend(df: DataFrame, step: str, length: str, last: int = 50, rows: int = 4096) -> DataFrame:
    """The slope of mean length over the last `last` steps, a least-squares fit in a moving window over steps.

    Steps are numbered and dealt to buckets of `rows`; the last steps of a bucket are
    copied to the next, so no window holds more than a bucket and these.
    """
    by_step = with_row_index(df.groupBy(step).agg(F.avg(length).alias("mean_length")), step)
    own = F.floor(F.col("row_idx") / rows)
    spread = F.when(F.col("row_idx") % rows >= rows - (last - 1), F.array(own, own + 1)).otherwise(F.array(own))
    w = Window.partitionBy("_b").orderBy("row_idx").rowsBetween(-(last - 1), 0)
    out = by_step.withColumn("_own", own).withColumn("_b", F.explode(spread)).withColumn("slope", F.regr_slope("mean_length", F.col(step)).over(w))
    return out.where("_b = _own").drop("_b", "_own", "row_idx")


def logged_sample(df: DataFrame, text: str, n: int, seed: int = 42) -> DataFrame:
    """n rows for a log, in the order of a seeded hash of their text: a top-k report."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(text))), text).limit(n)


def shuffled_choices(key: Column, right: Column, wrong: Column, seed: int = 42) -> Column:
    """Wrong answers in a hashed order with the right one at a hashed place: a struct of choices and the right letter."""
    mixed = F.transform(F.array_sort(F.transform(wrong, lambda w: F.struct(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"), w)).alias("h"), w.alias("w")))), lambda s: s["w"])
    at = F.floor(uniform(F.concat(F.lit("place:"), key.cast("string")), seed) * (F.size(wrong) + 1)).cast("int")
    return F.struct(F.concat(F.slice(mixed, F.lit(1), at), F.array(right), F.slice(mixed, at + 1, F.size(wrong))).alias("choices"), F.substring(F.lit("ABCDEFGHIJ"), at + 1, F.lit(1)).alias("letter"))
