"""Metric aggregation: reducers by name, at-N statistics, percentiles and length reports."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.batch import with_running_sum


def reduce_by_name(df: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """A name with "max" takes the maximum, else one with "min" the minimum, else the mean."""
    g = df.groupBy(key).agg(F.max(value).alias("hi"), F.min(value).alias("lo"), F.avg(value).alias("mean"))
    return g.select(key, F.when(F.contains(F.col(key), F.lit("max")), F.col("hi")).when(F.contains(F.col(key), F.lit("min")), F.col("lo")).otherwise(F.col("mean")).alias("value"))


#: Substring rules in the order they are tried; the first that matches decides.
RULES = (("timing_s/", "sum"), ("max", "max"), ("min", "min"), ("mean", "avg"), ("avg", "avg"), ("sum", "sum"), ("total", "sum"), ("count", "sum"))


def aggregation_rule(key: Column) -> Column:
    rule = F.lit("avg")
    for text, kind in reversed(RULES):
        rule = F.when(F.contains(key, F.lit(text)), F.lit(kind)).otherwise(rule)
    return rule


def aggregate_metrics(df: DataFrame, key: str = "key", value: str = "value", step: str = "step") -> DataFrame:
    """sum, max, min or mean over steps by the rules above; names that end in "last" take the value of the last step."""
    g = df.groupBy(key).agg(
        F.sum(value).alias("sum"), F.max(value).alias("max"), F.min(value).alias("min"), F.avg(value).alias("avg"),
        F.max(F.struct(step, value)).getField(value).alias("last"),
    )
    rule = F.when(F.col(key).endswith("last"), F.lit("last")).otherwise(aggregation_rule(F.col(key)))
    pick = F.lit(None).cast("double")
    for kind in ("sum", "max", "min", "avg", "last"):
        pick = F.when(F.col("rule") == kind, F.col(kind)).otherwise(pick)
    return g.withColumn("rule", rule).select(key, "rule", pick.alias("value"))


def majority(df: DataFrame, groups: list[str], pred: str, value: str, order: str) -> DataFrame:
    """The most frequent prediction of a group (of ties, the first seen) with the value it had first."""
    votes = df.groupBy(*groups, pred).agg(F.count(F.lit(1)).alias("votes"), F.min(F.struct(order, value)).alias("first"))
    best = F.row_number().over(Window.partitionBy(*groups).orderBy(F.desc("votes"), F.col(f"first.{order}")))
    return votes.withColumn("_k", best).where("_k = 1").select(*groups, F.col(pred), F.col(f"first.{value}").alias(value), "votes")


def at_n(df: DataFrame, source: str = "source", uid: str = "uid", value: str = "score") -> DataFrame:
    """mean@N and std@N (population) by uid, then their means by source, for each N that occurs."""
    by_uid = df.groupBy(source, uid).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("m"), F.stddev_pop(value).alias("d"))
    return by_uid.groupBy(source, "n").agg(F.count(F.lit(1)).alias("groups"), F.avg("m").alias("mean_at_n"), F.avg("d").alias("std_at_n"))


def bootstrap_at_n(df: DataFrame, source: str = "source", uid: str = "uid", value: str = "score", resamples: int = 1000, seed: int = 42) -> DataFrame:
    """best@n and worst@n, mean and population deviation over resamples with replacement, for n = 2, 4, ... below N and N.

    A prompt's samples are a bounded group; prompts spread over tasks by key.
    """
    schema = f"{source} string, {uid} long, n int, best double, best_std double, worst double, worst_std double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        x = pdf[value].to_numpy(float)
        rng, rows, n = np.random.default_rng(seed), [], 2
        sizes = []
        while n < len(x):
            sizes.append(n)
            n *= 2
        for n in [*sizes, len(x)]:
            drawn = x[rng.integers(0, len(x), (resamples, n))]
            best, worst = drawn.max(1), drawn.min(1)
            rows.append((pdf[source].iloc[0], pdf[uid].iloc[0], n, best.mean(), best.std(), worst.mean(), worst.std()))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return df.select(source, uid, value).groupBy(source, uid).applyInPandas(run, schema)


def expected_at_n(df: DataFrame, source: str = "source", uid: str = "uid", value: str = "score") -> DataFrame:
    """What bootstrap_at_n comes near to, in closed form: mean and deviation of the best and the worst of n draws with replacement.

    Of N sorted values the i-th is the best of n draws with probability
    (i / N)^n - ((i - 1) / N)^n. Windows by prompt only, and no draws.
    """
    own = Window.partitionBy(source, uid)
    rows = df.select(source, uid, F.col(value).alias("_x")).withColumns({"_i": F.row_number().over(own.orderBy("_x")), "_all": F.count(F.lit(1)).over(own)})
    sizes = F.expr("concat(filter(transform(sequence(1, 30), p -> shiftleft(1L, p)), x -> x < _all), array(_all))")
    each = rows.withColumn("n", F.explode(sizes))
    share = lambda k: F.pow(k / F.col("_all"), F.col("n"))
    up, down = share(F.col("_i")) - share(F.col("_i") - 1), share(F.col("_all") - F.col("_i") + 1) - share(F.col("_all") - F.col("_i"))
    sums = each.groupBy(source, uid, "n").agg(*[F.sum(F.col("_x") ** k * p).alias(f"{c}{k}") for c, p in (("b", up), ("w", down)) for k in (1, 2)])
    std = lambda c: F.sqrt(F.greatest(F.col(f"{c}2") - F.col(f"{c}1") ** 2, F.lit(0.0)))
    return sums.select(source, uid, F.col("n").cast("int").alias("n"), F.col("b1").alias("best"), std("b").alias("best_std"), F.col("w1").alias("worst"), std("w").alias("worst_std"))


def _ranked(df: DataFrame, value: str) -> tuple[DataFrame, DataFrame]:
    """Distinct values with how many rows are up to each, and the total as one row; values are counted before they are ordered."""
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("c"))
    upto = with_running_sum(counts, "c", value)
    return upto, upto.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"))


def index_percentile(df: DataFrame, value: str, shares: dict[str, float]) -> DataFrame:
    """sorted[max(0, min(n - 1, int(n * p) - 1))], without interpolation, for each share."""
    upto, total = _ranked(df, value)
    at = lambda p: F.greatest(F.lit(0), F.least(F.col("n") - 1, F.floor(F.col("n") * F.lit(p)) - 1))
    return upto.crossJoin(F.broadcast(total)).agg(*[F.min(F.when(F.col("upto") > at(p), F.col(value))).alias(k) for k, p in shares.items()])


def linear_percentile(df: DataFrame, value: str, shares: dict[str, float]) -> DataFrame:
    """Percentiles with linear interpolation between the values at both sides of p * (n - 1), as one row."""
    upto, total = _ranked(df, value)
    spot = lambda p: F.lit(p) * (F.col("n") - 1)
    ends = [F.min(F.when(F.col("upto") > f(spot(p)), F.col(value))).alias(f"{k}_{e}") for k, p in shares.items() for e, f in (("lo", F.floor), ("hi", F.ceil))]
    one = upto.crossJoin(F.broadcast(total)).agg(*ends, F.max("n").alias("n"))
    return one.select(*[(F.col(f"{k}_lo") + (F.col(f"{k}_hi") - F.col(f"{k}_lo")) * (spot(p) - F.floor(spot(p)))).alias(k) for k, p in shares.items()])


def length_report(df: DataFrame, length: str, limit: int, near: float = 0.9) -> DataFrame:
    """One row: n, longest, percentiles by index, rows over the limit and rows near it."""
    base = df.agg(
        F.count(length).alias("n"), F.max(length).alias("longest"), F.sum((F.col(length) > limit).cast("long")).alias("overflow"),
        F.sum(((F.col(length) > limit * near) & (F.col(length) <= limit)).cast("long")).alias("near_limit"),
    )
    return base.crossJoin(F.broadcast(index_percentile(df, length, {"p50": 0.5, "p95": 0.95, "p99": 0.99})))


def describe(df: DataFrame, columns: list[str], ignore: Column | None = None) -> DataFrame:
    """(name, mean, greatest, least) of numeric columns in one pass."""
    df = df if ignore is None else df.where(~ignore)
    one = df.agg(*[f(c).alias(f"{k}_{c}") for c in columns for k, f in (("mean", F.avg), ("max", F.max), ("min", F.min))])
    return one.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("name"), F.col(f"mean_{c}").alias("mean"), F.col(f"max_{c}").cast("double").alias("greatest"), F.col(f"min_{c}").cast("double").alias("least"))
        for c in columns
    ])).alias("m")).select("m.*")


def tail_share(df: DataFrame, value: str, k: float = 10) -> DataFrame:
    """Share of values above the (100 - k) % quantile, least and greatest."""
    q = linear_percentile(df, value, {"q": (100 - k) / 100})
    return df.crossJoin(F.broadcast(q)).agg(F.avg((F.col(value) > F.col("q")).cast("double")).alias("tail_share"), F.min(value).alias("least"), F.max(value).alias("greatest"))


def rollout_report(df: DataFrame, seconds: str, version: str, partial: str) -> DataFrame:
    """One row over collected rollouts: median, 95th and 99th percentile of seconds, distinct versions and the share of partial ones."""
    base = df.agg(F.countDistinct(version).alias("versions"), F.avg(F.col(partial).cast("double")).alias("partial_ratio"), F.count(F.lit(1)).alias("n"))
    return linear_percentile(df, seconds, {"tp50": 0.5, "tp95": 0.95, "tp99": 0.99}).crossJoin(F.broadcast(base))


def timing_means(df: DataFrame, key: str, value: str) -> DataFrame:
    """The mean of each timing over ranks."""
    return df.groupBy(key).agg(F.avg(value).alias("mean"))


def throughput(df: DataFrame, key: str, tokens: str, seconds: str, devices: int) -> DataFrame:
    """Tokens a second and device, and milliseconds a token, by key."""
    e = df.groupBy(key).agg(F.sum(tokens).alias("_t"), F.sum(seconds).alias("_s"))
    return e.select(key, (F.col("_t") / F.col("_s") / devices).alias("per_second"), (F.col("_s") * 1000 / F.col("_t")).alias("ms_per_token"))


def source_means(df: DataFrame, source: str, scores: str) -> DataFrame:
    """The mean by source of the mean of each row's list of scores."""
    mean = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(scores), F.lit(0))
    return df.groupBy(source).agg(F.avg(mean).alias("mean_score"), F.count(F.lit(1)).alias("rows"))
