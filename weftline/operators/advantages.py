"""Group-relative statistics: advantage estimators as window functions.

Every estimator takes rows with a group key and a score and adds `advantage`. The
group statistics are window aggregates, so each needs one shuffle by the key at
most; totals over all rows are aggregated once and joined back as one broadcast row.
Estimators differ in the deviation they divide by and in what single rows get, so
each states its own rule.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-6

#: Estimators by name; a second registration of a name is an error.
ESTIMATORS: dict[str, Callable[..., DataFrame]] = {}


def register(name: str) -> Callable:
    """Register an estimator (DataFrame, **options) -> DataFrame under a name."""

    def put(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if ESTIMATORS.get(name, f) is not f:
            raise ValueError(f"estimator {name} is registered already")
        ESTIMATORS[name] = f
        return f

    return put


def with_totals(df: DataFrame, **aggregates: Column) -> DataFrame:
    """Columns with aggregates over all rows: partial sums on all tasks, then one broadcast row."""
    return df.crossJoin(F.broadcast(df.agg(*[c.alias(k) for k, c in aggregates.items()])))


def _group(uid: str) -> Window:
    return Window.partitionBy(uid)


@register("grpo")
def grpo(df: DataFrame, uid: str = "uid", score: str = "score", by_std: bool = True, eps: float = EPS) -> DataFrame:
    """(score - mean) / (sample deviation + eps); a single row keeps its score with mean 0 and deviation 1."""
    w = _group(uid)
    one = F.count(F.lit(1)).over(w) == 1
    centred = F.when(one, F.col(score)).otherwise(F.col(score) - F.avg(score).over(w))
    scale = F.when(one, F.lit(1.0)).otherwise(F.stddev_samp(score).over(w)) + eps
    return df.withColumn("advantage", centred / scale if by_std else centred)


@register("grpo_floored")
def grpo_floored(df: DataFrame, uid: str = "uid", score: str = "score", eps: float = EPS) -> DataFrame:
    """Like grpo, with the sample variance floored at eps before the root, and eps added after it."""
    w = _group(uid)
    one = F.count(F.lit(1)).over(w) == 1
    centred = F.when(one, F.col(score)).otherwise(F.col(score) - F.avg(score).over(w))
    scale = F.when(one, F.lit(1.0)).otherwise(F.sqrt(F.greatest(F.var_samp(score).over(w), F.lit(eps))))
    return df.withColumn("advantage", centred / (scale + eps))


def group_moments(df: DataFrame, uid: str = "uid", score: str = "score", eps: float = EPS) -> DataFrame:
    """(uid, n, mean, std) of each group: the root of the sample variance, floored at eps; a single row has mean 0 and deviation 1. Aggregates only, so a hot group is no burden."""
    one = F.count(score) == 1
    return df.groupBy(uid).agg(
        F.count(score).alias("n"), F.when(one, F.lit(0.0)).otherwise(F.avg(score)).alias("mean"), F.when(one, F.lit(1.0)).otherwise(F.sqrt(F.greatest(F.var_samp(score), F.lit(eps)))).alias("std"))


@register("pass_at_k")
def pass_at_k(df: DataFrame, uid: str = "uid", score: str = "score", order: str = "pos", by_std: bool = True, eps: float = EPS) -> DataFrame:
    """The best row of a group gets the lead over the second, others 0. Of equal scores the
    first by `order` is best. Groups of one row are an error elsewhere; here they get null."""
    w = _group(uid)
    ranked = Window.partitionBy(uid).orderBy(F.col(score).desc(), F.col(order))
    second = F.max(F.when(F.col("_rank") == 2, F.col(score))).over(w)
    lead = F.when(F.col("_rank") == 1, F.col(score) - second).otherwise(F.lit(0.0))
    value = lead / (F.stddev_samp(score).over(w) + eps) if by_std else lead
    return df.withColumn("_rank", F.row_number().over(ranked)).withColumn(
        "advantage", F.when(F.count(F.lit(1)).over(w) > 1, value)
    ).drop("_rank")


@register("rloo")
def rloo(df: DataFrame, uid: str = "uid", score: str = "score", single: str = "keep") -> DataFrame:
    """Leave-one-out: score - mean of the others; a single row keeps its score, or gets 0 with single="zero"."""
    w = _group(uid)
    n = F.count(F.lit(1)).over(w)
    alone = F.col(score) if single == "keep" else F.lit(0.0)
    return df.withColumn("advantage", F.when(n == 1, alone).otherwise((F.col(score) - F.avg(score).over(w)) * n / F.nullif(n - 1, F.lit(0))))


@register("opo")
def opo(df: DataFrame, uid: str = "uid", score: str = "score", length: str = "length") -> DataFrame:
    """score - the mean weighted by length; a single row keeps its score."""
    w = _group(uid)
    base = F.sum(F.col(score) * F.col(length)).over(w) / F.sum(length).over(w)
    return df.withColumn("advantage", F.when(F.count(F.lit(1)).over(w) == 1, F.col(score)).otherwise(F.col(score) - base))


@register("gpg")
def gpg(df: DataFrame, uid: str = "uid", score: str = "score", f_norm: float = 1.0) -> DataFrame:
    """alpha (score - mean) / f_norm, alpha = rows / rows with a nonzero score; a single row keeps alpha * score."""
    w = _group(uid)
    mean = F.when(F.count(F.lit(1)).over(w) == 1, F.lit(0.0)).otherwise(F.avg(score).over(w))
    total = with_totals(df, _n=F.count(F.lit(1)), _some=F.count(F.nullif(F.col(score), F.lit(0.0))))
    alpha = F.col("_n") / F.greatest(F.col("_some"), F.lit(1))
    return total.withColumn("advantage", alpha * (F.col(score) - mean) / f_norm).drop("_n", "_some")


def whitened(df: DataFrame, column: str, out: str = "advantage", shift_mean: bool = True) -> DataFrame:
    """(x - mean) / sqrt(variance + 1e-8) over all rows, with the sample variance; optionally moved back by the mean."""
    total = with_totals(df, _m=F.avg(column), _v=F.var_samp(column))
    white = (F.col(column) - F.col("_m")) / F.sqrt(F.col("_v") + 1e-8)
    return total.withColumn(out, white if shift_mean else white + F.col("_m")).drop("_m", "_v")


@register("reinforce_baseline")
def reinforce_baseline(df: DataFrame, uid: str = "uid", score: str = "score") -> DataFrame:
    """score - group mean (0 for a single row), whitened over all rows."""
    w = _group(uid)
    mean = F.when(F.count(F.lit(1)).over(w) == 1, F.lit(0.0)).otherwise(F.avg(score).over(w))
    return whitened(df.withColumn("_c", F.col(score) - mean), "_c").drop("_c")


@register("batch_zscore")
def batch_zscore(df: DataFrame, score: str = "score", eps: float = EPS) -> DataFrame:
    """(score - mean) / population deviation over all rows; 0 for fewer than two rows or a deviation below eps."""
    total = with_totals(df, _n=F.count(F.lit(1)), _m=F.avg(score), _s=F.stddev_pop(score))
    flat = (F.col("_n") < 2) | (F.col("_s") < eps)
    return total.withColumn("advantage", F.when(flat, F.lit(0.0)).otherwise((F.col(score) - F.col("_m")) / F.nullif(F.col("_s"), F.lit(0.0)))).drop("_n", "_m", "_s")


@register("stratified")
def stratified(
    df: DataFrame, uid: str = "uid", level: str = "level", scenario: str = "scenario", score: str = "score",
    beta: float = 0.25, least: int = 3, eps: float = EPS, by_std: bool = True,
) -> DataFrame:
    """Strata (level, scenario) within a group, plus beta times the z-score in the whole group.

    A row is centred on its stratum if that has at least `least` rows, or two; a lone
    row is centred on its scenario within the group if that has two rows, else on the
    group. The difference is divided by the population deviation (at least eps) only
    where the level it is taken from has `least` rows and by_std holds. Strata between
    two and `least` rows give 0. The group's own term is divided from two rows on.
    """
    # the columns of a wider window come first, and one sort in the finest order serves all three
    spec = {
        "g": Window.partitionBy(uid), "c": Window.partitionBy(uid, scenario), "s": Window.partitionBy(uid, scenario, level),
    }
    stats = {
        f"_{k}{name}": f.over(w) for k, w in spec.items()
        for name, f in (("n", F.count(F.lit(1))), ("m", F.avg(score)), ("d", F.stddev_pop(score)))
    }
    df = df.sortWithinPartitions(uid, scenario, level)
    df = df.withColumns(stats)

    def centred(k: str, rows: int) -> Column:
        diff = F.col(score) - F.col(f"_{k}m")
        return F.when((F.col(f"_{k}n") >= rows) & F.lit(by_std), diff / F.greatest(F.col(f"_{k}d"), F.lit(eps))).otherwise(diff)

    lone = F.when(F.col("_cn") >= 2, centred("c", least)).otherwise(centred("g", least))
    own = F.when(F.col("_sn") >= least, centred("s", least)).when(F.col("_sn") == 2, centred("s", least)).when(F.col("_sn") == 1, lone).otherwise(F.lit(0.0))
    return df.withColumn("advantage", own + beta * centred("g", 2)).drop(*stats)


@register("softmean")
def softmean_advantage(df: DataFrame, uid: str = "uid", score: str = "score", beta: float = 1.0) -> DataFrame:
    """score - softmean, (1/beta) log(mean(exp(beta score))) of the group; the plain mean for beta 0.
    The largest score is taken out before exponentials, so large scores don't overflow."""
    w = _group(uid)
    if beta == 0:
        return df.withColumn("advantage", F.col(score) - F.avg(score).over(w))
    top = F.max(F.lit(beta) * F.col(score)).over(w)
    df = df.withColumn("_top", top)
    soft = (F.col("_top") + F.log(F.avg(F.exp(beta * F.col(score) - F.col("_top"))).over(w))) / beta
    return df.withColumn("advantage", F.col(score) - soft).drop("_top")


def zero_saturated(df: DataFrame, uid: str = "uid", score: str = "score", least_std: float = 0.01, advantage: str = "advantage") -> DataFrame:
    """Advantages of groups whose scores hardly vary (population deviation below `least_std`) become 0."""
    flat = F.stddev_pop(score).over(_group(uid)) < least_std
    return df.withColumn(advantage, F.when(flat, F.lit(0.0)).otherwise(F.col(advantage)))


def scalar_return(df: DataFrame, reward: str, shaping: str, process: str, cost: str, lam: float, shape_weight: float = 0.0, process_weight: float = 0.0) -> DataFrame:
    """J = reward + shape_weight * shaping + process_weight * process - lambda * cost."""
    return df.withColumn("j", F.col(reward) + shape_weight * F.col(shaping) + process_weight * F.col(process) - lam * F.col(cost))


def scalar_group_advantage(df: DataFrame, uid: str = "uid", score: str = "score", eps: float = EPS) -> DataFrame:
    """(score - mean) / population deviation with a saturated flag; 0 for saturated groups."""
    w = _group(uid)
    std = F.stddev_pop(score).over(w)
    return df.withColumn("saturated", std < eps).withColumn(
        "advantage", F.when(F.col("saturated"), F.lit(0.0)).otherwise((F.col(score) - F.avg(score).over(w)) / F.greatest(std, F.lit(eps)))
    )


def summed_rloo(df: DataFrame, rewards: list[str], uid: str = "uid", pos: str = "pos") -> DataFrame:
    """Leave-one-out values of several rewards, summed, cumulated from the end of a sequence and whitened over all rows."""
    from weftline.operators.sequences import reward_to_go

    out, names = df, []
    for i, r in enumerate(rewards):
        names.append(f"_loo{i}")
        out = rloo(out, uid, r).withColumnRenamed("advantage", names[-1])
    total = sum((F.col(n) for n in names[1:]), F.col(names[0]))
    return whitened(reward_to_go(out.withColumn("_sum", total), uid, pos, "_sum"), "returns").drop("_sum", *names)
