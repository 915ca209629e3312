"""Corrections of rollout data, preference accuracies, entropy losses and the registry of losses, over rows (group, position)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators import sequences as seq

#: Policy losses by name; a second registration of a name is an error.
LOSSES: dict[str, Callable[..., DataFrame]] = {}


def register_loss(name: str) -> Callable:
    """Register a loss (DataFrame, **options) -> DataFrame with a column `loss` under a name."""

    def put(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if LOSSES.get(name, f) is not f:
            raise ValueError(f"loss {name} is registered already")
        LOSSES[name] = f
        return f

    return put


for _kind in ("clip", "gspo", "gpg", "geo_mean"):
    register_loss(_kind)(lambda df, _kind=_kind, **options: seq.policy_loss(df, _kind, **options))


def corrected(df: DataFrame, mask: str, weights: str | None = "token", threshold: float = 2.0, rejection: str | None = None, upper: float = 2.0, lower: float | None = None, veto: float | None = None, normalise: bool = False, uid: str = "uid") -> DataFrame:
    """Importance weights and the mask after rejection and veto, composed: `weight` is 0 off the first mask, `kept` is what is left of it.

    Weights are truncated ratios by token or sequence; rejection drops tokens or
    sequences whose ratio leaves its bounds; a veto drops sequences with one token far
    below the rollout policy. Each is left out where its option is null.
    """
    on = F.col(mask).cast("double")
    out = seq.importance_weights(df, weights, threshold, uid, normalise=normalise).withColumn("weight", F.col("weight") * on) if weights else df.withColumn("weight", on)
    kept = on
    if rejection:
        out = seq.rejection_mask(out, rejection, upper, lower, uid).withColumnRenamed("keep", "_r")
        kept = kept * F.col("_r")
    if veto is not None:
        out = seq.veto(out, veto, uid).withColumnRenamed("keep", "_v")
        kept = kept * F.col("_v")
    return out.withColumn("kept", kept).drop("_r", "_v")


@register_loss("corrected")
def corrected_loss(df: DataFrame, mask: str = "mask", advantage: str = "advantage", mode: str = "seq-mean-token-sum", **options) -> DataFrame:
    """One row: the policy-gradient loss -advantage * lp * weight over the tokens that the correction keeps."""
    out = corrected(df, mask, **options).withColumn("loss", -F.col(advantage) * F.col("lp") * F.col("weight"))
    return seq.aggregate_loss(out, "loss", "kept", mode)


def entropy_loss(df: DataFrame, logits: Column, mask: str, mode: str = "token-mean", uid: str = "uid") -> DataFrame:
    """One row: the mean entropy of token distributions given as logits, over a mask."""
    from weftline.functions.arrays import entropy

    return seq.aggregate_loss(df.withColumn("_h", entropy(logits)), "_h", mask, mode, uid)


def pair_accuracy(df: DataFrame, uid: str, pos: str, score: str, accuracy: str) -> DataFrame:
    """(uid, agreement): over pairs of a group in order, how often the score prefers the more accurate one, weighed by the difference; 0.5 where all are alike.

    Groups are one prompt's samples, so pairs are counted inside a group's array.
    """
    rows = F.transform(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(score).cast("double").alias("s"), F.col(accuracy).cast("double").alias("a")))), lambda x, i: F.struct(i.alias("i"), x["s"].alias("s"), x["a"].alias("a")))
    later = lambda x: F.filter("rows", lambda y: y["i"] > x["i"])
    both = lambda x, y: F.abs(x["a"] - y["a"])
    weight = F.aggregate("rows", F.lit(0.0), lambda t, x: t + F.aggregate(later(x), F.lit(0.0), lambda u, y: u + both(x, y)))
    agreed = F.aggregate("rows", F.lit(0.0), lambda t, x: t + F.aggregate(later(x), F.lit(0.0), lambda u, y: u + F.when((x["s"] > y["s"]) == (x["a"] > y["a"]), both(x, y)).otherwise(0.0)))
    return df.groupBy(uid).agg(rows.alias("rows")).select(uid, F.when(weight == 0, F.lit(0.5)).otherwise(agreed / weight).alias("agreement"))


def sign_accuracy(df: DataFrame, score: str, accuracy: str) -> DataFrame:
    """One row: how often the sign of a score is that of 2 * accuracy - 1."""
    return df.agg(F.avg((F.signum(score) == F.signum(2 * F.col(accuracy) - 1)).cast("double")).alias("accuracy"))


def minibatches(df: DataFrame, rows: int, epochs: int, key: str, seed: int) -> DataFrame:
    """(epoch, batch and the row): every epoch in another hashed order, in batches of `rows`; rows past the last whole batch are left out."""
    from weftline.operators.batch import with_row_index

    many = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))).withColumn("_h", F.md5(F.concat_ws(":", F.lit(seed), "epoch", F.col(key).cast("string"))))
    n = df.count()
    placed = with_row_index(many, "epoch", "_h", key, row="_i").withColumn("_i", F.col("_i") - F.col("epoch") * n)
    return placed.where(F.col("_i") < n - n % rows).withColumn("batch", F.floor(F.col("_i") / rows).cast("int")).drop("_h", "_i")


def allocated_by_length(df: DataFrame, advantage: str, length: str) -> DataFrame:
    """(row, token, weight): a sequence's advantage on each of its tokens, by 1 / sqrt(length); lengths of 0 have none."""
    return df.where(F.col(length) > 0).withColumn("token", F.explode(F.sequence(F.lit(0), F.col(length).cast("int") - 1))).withColumn("weight", F.col(advantage) / F.sqrt(F.col(length)))

