"""Token-level operators over rows (group, position): folds, masks, losses and weights.

Rows of a sequence are ordered by a position column. Sums from the end are window
sums; recurrences from the end are scans over arrays, many sequences at once in an Arrow
batch, in as many passes as the longest has binary digits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from weftline.operators.advantages import with_totals


def _after(uid: str, pos: str) -> Window:
    return Window.partitionBy(uid).orderBy(F.col(pos).desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)


@F.arrow_udf(ArrayType(DoubleType()))
def _scanned(lists: pa.Array, factors: pa.Array) -> pa.Array:
    lists = lists if lists.offset == 0 else pa.concat_arrays([lists])
    ends = lists.offsets.to_numpy()
    y = np.nan_to_num(lists.values.fill_null(0.0).to_numpy(zero_copy_only=False).astype(float))
    # how many elements of its sequence follow each element, and its factor: that of its sequence, or its own
    sizes = np.diff(ends)
    rest = np.repeat(ends[1:], sizes) - np.arange(ends[0], ends[-1]) - 1
    if pa.types.is_list(factors.type):
        own = factors.offsets.to_numpy()
        power = np.array(factors.values.to_numpy(zero_copy_only=False)[own[0] : own[-1]], float)
    else:
        power = np.repeat(factors.to_numpy(zero_copy_only=False).astype(float), sizes)
    begin, step = ends[0], 1
    while step <= rest.max(initial=0):
        within = np.flatnonzero(rest >= step)
        y[begin + within] = y[begin + within] + power[within] * y[begin + within + step]
        power[within] = power[within] * power[within + step]
        step *= 2
    out = pa.ListArray.from_arrays(lists.offsets, pa.array(y))
    return pc.if_else(lists.is_valid(), out, None) if lists.null_count else out


def scanned_back(values: Column, factor: float | Column) -> Column:
    """y[i] = x[i] + factor * y[i + 1] over an array; nulls and NaN count as 0. Pass k adds what the 2^k elements from 2^k on have summed up.

    A column of factors is an array as long as the values: element i has the factor of y[i + 1].
    """
    return _scanned(values, factor if isinstance(factor, Column) else F.lit(float(factor)))


def folded_back(df: DataFrame, uid: str, pos: str, value: str, factor: float | str, out: str, *more: str) -> DataFrame:
    """(uid, pos, more, out) with the scan above over each sequence; sequences spread over tasks by key. A name is that of a column of factors."""
    own = [F.col(factor).cast("double").alias("f")] if isinstance(factor, str) else []
    steps = df.groupBy(uid).agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(value).cast("double").alias("x"), *own, *more))).alias("steps"))
    both = F.arrays_zip("steps", scanned_back(F.transform("steps", lambda s: s["x"]), F.transform("steps", lambda s: s["f"]) if own else factor).alias("y"))
    return steps.select(uid, F.explode(both).alias("s")).select(uid, F.col("s.steps.p").alias(pos), *[F.col(f"s.steps.{m}") for m in more], F.col("s.y").alias(out))


def reward_to_go(df: DataFrame, uid: str = "uid", pos: str = "pos", reward: str = "score", gamma: float = 1.0, out: str = "returns") -> DataFrame:
    """Sum of this and all later rewards, discounted by gamma a step."""
    if gamma == 1.0:
        return df.withColumn(out, F.sum(reward).over(_after(uid, pos)))
    return df.join(folded_back(df, uid, pos, reward, gamma, out), [uid, pos])


def remax(df: DataFrame, baseline: Column, uid: str = "uid", pos: str = "pos", reward: str = "score", mask: str | None = None) -> DataFrame:
    """Reward to go minus a baseline. With a mask (0 or 1) only its tokens' rewards count, and only they have the baseline taken off."""
    if mask is None:
        return reward_to_go(df, uid, pos, reward).withColumn("advantage", F.col("returns") - baseline)
    held = F.when(F.col(mask) != 0, F.col(reward)).otherwise(F.lit(0.0))
    return df.withColumn("returns", F.sum(held).over(_after(uid, pos))).withColumn("advantage", F.col("returns") - F.when(F.col(mask) != 0, baseline).otherwise(F.lit(0.0)))


def gae(
    df: DataFrame, uid: str = "uid", pos: str = "pos", reward: str = "reward", value: str = "value", gamma: float = 1.0, lam: float = 0.95,
    mask: str | None = None, whiten: bool = False,
) -> DataFrame:
    """Generalised advantages: delta + gamma lambda * next, with delta = reward + gamma * next value - value (0 after the end).

    With a mask (0 or 1) the recurrence runs over its tokens only: "next" is the next token of the mask, and a token outside it, of the
    environment or padding, has the advantage that the next one inside has, 0 if there is none. Returns are
    advantages plus values; `whiten` then whitens the advantages of all tokens by the mask's mean and variance.
    """
    if mask is None:
        after = F.coalesce(F.lead(value).over(Window.partitionBy(uid).orderBy(pos)), F.lit(0.0))
        steps = df.select(uid, pos, F.col(value).alias("v"), (F.col(reward) + gamma * after - F.col(value)).alias("delta"))
        out = folded_back(steps, uid, pos, "delta", gamma * lam, "advantage", "v").select(uid, pos, "advantage", (F.col("advantage") + F.col("v")).alias("returns"))
        return masked_whiten(out.withColumn("_one", F.lit(1.0)), "advantage", "_one", "advantage").drop("_one") if whiten else out
    # one recurrence over all tokens: one outside the mask adds nothing and hands on what the next has
    inside = F.coalesce(F.col(mask) != 0, F.lit(False))
    later = Window.partitionBy(uid).orderBy(F.col(pos).desc()).rowsBetween(Window.unboundedPreceding, -1)
    after = F.coalesce(F.last(F.when(inside, F.struct(F.col(value).alias("v"))), ignorenulls=True).over(later)["v"], F.lit(0.0))
    steps = df.select(
        uid, pos, F.col(value).alias("_value"), F.col(mask).alias("_in"), F.when(inside, gamma * lam).otherwise(1.0).alias("_factor"),
        F.when(inside, F.col(reward) + gamma * after - F.col(value)).otherwise(0.0).alias("_delta"))
    out = folded_back(steps, uid, pos, "_delta", "_factor", "advantage", "_value", "_in").withColumn("returns", F.col("advantage") + F.col("_value"))
    return (masked_whiten(out, "advantage", "_in", "advantage") if whiten else out).select(uid, pos, "advantage", "returns")


def reinforce_plus_plus(df: DataFrame, mask: str, uid: str = "uid", pos: str = "pos", reward: str = "score", gamma: float = 1.0) -> DataFrame:
    """uid, pos, returns and advantage: discounted rewards to go, which stop before each token outside the mask, whitened by the mask and 0 outside it."""
    outside = F.sum((F.col(mask) == 0).cast("int")).over(Window.partitionBy(uid).orderBy(pos).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    parts = df.select(F.struct(F.col(uid).alias("u"), outside.alias("part")).alias("_run"), pos, reward, F.col(mask).cast("double").alias("_in"))
    back = folded_back(parts, "_run", pos, reward, gamma, "returns", "_in")
    white = masked_whiten(back, "returns", "_in", "advantage")
    return white.select(F.col("_run.u").alias(uid), pos, "returns", (F.col("advantage") * F.col("_in")).alias("advantage"))


def masked_mean(value: Column, mask: Column) -> Column:
    return F.sum(F.when(mask != 0, value * mask).otherwise(F.lit(0.0))) / (F.sum(mask) + 1e-8)


def masked_whiten(df: DataFrame, value: str, mask: str, out: str = "whitened", shift_mean: bool = True) -> DataFrame:
    """(x - mean) / sqrt(var + 1e-8) by the masked mean and the Bessel-corrected masked variance."""
    total = with_totals(df, _n=F.sum(mask), _m=F.sum(F.col(value) * F.col(mask)) / F.sum(mask))
    total = with_totals(total, _v=F.sum((F.col(value) - F.col("_m")) ** 2 * F.col(mask)) / F.nullif(F.sum(mask) - 1, F.lit(0)))
    white = (F.col(value) - F.col("_m")) / F.sqrt(F.col("_v") + 1e-8)
    return total.withColumn(out, white if shift_mean else white + F.col("_m")).drop("_n", "_m", "_v")


def aggregate_loss(df: DataFrame, loss: str, mask: str, mode: str, uid: str = "uid", scale: float = 1.0) -> DataFrame:
    """One row `loss` by token-mean, seq-mean-token-sum, seq-mean-token-mean or seq-mean-token-sum-norm.
    Sequences whose mask is all 0 don't count in the means over sequences."""
    if mode == "token-mean":
        return df.agg((F.sum(F.col(loss) * F.col(mask)) / F.sum(mask)).alias("loss"))
    seq = df.groupBy(uid).agg(F.sum(F.col(loss) * F.col(mask)).alias("t"), F.sum(mask).alias("n")).where("n > 0")
    kinds = {
        "seq-mean-token-sum": F.avg("t"), "seq-mean-token-mean": F.avg(F.col("t") / F.col("n")),
        "seq-mean-token-sum-norm": F.sum("t") / F.lit(scale),
    }
    if mode not in kinds:
        raise ValueError(f"unknown mode {mode}")
    return seq.agg(kinds[mode].alias("loss"))


def kl(lp: Column, ref: Column, kind: str) -> Column:
    """Estimators of the divergence by token: k1, abs, k2 (mse) and k3 (low variance, clamped)."""
    d = lp - ref
    if kind in ("kl", "k1"):
        return d
    if kind == "abs":
        return F.abs(d)
    if kind in ("mse", "k2"):
        return 0.5 * d * d
    if kind in ("low_var_kl", "k3"):
        r = F.greatest(F.least(ref - lp, F.lit(20.0)), F.lit(-20.0))
        return F.greatest(F.least(F.exp(r) - r - 1, F.lit(10.0)), F.lit(-10.0))
    raise ValueError(f"unknown estimator {kind}")


def importance_weights(df: DataFrame, level: str = "token", threshold: float = 2.0, uid: str = "uid", lp: str = "lp", rollout: str = "old_lp", normalise: bool = False) -> DataFrame:
    """Truncated importance weights min(exp(log ratio), threshold), by token or by the sum over a sequence; log ratios are held within 20."""
    ratio = F.col(lp) - F.col(rollout)
    total = ratio if level == "token" else F.sum(ratio).over(Window.partitionBy(uid))
    held = F.greatest(F.least(total, F.lit(20.0)), F.lit(-20.0))
    out = df.withColumn("weight", F.least(F.exp(held), F.lit(threshold)))
    if normalise:
        out = with_totals(out, _mean=F.avg("weight")).withColumn("weight", F.col("weight") / F.col("_mean")).drop("_mean")
    return out


def rejection_mask(df: DataFrame, level: str = "token", upper: float = 2.0, lower: float | None = None, uid: str = "uid", lp: str = "lp", rollout: str = "old_lp") -> DataFrame:
    """1 where the ratio lies in [lower, upper] (lower: 1 / upper), of tokens, whole sequences or their geometric means."""
    lower = 1 / upper if lower is None else lower
    ratio, w = F.col(lp) - F.col(rollout), Window.partitionBy(uid)
    total = {"token": ratio, "sequence": F.sum(ratio).over(w), "geometric": F.avg(ratio).over(w)}[level]
    r = F.exp(F.greatest(F.least(total, F.lit(20.0)), F.lit(-20.0)))
    return df.withColumn("keep", ((r >= lower) & (r <= upper)).cast("int"))


def veto(df: DataFrame, threshold: float = 1e-4, uid: str = "uid", lp: str = "lp", rollout: str = "old_lp") -> DataFrame:
    """0 for all tokens of a sequence in which any log ratio lies below log(threshold)."""
    low = (F.col(lp) - F.col(rollout) < F.log(F.lit(threshold))).cast("int")
    return df.withColumn("keep", 1 - F.max(low).over(Window.partitionBy(uid)))


def off_policy_metrics(df: DataFrame, uid: str = "uid", lp: str = "lp", rollout: str = "old_lp") -> DataFrame:
    """One row: perplexities of both policies, KL, k3, chi-squared by token and by sequence, and the log-ppl difference."""
    seq = df.groupBy(uid).agg(F.avg(lp).alias("a"), F.avg(rollout).alias("b"), F.sum(F.col(lp) - F.col(rollout)).alias("d"))
    ratio = F.col(lp) - F.col(rollout)
    token = df.agg(
        F.avg(-ratio).alias("kl"), F.avg(F.exp(ratio) - ratio - 1).alias("k3_kl"), (F.avg(F.exp(2 * ratio)) - 1).alias("chi2_token")
    )
    held = F.greatest(F.least(F.col("d"), F.lit(20.0)), F.lit(-20.0))
    sequence = seq.agg(
        F.avg(F.exp(-F.col("a"))).alias("training_ppl"), F.avg(F.exp(-F.col("b"))).alias("rollout_ppl"),
        F.avg(F.col("b") - F.col("a")).alias("log_ppl_diff"), F.avg(F.exp(F.col("b") - F.col("a"))).alias("ppl_ratio"),
        (F.avg(F.exp(2 * held)) - 1).alias("chi2_seq"),
    )
    return token.crossJoin(F.broadcast(sequence))


def weight_metrics(df: DataFrame, weight: str = "weight", upper: float = 2.0) -> DataFrame:
    """One row: mean, least, greatest, deviation, shares over the bounds, and the effective sample size 1 / mean((w / mean)^2)."""
    total = with_totals(df.select(weight), _mean=F.avg(weight))
    return total.agg(
        F.avg(weight).alias("mean"), F.min(weight).alias("least"), F.max(weight).alias("greatest"), F.stddev_samp(weight).alias("std"),
        F.avg((F.col(weight) >= upper).cast("double")).alias("share_high"), F.avg((F.col(weight) <= 1 / upper).cast("double")).alias("share_low"),
        (1 / F.avg((F.col(weight) / F.col("_mean")) ** 2)).alias("ess"),
    )


def length_allocation(df: DataFrame, kind: str = "sqrt", advantage: str = "advantage", length: str = "length") -> DataFrame:
    """A sequence's advantage for each of its tokens: as it is, by 1/sqrt(length), or by sqrt(mean length / length)."""
    if kind == "none":
        return df.withColumn("allocated", F.col(advantage))
    if kind == "sqrt":
        return df.withColumn("allocated", F.col(advantage) / F.sqrt(F.greatest(F.col(length), F.lit(1.0))))
    if kind == "norm":
        total = with_totals(df, _ref=F.avg(length))
        return total.withColumn("allocated", F.col(advantage) * F.sqrt(F.col("_ref") / F.greatest(F.col(length), F.lit(1.0)))).drop("_ref")
    raise ValueError(f"unknown kind {kind}")


def turn_discount(df: DataFrame, alpha: float = 0.9, uid: str = "uid", pos: str = "pos") -> DataFrame:
    """Token weights alpha^(last - pos) that average 1 within a sequence."""
    w = Window.partitionBy(uid)
    raw = F.pow(F.lit(alpha), F.max(pos).over(w) - F.col(pos))
    return df.withColumn("_raw", raw).withColumn("weight", F.col("_raw") / F.avg("_raw").over(w)).drop("_raw")


def policy_loss(df: DataFrame, kind: str = "clip", low: float = 0.2, high: float = 0.2, dual: float = 3.0, uid: str = "uid", lp: str = "lp", old: str = "old_lp", advantage: str = "advantage") -> DataFrame:
    """Forward values of policy losses by token: clip (dual-clipped ratio), gspo (sequence ratio), gpg, geo_mean (sequence)."""
    a, d = F.col(advantage), F.greatest(F.least(F.col(lp) - F.col(old), F.lit(20.0)), F.lit(-20.0))
    w = Window.partitionBy(uid)
    if kind == "gpg":
        return df.withColumn("loss", -F.col(lp) * a)
    if kind == "geo_mean":
        sign = F.signum(a)
        held = sign * F.least(sign * d, F.lit(high))
        return df.withColumn("loss", -a * F.exp(F.avg(held).over(w)))
    ratio = F.exp(d) if kind == "clip" else F.exp(F.least(F.avg(d).over(w), F.lit(10.0)))
    plain = F.greatest(-a * ratio, -a * F.greatest(F.least(ratio, F.lit(1 + high)), F.lit(1 - low)))
    if kind == "clip":
        plain = F.when(a < 0, F.least(plain, -a * dual)).otherwise(plain)
    return df.withColumn("loss", plain)


def value_loss(value: Column, returns: Column, old: Column, clip: float) -> Column:
    """Half of the larger squared error of the value and the value clipped around the old one."""
    held = F.greatest(F.least(value, old + clip), old - clip)
    return 0.5 * F.greatest((value - returns) ** 2, (held - returns) ** 2)


def penalised_rewards(df: DataFrame, score: Column, beta: float, kind: str = "kl", uid: str = "uid", pos: str = "pos", lp: str = "lp", ref: str = "ref_lp") -> DataFrame:
    """Token rewards: the score on a sequence's last token, less beta times the divergence on every token."""
    last = F.col(pos) == F.max(pos).over(Window.partitionBy(uid))
    return df.withColumn("reward", F.when(last, score).otherwise(F.lit(0.0)) - beta * kl(F.col(lp), F.col(ref), kind))


def probability_differences(df: DataFrame, lp: str = "lp", old: str = "old_lp") -> DataFrame:
    """One row: correlation of two policies' token probabilities, and the largest, mean and deviation of their difference."""
    p, q = F.exp(lp), F.exp(old)
    gap = F.abs(p - q)
    return df.agg(F.corr(p, q).alias("pearson"), F.max(gap).alias("max_diff"), F.avg(gap).alias("mean_diff"), F.stddev_samp(gap).alias("std_diff"))


def sequence_logprobs(df: DataFrame, keep: Column, uid: str = "uid", lp: str = "lp") -> DataFrame:
    """Sum and mean of a sequence's log-probabilities over the tokens that count; 0 and null where none does."""
    own = F.when(keep, F.col(lp))
    return df.groupBy(uid).agg(F.coalesce(F.sum(own), F.lit(0.0)).alias("total"), F.avg(own).alias("mean"))


def softmax_entropy(df: DataFrame, x: str, uid: str = "uid") -> DataFrame:
    """The entropy of the softmax over a group's values, with the largest taken out first."""
    w = Window.partitionBy(uid)
    z = df.withColumn("_z", F.col(x) - F.max(x).over(w)).withColumn("_p", F.exp("_z") / F.sum(F.exp("_z")).over(w))
    return z.groupBy(uid).agg((-F.sum(F.when(F.col("_p") > 0, F.col("_p") * F.log("_p")).otherwise(0.0))).alias("entropy"))
