"""Queries and checking SQL of the group-relative and token-level operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import advantages as adv
from weftline.operators import batch
from weftline.operators import sequences as seq
from weftline.plans.samples import SAMPLES_SQL, rounded, samples

KEY = ("uid", "pos")


def _advantage(estimator: str, **options):
    def query(spark, sf_dir):
        out = adv.ESTIMATORS[estimator](samples(spark, sf_dir), **options)
        return rounded(out, "advantage").select(*KEY, "advantage")

    return query


def _sql(expression: str, more: str = "", source: str = "s") -> str:
    return f"WITH {SAMPLES_SQL}{', ' + more if more else ''} SELECT uid, pos, round({expression}, 6) + 0.0 AS advantage FROM {source} WINDOW w AS (PARTITION BY uid)"


_N = "count(*) OVER w"
_M = f"CASE WHEN {_N} = 1 THEN 0 ELSE avg(score) OVER w END"
_STRATA = """
t AS (
  SELECT *, count(*) OVER a AS sn, avg(score) OVER a AS sm, stddev_pop(score) OVER a AS sd,
         count(*) OVER c AS cn, avg(score) OVER c AS cm, stddev_pop(score) OVER c AS cd,
         count(*) OVER g AS gn, avg(score) OVER g AS gm, stddev_pop(score) OVER g AS gd
  FROM s WINDOW a AS (PARTITION BY uid, level, scenario), c AS (PARTITION BY uid, scenario), g AS (PARTITION BY uid)),
z AS (
  SELECT *, score - sm AS es, score - cm AS ec, score - gm AS eg, greatest(sd, 1e-6) AS fs, greatest(cd, 1e-6) AS fc, greatest(gd, 1e-6) AS fg FROM t)"""
_STRATIFIED = """CASE WHEN sn >= 3 THEN es / fs WHEN sn = 2 THEN es WHEN cn >= 3 THEN ec / fc WHEN cn = 2 THEN ec WHEN gn >= 3 THEN eg / fg ELSE eg END
  + 0.25 * CASE WHEN gn >= 2 THEN eg / fg ELSE 0 END"""


def stratified_saturated(spark, sf_dir):
    df = samples(spark, sf_dir).withColumn("score", (F.col("score") > 20000).cast("double"))
    return rounded(adv.zero_saturated(adv.stratified(df)), "advantage").select(*KEY, "advantage")


def saturation_groups(spark, sf_dir):
    df = samples(spark, sf_dir).withColumns({"r": (F.col("score") > 30000).cast("double"), "c": (F.col("level") == "R").cast("double")})
    g = df.groupBy("uid").agg(
        F.stddev_pop("r").alias("reward_std"), F.stddev_pop("c").alias("cost_std"),
        F.min((F.col("r") > 0.5).cast("int")).alias("all_success"), F.min((F.col("r") <= 0.5).cast("int")).alias("all_failure"),
        F.min((F.col("c") == 0).cast("int")).alias("all_safe"), F.min((F.col("c") > 0).cast("int")).alias("all_unsafe"),
        F.max(((F.col("r") > 0.5) & (F.col("c") > 0)).cast("int")).alias("unsafe_success"),
    )
    return rounded(g, "reward_std", "cost_std").withColumn("mixed_safety", 1 - F.greatest("all_safe", "all_unsafe"))


_SATURATION = f"""WITH {SAMPLES_SQL}, d AS (SELECT uid, (score > 30000)::DOUBLE AS r, (level = 'R')::DOUBLE AS c FROM s),
g AS (SELECT uid, round(stddev_pop(r), 6) + 0.0 AS reward_std, round(stddev_pop(c), 6) + 0.0 AS cost_std,
  min((r > 0.5)::INT) AS all_success, min((r <= 0.5)::INT) AS all_failure, min((c = 0)::INT) AS all_safe,
  min((c > 0)::INT) AS all_unsafe, max((r > 0.5 AND c > 0)::INT) AS unsafe_success FROM d GROUP BY uid)
SELECT *, 1 - greatest(all_safe, all_unsafe) AS mixed_safety FROM g"""


def saturation_summary(spark, sf_dir):
    g = saturation_groups(spark, sf_dir).withColumn("saturated", (F.col("reward_std") < 1e-6).cast("double"))
    return rounded(
        g.agg(
            F.count(F.lit(1)).alias("groups"), F.avg("saturated").alias("saturation_rate"), F.avg("all_success").alias("all_success_rate"),
            F.avg("all_failure").alias("all_failure_rate"), F.avg("mixed_safety").alias("mixed_safety_rate"), F.avg("unsafe_success").alias("unsafe_success_rate"),
            F.coalesce(F.avg(F.when(F.col("saturated") == 1, F.col("unsafe_success"))), F.lit(0.0)).alias("unsafe_in_saturated"),
        ), "saturation_rate", "all_success_rate", "all_failure_rate", "mixed_safety_rate", "unsafe_success_rate", "unsafe_in_saturated")


def dapo_filter(spark, sf_dir):
    """Groups whose rewards vary, and single rows, stay."""
    df = samples(spark, sf_dir).withColumn("r", (F.col("score") > 30000).cast("double"))
    kept = df.groupBy("uid").agg(F.stddev_pop("r").alias("d"), F.count(F.lit(1)).alias("n")).where("d > 0 or n = 1")
    return kept.select("uid", "n")


def prime_filter(spark, sf_dir):
    """Groups with a mean accuracy within bounds and all lengths below a limit come first; half of the groups are kept."""
    df = samples(spark, sf_dir).withColumn("acc", (F.col("score") > 30000).cast("double"))
    g = df.groupBy("uid").agg(F.avg("acc").alias("acc"), F.max("length").alias("longest"))
    g = g.withColumn("passes", (F.col("acc").between(0.2, 0.8) & (F.col("longest") < 48)).cast("int"))
    ranked = batch.with_row_index(g, F.desc("passes"), "uid")
    return rounded(ranked.where(F.col("row_idx") < ranked.count() // 2), "acc").select("uid", "acc", "passes")


def _plain(f, columns, digits=6):
    def query(spark, sf_dir):
        return rounded(f(samples(spark, sf_dir)), *columns, digits=digits)

    return query


def _tokens(df):
    return df.withColumn("mask", (F.col("length") > 10).cast("double")).withColumn("x", F.col("score") / 1000)


def _gaps(df):
    """A mask with gaps at the start, in the middle and at the end; what lies outside it has large rewards and values, which mustn't matter where they don't count."""
    inside = ((F.col("pos") * 7 + F.col("uid")) % 5 > 1).cast("double")
    far = F.when(inside == 0, F.lit(50.0)).otherwise(F.lit(0.0))
    return df.withColumn("m", inside).withColumn("r", F.sqrt("score") / 100 + far).withColumn("v", F.sqrt("length") / 10 - far)


def _losses(spark, sf_dir):
    df = _tokens(samples(spark, sf_dir))
    modes = ("token-mean", "seq-mean-token-sum", "seq-mean-token-mean", "seq-mean-token-sum-norm")
    out = None
    for m in modes:
        one = seq.aggregate_loss(df, "x", "mask", m, scale=100.0).select(F.lit(m).alias("mode"), "loss")
        out = one if out is None else out.union(one)
    return rounded(out, "loss")


def _kls(df):
    kinds = {"k1": "kl", "k_abs": "abs", "k2": "mse", "k3": "low_var_kl"}
    return df.select(*KEY, *[seq.kl(F.col("lp"), F.col("ref_lp"), k).alias(n) for n, k in kinds.items()])


def _losses_by_token(df):
    df = adv.grpo(df)
    names = {"clip": "l_clip", "gspo": "l_gspo", "gpg": "l_gpg", "geo_mean": "l_geo"}
    for k, n in names.items():
        df = seq.policy_loss(df, k).withColumnRenamed("loss", n)
    return df.select(*KEY, *names.values())


def _gae(df):
    return seq.gae(df.select("uid", "pos", (F.sqrt("score") / 100).alias("reward"), (F.sqrt("length") / 10).alias("value")), gamma=0.99, lam=0.95)


QUERIES = {
    "grpo_advantage": _advantage("grpo"),
    "dr_grpo_advantage": _advantage("grpo", by_std=False),
    "grpo_vectorized": _advantage("grpo_floored"),
    "passk_advantage": _advantage("pass_at_k"),
    "rloo_advantage": _advantage("rloo"),
    "rloo_vectorized": _advantage("rloo", single="zero"),
    "opo_advantage": lambda s, d: rounded(adv.opo(samples(s, d).withColumn("score", F.sqrt("score"))), "advantage").select(*KEY, "advantage"),
    "gpg_advantage": _advantage("gpg"),
    "rfpp_baseline": _advantage("reinforce_baseline"),
    "batch_zscore": _advantage("batch_zscore"),
    "stratified_advantage": _advantage("stratified"),
    "stratified_saturated": stratified_saturated,
    "sppo_advantage": lambda s, d: rounded(adv.softmean_advantage(samples(s, d), beta=0.001), "advantage", digits=4).select(*KEY, "advantage"),
    "scalar_group_advantage": lambda s, d: rounded(adv.scalar_group_advantage(samples(s, d)), "advantage").select(*KEY, "advantage", "saturated"),
    "saturation_groups": saturation_groups,
    "saturation_summary": saturation_summary,
    "dapo_filter_groups": dapo_filter,
    "prime_filter": prime_filter,
    "token_returns": _plain(lambda df: seq.reward_to_go(df).select(*KEY, "returns"), ["returns"], 4),
    "token_returns_discounted": _plain(lambda df: seq.reward_to_go(df.withColumn("score", F.sqrt("score")), gamma=0.9).select(*KEY, "returns"), ["returns"]),
    "remax_returns": _plain(lambda df: seq.remax(df, F.col("length") * 100).select(*KEY, "advantage"), ["advantage"], 4),
    "gae": _plain(_gae, ["advantage", "returns"]),
    "gae_masked": _plain(lambda df: seq.gae(_gaps(df), reward="r", value="v", gamma=0.99, lam=0.95, mask="m", whiten=True), ["advantage", "returns"]),
    "reinforce_plus_plus": _plain(lambda df: seq.reinforce_plus_plus(_gaps(df), "m", reward="r", gamma=0.9), ["advantage", "returns"]),
    "remax_masked": _plain(lambda df: seq.remax(_gaps(df), F.col("v") * 3, reward="r", mask="m").select(*KEY, "advantage"), ["advantage"]),
    "masked_whiten": _plain(lambda df: seq.masked_whiten(_tokens(df), "x", "mask").select(*KEY, "whitened"), ["whitened"]),
    "agg_loss_modes": _losses,
    "kl_k1_k2_k3": _plain(_kls, ["k1", "k_abs", "k2", "k3"]),
    "is_weights_token": _plain(lambda df: seq.importance_weights(df).select(*KEY, "weight"), ["weight"]),
    "is_weights_sequence": _plain(lambda df: seq.importance_weights(df, "sequence").select(*KEY, "weight"), ["weight"]),
    "is_weight_metrics": _plain(lambda df: seq.weight_metrics(seq.importance_weights(df)), ["mean", "least", "greatest", "std", "share_high", "share_low", "ess"]),
    "rs_mask_token": lambda s, d: seq.rejection_mask(samples(s, d)).select(*KEY, "keep"),
    "rs_mask_geometric": lambda s, d: seq.rejection_mask(samples(s, d), "geometric", 1.05).select(*KEY, "keep"),
    "veto": lambda s, d: seq.veto(samples(s, d), 0.5).select(*KEY, "keep"),
    "offpolicy_metrics": _plain(seq.off_policy_metrics, ["kl", "k3_kl", "chi2_token", "training_ppl", "rollout_ppl", "log_ppl_diff", "ppl_ratio", "chi2_seq"]),
    "lata_sqrt": _plain(lambda df: seq.length_allocation(adv.grpo(df), "sqrt").select(*KEY, "allocated"), ["allocated"]),
    "lata_norm": _plain(lambda df: seq.length_allocation(adv.grpo(df), "norm").select(*KEY, "allocated"), ["allocated"]),
    "turn_discount": _plain(lambda df: seq.turn_discount(df).select(*KEY, "weight"), ["weight"]),
    "policy_losses": _plain(_losses_by_token, ["l_clip", "l_gspo", "l_gpg", "l_geo"], 5),
    "value_loss": _plain(lambda df: df.select(*KEY, seq.value_loss(F.col("score") / 1e4, F.col("length") / 10, F.col("lp"), F.lit(0.2)).alias("loss")), ["loss"]),
}

_GRPO = f"CASE WHEN {_N} = 1 THEN score ELSE score - avg(score) OVER w END / (CASE WHEN {_N} = 1 THEN 1 ELSE stddev_samp(score) OVER w END + 1e-6)"
_TOK = "tok AS (SELECT *, (length > 10)::DOUBLE AS mask, score / 1000 AS x FROM s)"
_CLAMP = "greatest(least({}, 20), -20)"
_ADV = f"a AS (SELECT *, {_GRPO} AS adv, {_CLAMP.format('lp - old_lp')} AS d FROM s WINDOW w AS (PARTITION BY uid))"

_GAPS = f"{SAMPLES_SQL}, i AS (SELECT *, ((pos * 7 + uid) % 5 > 1)::INT::DOUBLE AS m FROM s), g AS (SELECT uid, pos, m, sqrt(score) / 100 + CASE WHEN m = 0 THEN 50 ELSE 0 END AS r, sqrt(length) / 10 - CASE WHEN m = 0 THEN 50 ELSE 0 END AS v FROM i)"

ORACLE_SQL = {
    "grpo_advantage": _sql(_GRPO),
    "dr_grpo_advantage": _sql(f"CASE WHEN {_N} = 1 THEN score ELSE score - avg(score) OVER w END"),
    "grpo_vectorized": _sql(f"CASE WHEN {_N} = 1 THEN score ELSE score - avg(score) OVER w END / (CASE WHEN {_N} = 1 THEN 1 ELSE sqrt(greatest(var_samp(score) OVER w, 1e-6)) END + 1e-6)"),
    "passk_advantage": f"""WITH {SAMPLES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, pos) AS k FROM s)
      SELECT uid, pos, CASE WHEN {_N} > 1 THEN round(CASE WHEN k = 1 THEN score - max(CASE WHEN k = 2 THEN score END) OVER w ELSE 0 END / (stddev_samp(score) OVER w + 1e-6), 6) + 0.0 END AS advantage
      FROM r WINDOW w AS (PARTITION BY uid)""",
    "rloo_advantage": _sql(f"CASE WHEN {_N} = 1 THEN score ELSE (score - avg(score) OVER w) * {_N} / nullif({_N} - 1, 0) END"),
    "rloo_vectorized": _sql(f"CASE WHEN {_N} = 1 THEN 0 ELSE (score - avg(score) OVER w) * {_N} / nullif({_N} - 1, 0) END"),
    "opo_advantage": _sql(f"CASE WHEN {_N} = 1 THEN sqrt(score) ELSE sqrt(score) - sum(sqrt(score) * length) OVER w / sum(length) OVER w END"),
    "gpg_advantage": _sql(f"(SELECT count(*) / count(nullif(score, 0)) FROM s) * (score - {_M})"),
    "rfpp_baseline": f"WITH {SAMPLES_SQL}, c AS (SELECT *, score - {_M} AS c FROM s WINDOW w AS (PARTITION BY uid)) SELECT uid, pos, round((c - avg(c) OVER ()) / sqrt(var_samp(c) OVER () + 1e-8), 6) + 0.0 AS advantage FROM c",
    "batch_zscore": f"WITH {SAMPLES_SQL} SELECT uid, pos, round((score - avg(score) OVER ()) / stddev_pop(score) OVER (), 6) + 0.0 AS advantage FROM s",
    "stratified_advantage": _sql(_STRATIFIED, _STRATA, "z"),
    "stratified_saturated": f"WITH {SAMPLES_SQL.replace('l_extendedprice AS score', '(l_extendedprice > 20000)::DOUBLE AS score')}, {_STRATA} SELECT uid, pos, round(CASE WHEN gd < 0.01 THEN 0 ELSE {_STRATIFIED} END, 6) + 0.0 AS advantage FROM z",
    "sppo_advantage": f"""WITH {SAMPLES_SQL}, t AS (SELECT *, max(0.001 * score) OVER (PARTITION BY uid) AS top FROM s)
      SELECT uid, pos, round(score - (top + ln(avg(exp(0.001 * score - top)) OVER (PARTITION BY uid))) / 0.001, 4) + 0.0 AS advantage FROM t""",
    "scalar_group_advantage": f"WITH {SAMPLES_SQL} SELECT uid, pos, stddev_pop(score) OVER w < 1e-6 AS saturated, round(CASE WHEN stddev_pop(score) OVER w < 1e-6 THEN 0 ELSE (score - avg(score) OVER w) / stddev_pop(score) OVER w END, 6) + 0.0 AS advantage FROM s WINDOW w AS (PARTITION BY uid)",
    "saturation_groups": _SATURATION,
    "saturation_summary": f"""WITH q AS ({_SATURATION}), g AS (SELECT *, (reward_std < 1e-6)::DOUBLE AS saturated FROM q)
      SELECT count(*) AS groups, round(avg(saturated), 6) + 0.0 AS saturation_rate, round(avg(all_success), 6) + 0.0 AS all_success_rate, round(avg(all_failure), 6) + 0.0 AS all_failure_rate,
        round(avg(mixed_safety), 6) + 0.0 AS mixed_safety_rate, round(avg(unsafe_success), 6) + 0.0 AS unsafe_success_rate,
        round(coalesce(avg(CASE WHEN saturated = 1 THEN unsafe_success END), 0), 6) + 0.0 AS unsafe_in_saturated FROM g""",
    "dapo_filter_groups": f"WITH {SAMPLES_SQL} SELECT uid, count(*) AS n FROM s GROUP BY uid HAVING stddev_pop((score > 30000)::DOUBLE) > 0 OR count(*) = 1",
    "prime_filter": f"""WITH {SAMPLES_SQL}, g AS (SELECT uid, avg((score > 30000)::DOUBLE) AS acc, max(length) AS longest FROM s GROUP BY uid),
      p AS (SELECT *, (acc BETWEEN 0.2 AND 0.8 AND longest < 48)::INT AS passes FROM g)
      SELECT uid, round(acc, 6) + 0.0 AS acc, passes FROM p ORDER BY passes DESC, uid LIMIT (SELECT count(*) // 2 FROM p)""",
    "token_returns": f"WITH {SAMPLES_SQL} SELECT uid, pos, round(sum(score) OVER (PARTITION BY uid ORDER BY pos DESC), 4) + 0.0 AS returns FROM s",
    "token_returns_discounted": f"WITH {SAMPLES_SQL} SELECT a.uid, a.pos, round(sum(sqrt(b.score) * pow(0.9::DOUBLE, b.pos - a.pos)), 6) + 0.0 AS returns FROM s a JOIN s b ON a.uid = b.uid AND b.pos >= a.pos GROUP BY a.uid, a.pos",
    "remax_returns": f"WITH {SAMPLES_SQL} SELECT uid, pos, round(sum(score) OVER (PARTITION BY uid ORDER BY pos DESC) - length * 100, 4) + 0.0 AS advantage FROM s",
    "gae": f"""WITH {SAMPLES_SQL}, v AS (SELECT uid, pos, sqrt(score) / 100 AS r, sqrt(length) / 10 AS v, coalesce(lead(sqrt(length) / 10) OVER (PARTITION BY uid ORDER BY pos), 0) AS nv FROM s),
      d AS (SELECT *, r + 0.99::DOUBLE * nv - v AS d FROM v)
      SELECT a.uid, a.pos, round(sum(b.d * pow(0.9405::DOUBLE, b.pos - a.pos)), 6) + 0.0 AS advantage, round(sum(b.d * pow(0.9405::DOUBLE, b.pos - a.pos)) + any_value(a.v), 6) + 0.0 AS returns
      FROM d a JOIN d b ON a.uid = b.uid AND b.pos >= a.pos GROUP BY a.uid, a.pos""",
    "gae_masked": f"""WITH {_GAPS}, k AS (SELECT *, lead(v, 1, 0) OVER (PARTITION BY uid ORDER BY pos) AS nv, row_number() OVER (PARTITION BY uid ORDER BY pos) AS k FROM g WHERE m = 1),
      a AS (SELECT x.uid, x.pos, sum((y.r + 0.99::DOUBLE * y.nv - y.v) * pow(0.9405::DOUBLE, y.k - x.k)) AS a FROM k x JOIN k y ON x.uid = y.uid AND y.k >= x.k GROUP BY x.uid, x.pos),
      b AS (SELECT g.uid, g.pos, g.v, g.m, coalesce((SELECT arg_min(a.a, a.pos) FROM a WHERE a.uid = g.uid AND a.pos >= g.pos), 0) AS a FROM g),
      t AS (SELECT sum(a * m) / sum(m) AS mean, sum(m) AS n FROM b), u AS (SELECT sum((a - mean) * (a - mean) * m) / (any_value(n) - 1) AS var FROM b, t)
      SELECT uid, pos, round((a - mean) / sqrt(var + 1e-8), 6) + 0.0 AS advantage, round(a + v, 6) + 0.0 AS returns FROM b, t, u""",
    "reinforce_plus_plus": f"""WITH {_GAPS}, p AS (SELECT *, sum((m = 0)::INT) OVER (PARTITION BY uid ORDER BY pos) AS part FROM g),
      a AS (SELECT x.uid, x.pos, any_value(x.m) AS m, sum(y.r * pow(0.9::DOUBLE, y.pos - x.pos)) AS a FROM p x JOIN p y ON x.uid = y.uid AND x.part = y.part AND y.pos >= x.pos GROUP BY x.uid, x.pos),
      t AS (SELECT sum(a * m) / sum(m) AS mean, sum(m) AS n FROM a), u AS (SELECT sum((a - mean) * (a - mean) * m) / (any_value(n) - 1) AS var FROM a, t)
      SELECT uid, pos, round((a - mean) / sqrt(var + 1e-8) * m, 6) + 0.0 AS advantage, round(a, 6) + 0.0 AS returns FROM a, t, u""",
    "remax_masked": f"WITH {_GAPS} SELECT uid, pos, round(sum(r * m) OVER (PARTITION BY uid ORDER BY pos DESC) - 3 * v * m, 6) + 0.0 AS advantage FROM g",
    "masked_whiten": f"""WITH {SAMPLES_SQL}, {_TOK}, m AS (SELECT sum(x * mask) / sum(mask) AS m, sum(mask) AS n FROM tok),
      q AS (SELECT sum((x - m) * (x - m) * mask) / (any_value(n) - 1) AS v FROM tok, m)
      SELECT uid, pos, round((x - m) / sqrt(v + 1e-8), 6) + 0.0 AS whitened FROM tok, m, q""",
    "agg_loss_modes": f"""WITH {SAMPLES_SQL}, {_TOK}, q AS (SELECT sum(x * mask) AS t, sum(mask) AS n FROM tok GROUP BY uid HAVING sum(mask) > 0)
      SELECT 'token-mean' AS mode, round(sum(x * mask) / sum(mask), 6) + 0.0 AS loss FROM tok
      UNION ALL SELECT 'seq-mean-token-sum', round(avg(t), 6) FROM q UNION ALL SELECT 'seq-mean-token-mean', round(avg(t / n), 6) FROM q
      UNION ALL SELECT 'seq-mean-token-sum-norm', round(sum(t) / 100, 6) FROM q""",
    "kl_k1_k2_k3": f"""WITH {SAMPLES_SQL} SELECT uid, pos, round(lp - ref_lp, 6) + 0.0 AS k1, round(abs(lp - ref_lp), 6) + 0.0 AS k_abs, round(0.5::DOUBLE * (lp - ref_lp) * (lp - ref_lp), 6) + 0.0 AS k2,
      round(greatest(least(exp({_CLAMP.format('ref_lp - lp')}) - {_CLAMP.format('ref_lp - lp')} - 1, 10), -10), 6) + 0.0 AS k3 FROM s""",
    "is_weights_token": f"WITH {SAMPLES_SQL} SELECT uid, pos, round(least(exp({_CLAMP.format('lp - old_lp')}), 2), 6) + 0.0 AS weight FROM s",
    "is_weights_sequence": f"WITH {SAMPLES_SQL} SELECT uid, pos, round(least(exp({_CLAMP.format('sum(lp - old_lp) OVER (PARTITION BY uid)')}), 2), 6) + 0.0 AS weight FROM s",
    "is_weight_metrics": f"""WITH {SAMPLES_SQL}, w AS (SELECT least(exp({_CLAMP.format('lp - old_lp')}), 2) AS w FROM s), m AS (SELECT avg(w) AS m FROM w)
      SELECT round(avg(w), 6) AS mean, round(min(w), 6) AS least, round(max(w), 6) AS greatest, round(stddev_samp(w), 6) AS std, round(avg((w >= 2)::DOUBLE), 6) AS share_high,
        round(avg((w <= 0.5)::DOUBLE), 6) AS share_low, round(1 / avg((w / m) * (w / m)), 6) AS ess FROM w, m""",
    "rs_mask_token": f"WITH {SAMPLES_SQL} SELECT uid, pos, (exp({_CLAMP.format('lp - old_lp')}) BETWEEN 0.5 AND 2)::INT AS keep FROM s",
    "rs_mask_geometric": f"WITH {SAMPLES_SQL} SELECT uid, pos, (exp({_CLAMP.format('avg(lp - old_lp) OVER (PARTITION BY uid)')}) BETWEEN 1 / 1.05::DOUBLE AND 1.05::DOUBLE)::INT AS keep FROM s",
    "veto": f"WITH {SAMPLES_SQL} SELECT uid, pos, 1 - max((lp - old_lp < ln(0.5::DOUBLE))::INT) OVER (PARTITION BY uid) AS keep FROM s",
    "offpolicy_metrics": f"""WITH {SAMPLES_SQL}, q AS (SELECT avg(lp) AS a, avg(old_lp) AS b, {_CLAMP.format('sum(lp - old_lp)')} AS d FROM s GROUP BY uid),
      t AS (SELECT avg(old_lp - lp) AS kl, avg(exp(lp - old_lp) - (lp - old_lp) - 1) AS k3_kl, avg(exp(2 * (lp - old_lp))) - 1 AS chi2_token FROM s)
      SELECT round(any_value(kl), 6) + 0.0 AS kl, round(any_value(k3_kl), 6) + 0.0 AS k3_kl, round(any_value(chi2_token), 6) + 0.0 AS chi2_token, round(avg(exp(-a)), 6) AS training_ppl,
        round(avg(exp(-b)), 6) AS rollout_ppl, round(avg(b - a), 6) + 0.0 AS log_ppl_diff, round(avg(exp(b - a)), 6) AS ppl_ratio, round(avg(exp(2 * d)) - 1, 6) + 0.0 AS chi2_seq FROM q, t""",
    "lata_sqrt": f"WITH {SAMPLES_SQL}, {_ADV} SELECT uid, pos, round(adv / sqrt(greatest(length, 1)), 6) + 0.0 AS allocated FROM a",
    "lata_norm": f"WITH {SAMPLES_SQL}, {_ADV} SELECT uid, pos, round(adv * sqrt((SELECT avg(length) FROM s) / greatest(length, 1)), 6) + 0.0 AS allocated FROM a",
    "turn_discount": f"""WITH {SAMPLES_SQL}, r AS (SELECT uid, pos, pow(0.9::DOUBLE, max(pos) OVER (PARTITION BY uid) - pos) AS raw FROM s)
      SELECT uid, pos, round(raw / avg(raw) OVER (PARTITION BY uid), 6) AS weight FROM r""",
    "policy_losses": f"""WITH {SAMPLES_SQL}, {_ADV}, r AS (SELECT *, exp(d) AS ratio, exp(least(avg(d) OVER (PARTITION BY uid), 10)) AS sr,
        exp(avg(sign(adv) * least(sign(adv) * d, 0.2::DOUBLE)) OVER (PARTITION BY uid)) AS gr FROM a),
      p AS (SELECT *, greatest(-adv * ratio, -adv * greatest(least(ratio, 1.2::DOUBLE), 0.8::DOUBLE)) AS c, greatest(-adv * sr, -adv * greatest(least(sr, 1.2::DOUBLE), 0.8::DOUBLE)) AS g FROM r)
      SELECT uid, pos, round(CASE WHEN adv < 0 THEN least(c, -adv * 3) ELSE c END, 5) + 0.0 AS l_clip, round(g, 5) + 0.0 AS l_gspo, round(-lp * adv, 5) + 0.0 AS l_gpg, round(-adv * gr, 5) + 0.0 AS l_geo FROM p""",
    "value_loss": f"""WITH {SAMPLES_SQL}, v AS (SELECT uid, pos, score / 1e4 AS v, length / 10 AS r, lp AS o FROM s), c AS (SELECT *, greatest(least(v, o + 0.2::DOUBLE), o - 0.2::DOUBLE) AS h FROM v)
      SELECT uid, pos, round(0.5::DOUBLE * greatest((v - r) * (v - r), (h - r) * (h - r)), 6) + 0.0 AS loss FROM c""",
}
