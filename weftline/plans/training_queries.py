"""Queries and checking SQL of sampling, controllers, rewards and reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.functions import answers
from weftline.operators import advantages as adv
from weftline.operators import balance, metrics, relational, retrieval, sampling, trajectories
from weftline.operators import sequences as seq
from weftline.plans.samples import SAMPLES_SQL, rounded, samples, table

_WEIGHTS = {"banking": 3.0, "calendar": 1.0, "email": 2.0}


def mix_draw(s, d):
    return table(s, d, "orders").select("o_orderkey", sampling.mix_draw(F.col("o_orderkey"), _WEIGHTS, 7).alias("domain"))


def pf_weights(s, d):
    df = samples(s, d).select("uid", "pos", (F.col("score") / 1e4).alias("score"))
    a = sampling.reweighted(df, "score", "pow", 2.0).withColumnRenamed("weight", "w_pow")
    b = sampling.reweighted(a, "score", "max_min").withColumnRenamed("weight", "w_max_min")
    return rounded(sampling.reweighted(b, "score", "max_random").withColumnRenamed("weight", "w_max_random"), "w_pow", digits=6).drop("score")


def pf_resample(s, d):
    df = sampling.reweighted(samples(s, d).withColumn("score", F.sqrt("score")), "score", "pow", 1.0)
    return sampling.resampled(df, "weight", "pos", 4, 3, "uid").groupBy("uid").agg(F.count(F.lit(1)).alias("rows"), F.min("pos").alias("first"))


def kl_cov_tokens(s, d):
    return rounded(sampling.covariance_tokens(adv.grpo(samples(s, d)), 0.002, ["uid", "pos"]).select("uid", "pos", "cov"), "cov")


def online_preference(s, d):
    return sampling.preferred(samples(s, d), "uid", "score", "pos").select("uid", "pos", "pair", "chosen")


def adaptive_kl(s, d):
    daily = table(s, d, "events").groupBy(F.to_date("ts").alias("day")).agg((F.avg("value") / 8).alias("kl"), F.count(F.lit(1)).alias("steps"))
    return rounded(sampling.adaptive_controller(daily, "day", "kl", "steps").select(F.col("day").cast("string"), "value"), "value")


def length_trend(s, d):
    df = table(s, d, "documents").select(F.floor(F.col("doc_id") / 10).alias("step"), F.sqrt("n_chars").alias("n"))
    return rounded(sampling.length_trend(df, "step", "n").select("step", "slope"), "slope")


def prime_rloo(s, d):
    df = samples(s, d).withColumn("acc", F.sqrt("score") / 100)
    return rounded(adv.summed_rloo(df, ["acc", "lp"]).select("uid", "pos", "advantage"), "advantage")


def kl_penalty(s, d):
    return rounded(seq.penalised_rewards(samples(s, d), F.sqrt("score"), 0.1).select("uid", "pos", "reward"), "reward")


def prob_correlation(s, d):
    return rounded(seq.probability_differences(samples(s, d)), "pearson", "max_diff", "mean_diff", "std_diff")


def sequence_logps(s, d):
    return rounded(seq.sequence_logprobs(samples(s, d), F.col("length") > 5), "total", "mean")


def stable_softmax_entropy(s, d):
    return rounded(seq.softmax_entropy(samples(s, d).withColumn("x", F.sqrt("score") / 100), "x"), "entropy", digits=5)


def throughput(s, d):
    e = table(s, d, "events").select("event_type", "value", F.length("props").alias("tokens"))
    return rounded(metrics.throughput(e, "event_type", "tokens", "value", 8), "per_second", "ms_per_token")


def sequence_imbalance(s, d):
    """Largest and smallest sum of lengths over 8 parts by id and their difference."""
    df = table(s, d, "documents").select((F.col("doc_id") % 8).alias("part"), "n_chars")
    return balance.imbalance(df, "part", "n_chars")


def provenance_check(s, d):
    """Whether a value occurs in the session's earlier observations."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(s, d, "events").withColumns({"step": F.row_number().over(w), "known_as": F.col("event_type")})
    return trajectories.provenance(e, "user_id", "known_as", "event_type", "step").select("event_id", "known")


def first_time_bonus(s, d):
    return trajectories.first_time_bonus(table(s, d, "events"), "user_id", "event_type", 0.5, "ts", "event_id").groupBy("user_id").agg(F.sum("bonus").alias("bonus"))


def replay_validity(s, d):
    return rounded(trajectories.valid_replays(table(s, d, "events"), "user_id", F.col("value") < 10), "error_rate")


def message_history(s, d):
    return relational.last_n(table(s, d, "conversations"), "conv_id", "turn", 3).select("conv_id", "turn", "total")


def gpqa_score(s, d):
    """Whole texts that name a letter, first or late, or none."""
    k = F.col("item_id") % 4
    letter = F.element_at(F.split(F.lit("A,B,C,D"), ","), (k + 1).cast("int"))
    t = F.concat("text", F.when(F.col("item_id") % 5 == 0, F.lit(" no letter")).otherwise(F.concat(F.lit(" answer : $"), letter, F.lit("$ or Answer: B"))))
    return table(s, d, "benchmark").select("item_id", answers.choice_score(t, F.lit("B")).alias("score"))


def nearest_vectors(s, d):
    """The three nearest vectors of every one whose id is divisible by 20, by cosine over all rows."""
    v = table(s, d, "embeddings")
    return rounded(retrieval.nearest(v, v.where("vec_id % 20 = 0"), "vec_id", "embedding", 3), "cosine", digits=5)


def clip_cov_tokens(s, d):
    df = adv.grpo(samples(s, d))
    return rounded(sampling.clipped_covariance_tokens(df, 0.002, ["uid", "pos"], 1000.0, 20000.0, 5).select("uid", "pos", "cov"), "cov")


def gpqa_choices(s, d):
    wrong = F.array(F.concat("p_type", F.lit("1")), F.concat("p_type", F.lit("2")), F.col("p_brand"))
    out = sampling.shuffled_choices(F.col("p_partkey"), F.col("p_name"), wrong)
    return table(s, d, "part").select("p_partkey", out.alias("c")).select("p_partkey", F.array_join("c.choices", "|").alias("choices"), "c.letter")


def logged_generations(s, d):
    return sampling.logged_sample(table(s, d, "benchmark"), "text", 10).select("item_id")


QUERIES = {f.__name__: f for f in (
    mix_draw, pf_weights, pf_resample, kl_cov_tokens, online_preference, adaptive_kl, length_trend, prime_rloo, kl_penalty, prob_correlation, sequence_logps,
    stable_softmax_entropy, throughput, sequence_imbalance, provenance_check, first_time_bonus, replay_validity,
    message_history, gpqa_score, nearest_vectors, clip_cov_tokens, gpqa_choices, logged_generations,
)}

_U = "('0x' || substr(md5('{}:' || {}), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE"
_GRPO = "CASE WHEN count(*) OVER w = 1 THEN score ELSE score - avg(score) OVER w END / (CASE WHEN count(*) OVER w = 1 THEN 1 ELSE stddev_samp(score) OVER w END + 1e-6)"
_LOO = "CASE WHEN count(*) OVER w = 1 THEN {0} ELSE ({0} - avg({0}) OVER w) * count(*) OVER w / nullif(count(*) OVER w - 1, 0) END"
_COS = "list_sum(list_transform(range(1, 65), lambda i: a.embedding[i]::DOUBLE * b.embedding[i]::DOUBLE))"
_NORM = "sqrt(list_sum(list_transform({}.embedding, lambda x: x::DOUBLE * x::DOUBLE)))"
ORACLE_SQL = {
    "mix_draw": f"WITH u AS (SELECT o_orderkey, {_U.format(7, 'o_orderkey')} AS u FROM orders) SELECT o_orderkey, CASE WHEN u < 0.5::DOUBLE THEN 'banking' WHEN u < 0.5::DOUBLE + 1.0::DOUBLE / 6 THEN 'calendar' ELSE 'email' END AS domain FROM u",
    "pf_weights": f"""WITH {SAMPLES_SQL}, x AS (SELECT uid, pos, score / 1e4 AS x FROM s), m AS (SELECT max(x) AS hi, min(x) AS lo FROM x)
      SELECT uid, pos, round(pow(abs(x), 2), 6) + 0.0 AS w_pow, CASE WHEN x = hi OR x = lo THEN 1.0 ELSE 0.0 END::DOUBLE AS w_max_min, CASE WHEN x = hi THEN 0.4 ELSE 0.1 END::DOUBLE AS w_max_random FROM x, m""",
    "pf_resample": f"""WITH {SAMPLES_SQL}, h AS (SELECT uid, pos, sqrt(score) / sum(sqrt(score)) OVER (PARTITION BY uid) * 4 AS h FROM s),
      c AS (SELECT *, sum(h) OVER (PARTITION BY uid ORDER BY pos) AS c, {_U.format(3, 'uid')} AS u FROM h), k AS (SELECT uid, pos, floor(c + u) - floor(c - h + u) AS k FROM c)
      SELECT uid, sum(k)::BIGINT AS rows, min(pos) AS first FROM k WHERE k > 0 GROUP BY uid""",
    "kl_cov_tokens": f"""WITH {SAMPLES_SQL}, a AS (SELECT uid, pos, lp, {_GRPO} AS adv FROM s WINDOW w AS (PARTITION BY uid)), m AS (SELECT avg(lp) AS ml, avg(adv) AS ma, count(*) AS n FROM a)
      SELECT uid, pos, round((lp - ml) * (adv - ma), 6) + 0.0 AS cov FROM a, m QUALIFY row_number() OVER (ORDER BY (lp - ml) * (adv - ma) DESC, uid, pos) <= greatest(1, floor(n * 0.002::DOUBLE))""",
    "online_preference": f"""WITH {SAMPLES_SQL}, p AS (SELECT uid, pos, score, (pos - 1) // 2 AS pair FROM s)
      SELECT uid, pos, pair, (row_number() OVER (PARTITION BY uid, pair ORDER BY score DESC, pos) = 1)::INT AS chosen FROM p QUALIFY count(*) OVER (PARTITION BY uid, pair) = 2""",
    "adaptive_kl": """WITH b AS (SELECT ts::DATE AS day, avg(value) / 8 AS kl, count(*) AS n FROM events GROUP BY 1)
      SELECT day::VARCHAR AS day, round(0.2::DOUBLE * exp(sum(ln(1 + greatest(least(kl / 6 - 1, 0.2::DOUBLE), -0.2::DOUBLE) * n / 10000)) OVER (ORDER BY day)), 6) + 0.0 AS value FROM b""",
    "length_trend": """WITH m AS (SELECT doc_id // 10 AS step, avg(sqrt(n_chars)) AS m FROM documents GROUP BY 1)
      SELECT step, CASE WHEN row_number() OVER (ORDER BY step) > 1 THEN round(regr_slope(m, step) OVER (ORDER BY step ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 6) + 0.0 END AS slope FROM m""",
    "prime_rloo": f"""WITH {SAMPLES_SQL}, x AS (SELECT uid, pos, sqrt(score) / 100 AS acc, lp FROM s), r AS (SELECT uid, pos, {_LOO.format('acc')} + {_LOO.format('lp')} AS r FROM x WINDOW w AS (PARTITION BY uid)),
      t AS (SELECT uid, pos, sum(r) OVER (PARTITION BY uid ORDER BY pos DESC) AS g FROM r) SELECT uid, pos, round((g - avg(g) OVER ()) / sqrt(var_samp(g) OVER () + 1e-8), 6) + 0.0 AS advantage FROM t""",
    "kl_penalty": f"WITH {SAMPLES_SQL} SELECT uid, pos, round(CASE WHEN pos = max(pos) OVER (PARTITION BY uid) THEN sqrt(score) ELSE 0 END - 0.1::DOUBLE * (lp - ref_lp), 6) + 0.0 AS reward FROM s",
    "prob_correlation": f"WITH {SAMPLES_SQL}, p AS (SELECT exp(lp) AS p, exp(old_lp) AS q FROM s) SELECT round(corr(p, q), 6) + 0.0 AS pearson, round(max(abs(p - q)), 6) + 0.0 AS max_diff, round(avg(abs(p - q)), 6) + 0.0 AS mean_diff, round(stddev_samp(abs(p - q)), 6) + 0.0 AS std_diff FROM p",
    "sequence_logps": f"WITH {SAMPLES_SQL} SELECT uid, round(coalesce(sum(lp) FILTER (length > 5), 0), 6) + 0.0 AS total, round(avg(lp) FILTER (length > 5), 6) + 0.0 AS mean FROM s GROUP BY uid",
    "stable_softmax_entropy": f"""WITH {SAMPLES_SQL}, z AS (SELECT uid, sqrt(score) / 100 - max(sqrt(score) / 100) OVER (PARTITION BY uid) AS z FROM s), p AS (SELECT uid, exp(z) / sum(exp(z)) OVER (PARTITION BY uid) AS p FROM z)
      SELECT uid, round(-sum(p * ln(p)), 5) + 0.0 AS entropy FROM p GROUP BY uid""",
    "throughput": "SELECT event_type, round(sum(length(props)) / sum(value) / 8, 6) + 0.0 AS per_second, round(sum(value) * 1000 / sum(length(props)), 6) + 0.0 AS ms_per_token FROM events GROUP BY event_type",
    "sequence_imbalance": "WITH g AS (SELECT sum(n_chars)::BIGINT AS t FROM documents GROUP BY doc_id % 8) SELECT max(t) AS greatest, min(t) AS least, max(t) - min(t) AS difference FROM g",
    "provenance_check": """SELECT event_id, CASE WHEN length(event_type) < 3 THEN true ELSE contains(coalesce(string_agg(event_type, chr(10)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ''), event_type) END AS known FROM events""",
    "first_time_bonus": "SELECT user_id, 0.5::DOUBLE * count(DISTINCT event_type) AS bonus FROM events GROUP BY user_id",
    "replay_validity": "SELECT user_id, round(avg((value < 10)::DOUBLE), 6) + 0.0 AS error_rate FROM events GROUP BY user_id HAVING avg((value < 10)::DOUBLE) <= 0.30",
    "message_history": "SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id) AS total FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3",
    "gpqa_score": "SELECT item_id, (item_id % 5 <> 0 AND item_id % 4 = 1)::INT::DOUBLE AS score FROM benchmark",
    "nearest_vectors": f"""WITH q AS (SELECT * FROM embeddings WHERE vec_id % 20 = 0), c AS (SELECT b.vec_id AS query_id, a.vec_id, {_COS} / ({_NORM.format('a')} * {_NORM.format('b')}) AS cosine FROM embeddings a, q b WHERE a.vec_id <> b.vec_id),
      r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS rank FROM c) SELECT query_id, vec_id, round(cosine, 5) + 0.0 AS cosine, rank FROM r WHERE rank <= 3""",
    "logged_generations": "SELECT item_id FROM benchmark ORDER BY md5('42:' || text), text LIMIT 10",
    "clip_cov_tokens": f"""WITH {SAMPLES_SQL}, a AS (SELECT uid, pos, lp, {_GRPO} AS adv FROM s WINDOW w AS (PARTITION BY uid)), m AS (SELECT avg(lp) AS ml, avg(adv) AS ma, count(*) AS n FROM a),
      c AS (SELECT uid, pos, n, (lp - ml) * (adv - ma) AS cov, {_U.format(5, "(uid || ':' || pos)")} AS u FROM a, m)
      SELECT uid, pos, round(cov, 6) + 0.0 AS cov FROM c WHERE cov > 1000 AND cov < 20000 QUALIFY row_number() OVER (ORDER BY u, uid, pos) <= greatest(1, floor(n * 0.002::DOUBLE))""",
    "gpqa_choices": f"""WITH p AS (SELECT p_partkey, p_name, list_transform(list_sort(list_transform([p_type || '1', p_type || '2', p_brand], lambda w: {{'h': md5('42:' || p_partkey || w), 'w': w}})), lambda x: x.w) AS m, floor({_U.format(42, "'place:' || p_partkey")} * 4)::INT AS k FROM part)
      SELECT p_partkey, array_to_string(list_concat(list_concat(m[1:k], [p_name]), m[k + 1 : 3]), '|') AS choices, substr('ABCD', k + 1, 1) AS letter FROM p""",
}
