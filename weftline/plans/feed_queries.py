"""Queries and checking SQL of audited streams, idempotent sinks, epochs and curricula."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from weftline.operators import curriculum
from weftline.operators.batch import with_row_index
from weftline.plans.samples import rounded, table
from weftline.session import checkpoint_folder
from weftline.sources import epochs
from weftline.streaming import audit, queue, sinks

#: Events of a user as a session that deletes, creates and reads entities, in SQL that both engines know.
SESSIONS = """
WITH e AS (SELECT event_id, user_id, event_type, CAST(floor(value) AS INT) AS v FROM events)
SELECT 'u' || user_id AS session, event_id AS seq, CASE event_type WHEN 'signup' THEN 'create' WHEN 'error' THEN 'delete' ELSE 'query' END AS operation,
  CASE WHEN v % 19 = 0 THEN '' ELSE 'r' || (v % 10) END AS target_id, CASE WHEN v % 3 = 0 THEN NULL WHEN v % 3 = 1 THEN ' Talk ' || (v % 13) ELSE 'TALK ' || (v % 13) || ' ' END AS title,
  CASE WHEN v % 4 = 0 THEN '' ELSE 'day ' || (v % 23) END AS start, CASE WHEN v % 29 = 0 THEN 'skipped' ELSE '' END AS forbidden_transition FROM e"""


def _folder(s, kind):
    return f"{checkpoint_folder(s)}/{kind}-{uuid.uuid4().hex}"


def _sessions(s, d):
    table(s, d, "events").createOrReplaceTempView("_events_of_sessions")
    return s.sql(SESSIONS.replace("FROM events)", "FROM _events_of_sessions)"))


def audit_stream(s, d):
    """Sessions audited over three micro-batches, with a restart after each."""
    events, source, out = _sessions(s, d), _folder(s, "sessions"), _folder(s, "audited")
    top = table(s, d, "events").agg(F.max("event_id")).first()[0]
    for k in range(3):
        events.where((F.col("seq") * 3 > k * top) & (F.col("seq") * 3 <= (k + 1) * top) | ((F.col("seq") == 0) & F.lit(k == 0))).write.mode("append").parquet(source)
        got = queue.drained(audit.audited_stream(s.readStream.schema(events.schema).parquet(source)), out)
    return got


def audit_log(s, d):
    """The same sessions as a finished log."""
    return audit.audited_log(_sessions(s, d))


def lambda_commits(s, d):
    """A multiplier moved by each of four micro-batches of costs, whose last is handed over twice."""
    e = table(s, d, "events").select((F.col("value") > F.when(F.col("event_id") % 4 == 2, 80).otherwise(10)).cast("int").alias("is_unsafe"), "event_id")
    source, out = _folder(s, "unsafe"), _folder(s, "lambda")
    sink = sinks.multiplier_sink(out, rate=0.1, stall_after=2)
    for k in range(4):
        e.where(F.col("event_id") % 4 == k).write.mode("append").parquet(source)
        sinks.run(s.readStream.schema(e.schema).parquet(source), sink, f"{out}-log")
    sink(e.where(F.col("event_id") % 4 == 3), 3)
    return rounded(sinks.committed(s, out, sinks.CONTROL), "cost", "lam")


def assembled_batches(s, d):
    """Rollouts of events assembled to training batches of 64 over two micro-batches: which batch each is in, null for those that wait."""
    return _assembled(s, d)[0]


def step_metrics(s, d):
    """The metrics of each micro-batch's assembled rollouts."""
    return rounded(_assembled(s, d)[1], "value", digits=5)


def _assembled(s, d):
    e = table(s, d, "events").select(F.col("event_id").alias("seq"), (F.col("user_id") % 5).alias("param_version"), (F.col("user_id") % 3).alias("version_start"), (F.col("event_id") % 3).alias("version_end"), F.col("value").alias("seconds"))
    source, out = _folder(s, "rollouts"), _folder(s, "assembled")
    half = e.agg(F.floor(F.max("seq") / 2)).first()[0]
    for part in (e.where(F.col("seq") <= half), e.where(F.col("seq") > half)):
        part.write.mode("append").parquet(source)
        sinks.run(s.readStream.schema(e.schema).parquet(source), sinks.batch_sink(out, 64), f"{out}/log")
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in e.schema.fields) + ", assembled long"
    rows = sinks.committed(s, f"{out}/samples", kind)
    # a rollout that waited is in the next batch's folder again: where it was assembled counts
    return rows.groupBy("seq").agg(F.max("assembled").alias("assembled")), sinks.committed(s, f"{out}/metrics", sinks.METRICS)


def epoch_feed(s, d):
    """Two epochs over the orders in a seeded order, read in three runs that each take up where the one before stopped."""
    orders = with_row_index(table(s, d, "orders").select("o_orderkey"), "o_orderkey")
    n, out = orders.count(), _folder(s, "epochs")
    for budget in (n // 3, n + n // 2, None):
        got = queue.drained(epochs.epochs(s, n, 2, seed=7, budget=budget), out)
    return epochs.samples(got, orders).groupBy("epoch", "done", "o_orderkey").agg(F.count(F.lit(1)).alias("times"))


def epoch_order(s, d):
    return curriculum.epoch_order(table(s, d, "orders").select("o_orderkey"), "o_orderkey", True, 3, 2)


def curriculum_draw(s, d):
    """A tenth of the orders drawn by price, scored, and what the priorities are then."""
    o = table(s, d, "orders").select("o_orderkey", (F.col("o_totalprice") / 1e5).alias("priority"))
    batch = curriculum.drawn(o, "o_orderkey", "priority", o.count() // 10, 5)
    scores = batch.select("o_orderkey", ((F.col("o_orderkey") % 11) / 10).alias("score"))
    after = curriculum.reprioritised(o, "o_orderkey", "priority", scores, "score")
    return rounded(after.join(batch.select("o_orderkey", "position"), "o_orderkey", "left"), "priority", digits=9)


def stall_streaks(s, d):
    e = table(s, d, "events").select("user_id", "event_id", (F.col("event_id") % 3 > 0).alias("rose"), (F.col("value") / 20).alias("rate"))
    return sinks.stall_streaks(e, "user_id", "event_id", "rose", "rate", 3).select("event_id", "streak", "stalled")


QUERIES = {f.__name__: f for f in (audit_stream, audit_log, lambda_commits, assembled_batches, step_metrics, epoch_feed, epoch_order, curriculum_draw, stall_streaks)}

_AUDIT = f"""
WITH s AS ({SESSIONS}),
n AS (SELECT session, seq, operation, target_id, lower(trim(coalesce(title, ''))) AS title, coalesce(start, '') AS start, forbidden_transition, row_number() OVER (PARTITION BY session ORDER BY seq) AS step FROM s),
d AS (SELECT *, lead(step) OVER (PARTITION BY session, target_id ORDER BY step) AS until FROM n WHERE operation = 'delete' AND target_id <> '')
SELECT session, seq, step, 'evtlog_' || session || '_' || lpad(step::VARCHAR, 6, '0') AS log_id, operation, target_id,
  CASE WHEN forbidden_transition <> '' THEN forbidden_transition WHEN operation = 'create' AND EXISTS (
    SELECT 1 FROM d WHERE d.session = n.session AND d.step < n.step AND coalesce(d.until, 1000000000) > n.step AND ((d.title <> '' AND d.title = n.title) OR (d.start <> '' AND d.start = n.start)))
    THEN 'forbidden_transition_delete_recreate' ELSE '' END AS forbidden_transition FROM n"""
_U = "('0x' || left(md5('{s}:' || {k}), 13))::BIGINT / 4503599627370496.0::DOUBLE"
_ASSEMBLED = """a AS (SELECT event_id AS seq, user_id, value, row_number() OVER (ORDER BY event_id) - 1 AS k, count(*) OVER () AS n, event_id <= (SELECT floor(max(event_id) / 2) FROM events) AS one FROM events),
  b AS (SELECT *, CASE WHEN k < n // 64 * 64 THEN k // 64 + 1 END AS assembled, CASE WHEN k < (SELECT count(*) FROM a WHERE one) // 64 * 64 THEN 0 ELSE 1 END AS batch FROM a)"""

ORACLE_SQL = {
    "audit_stream": _AUDIT,
    "audit_log": _AUDIT,
    "lambda_commits": """
WITH RECURSIVE c AS (SELECT event_id % 4 AS batch, count(*) AS samples, avg((value > CASE WHEN event_id % 4 = 2 THEN 80 ELSE 10 END)::INT) AS cost FROM events GROUP BY 1),
r AS (
  SELECT -1::BIGINT AS batch, 0::BIGINT AS samples, 0.0::DOUBLE AS cost, 1.0::DOUBLE AS lam, 0 AS streak, false AS frozen, false AS skipped
  UNION ALL
  SELECT c.batch, c.samples, c.cost, CASE WHEN f AND c.cost > 0.05 THEN lam ELSE greatest(0, least(3, lam + 0.1::DOUBLE * (c.cost - 0.05))) END, k, f, f AND c.cost > 0.05
  FROM (SELECT r.lam, c.batch, c.samples, c.cost, CASE WHEN c.cost > 0.5 THEN r.streak + 1 ELSE greatest(0, r.streak - 1) END AS k,
          CASE WHEN c.cost > 0.5 THEN r.frozen OR r.streak + 1 >= 2 ELSE r.frozen AND greatest(0, r.streak - 1) >= 2 END AS f FROM r JOIN c ON c.batch = r.batch + 1) c)
SELECT batch, samples, round(cost, 6) + 0.0 AS cost, round(lam, 6) + 0.0 AS lam, streak, frozen, skipped FROM r WHERE batch >= 0""",
    "assembled_batches": f"WITH {_ASSEMBLED} SELECT seq, assembled FROM b",
    "step_metrics": f"""
WITH {_ASSEMBLED},
m AS (SELECT batch, count(*)::DOUBLE AS samples, count(DISTINCT user_id % 5)::DOUBLE AS param_version_diversity, avg(value) AS a, max(value) AS hi, min(value) AS lo, sum((user_id % 3 <> seq % 3)::INT)::DOUBLE AS p,
        avg((user_id % 3 <> seq % 3)::INT) AS share, max(abs(seq % 3 - user_id % 3))::DOUBLE AS span, quantile_cont(value, 0.5) AS t50, quantile_cont(value, 0.95) AS t95, quantile_cont(value, 0.99) AS t99 FROM b WHERE assembled IS NOT NULL GROUP BY batch)
SELECT batch::BIGINT AS batch, unnest(['samples', 'param_version_diversity', 'processing_time/avg', 'processing_time/max', 'processing_time/min', 'partial/total_partial_num', 'partial/partial_ratio', 'partial/max_partial_span', 'processing_time/tp50', 'processing_time/tp95', 'processing_time/tp99']) AS key,
  round(unnest([samples, param_version_diversity, a, hi, lo, p, share, span, t50, t95, t99]), 5) + 0.0 AS value FROM m""",
    "epoch_feed": """
SELECT e AS epoch, false AS done, o_orderkey, 1::BIGINT AS times FROM orders, (VALUES (0::BIGINT), (1::BIGINT)) v(e) UNION ALL SELECT 2, true, NULL, 1""",
    "epoch_order": "SELECT o_orderkey, row_number() OVER (ORDER BY md5('3:2:' || o_orderkey), o_orderkey) - 1 AS position FROM orders",
    "curriculum_draw": f"""
WITH o AS (SELECT o_orderkey, o_totalprice / 1e5 AS p, {_U.format(s=5, k="'0:' || o_orderkey")} AS u FROM orders),
r AS (SELECT *, row_number() OVER (ORDER BY -ln(1.0 - u) / p, o_orderkey) - 1 AS position, count(*) OVER () // 10 AS n FROM o)
SELECT o_orderkey, CASE WHEN position < n THEN position END AS position,
  round(CASE WHEN position < n THEN greatest(0.5::DOUBLE * p + 0.5::DOUBLE * greatest(1 - 2 * abs(o_orderkey % 11 / 10.0::DOUBLE - 0.5), 0.01), 0.01) ELSE p END, 9) + 0.0 AS priority FROM r""",
    "stall_streaks": """
WITH m AS (SELECT user_id, event_id, CASE WHEN event_id % 3 > 0 AND value / 20 > 0.5 THEN 1 ELSE -1 END AS m FROM events),
w AS (SELECT *, sum(m) OVER (PARTITION BY user_id ORDER BY event_id) AS s FROM m),
k AS (SELECT event_id, (s - least(0, min(s) OVER (PARTITION BY user_id ORDER BY event_id)))::INT AS streak FROM w)
SELECT event_id, streak, streak >= 3 AS stalled FROM k""",
}
