"""Queries and checking SQL of queues and windows over streams of files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from weftline.plans.samples import rounded, table
from weftline.session import checkpoint_folder
from weftline.streaming import queue

CAPACITY, RELEASE = 50, 7
MESSAGE = "queue string, seq long, payload string, param_version int"


def _folder(s, kind):
    return f"{checkpoint_folder(s)}/{kind}-{uuid.uuid4().hex}"


def _queued(s, d):
    e = table(s, d, "events").select(F.col("event_type").alias("queue"), F.col("event_id").alias("seq"), F.col("props").alias("payload"), (F.col("user_id") % 5).cast("int").alias("param_version"))
    half = e.agg(F.floor(F.max("seq") / 2)).first()[0]
    path, out = _folder(s, "messages"), _folder(s, "queues")
    for part in (e.where(F.col("seq") <= half), e.where(F.col("seq") > half)):  # what is new is one micro-batch, in however many files
        part.write.mode("append").parquet(path)
        got = queue.drained(queue.bounded_queue(s.readStream.schema(MESSAGE).parquet(path), CAPACITY, RELEASE), out)
    return got


def queue_events(s, d):
    """Two micro-batches of messages by kind of event through bounded queues: what is dropped and what is taken."""
    return _queued(s, d).select("queue", "seq", "event", "produced", "dropped")


def queue_statistics(s, d):
    return queue.queue_statistics(_queued(s, d))


def fresh_messages(s, d):
    """Messages that lag by three versions at most, with the samples that may be produced before the next sync, by their number, share and steps."""
    e = table(s, d, "events").select("event_id", (F.col("user_id") % 9).cast("int").alias("param_version"))
    return queue.fresh(e, 8, 3).withColumn("budget", queue.staleness_budget(F.col("event_id") % 64, (F.col("param_version") - 5) / 2, F.lit(4)))


def windowed_usage(s, d):
    path = _folder(s, "usage")
    table(s, d, "events").select("ts", "event_type", "value").write.parquet(path)
    stream = s.readStream.schema(table(s, d, "events").select("ts", "event_type", "value").schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))
    out = queue.drained(queue.windowed_usage(stream), _folder(s, "windows"))
    return rounded(out.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss")), "total", digits=4)


def dual_variable_stream(s, d):
    """Multipliers of two runs moved by each of three micro-batches of costs."""
    e = table(s, d, "events").select(F.concat(F.lit("run"), (F.col("user_id") % 2).cast("string")).alias("name"), (F.col("value") > F.when(F.col("event_id") % 3 == 1, 80).otherwise(10)).cast("double").alias("cost"), "event_id")
    path, out = _folder(s, "costs"), _folder(s, "duals")
    for k in range(3):
        e.where(F.col("event_id") % 3 == k).select("name", "cost").write.mode("append").parquet(path)
        got = queue.drained(queue.dual_variable(s.readStream.schema("name string, cost double").parquet(path), rate=0.1, stall_after=1), out)
    return rounded(got, "cost", "lam")


QUERIES = {f.__name__: f for f in (queue_events, queue_statistics, fresh_messages, windowed_usage, dual_variable_stream)}

ORACLE_SQL = {
    "queue_events": f"""WITH h AS (SELECT floor(max(event_id) / 2) AS h FROM events), k AS (SELECT event_type AS queue, event_id AS seq, event_id <= h AS one, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k,
        sum((event_id <= h)::INT) OVER (PARTITION BY event_type) AS n1, sum((event_id > h)::INT) OVER (PARTITION BY event_type) AS n2 FROM events, h),
      e AS (SELECT *, CASE WHEN k <= n1 - {CAPACITY} THEN 'dropped' WHEN k <= n1 - {CAPACITY} + {RELEASE} THEN 'taken' WHEN k <= n1 + n2 - {CAPACITY} THEN 'dropped' WHEN k <= n1 + n2 - {CAPACITY} + {RELEASE} THEN 'taken' END AS event FROM k)
      SELECT queue, seq, event, CASE event WHEN 'dropped' THEN CASE WHEN k <= n1 - {CAPACITY} THEN k + {CAPACITY} - 1 ELSE k + {CAPACITY} - 1 END ELSE CASE WHEN k <= n1 - {CAPACITY} + {RELEASE} THEN n1 ELSE n1 + n2 END END::BIGINT AS produced,
        CASE event WHEN 'dropped' THEN CASE WHEN k <= n1 - {CAPACITY} THEN k ELSE k - {RELEASE} END ELSE CASE WHEN k <= n1 - {CAPACITY} + {RELEASE} THEN n1 - {CAPACITY} ELSE n1 + n2 - {CAPACITY} - {RELEASE} END END::BIGINT AS dropped FROM e WHERE event IS NOT NULL""",
    "queue_statistics": f"""WITH h AS (SELECT floor(max(event_id) / 2) AS h FROM events), n AS (SELECT event_type AS queue, sum((event_id <= h)::INT) AS n1, sum((event_id > h)::INT) AS n2 FROM events, h GROUP BY 1)
      SELECT queue, {2 * RELEASE}::BIGINT AS consumed, (n1 + n2 - {2 * CAPACITY} + {CAPACITY} - {RELEASE})::BIGINT AS dropped, (n1 + n2)::BIGINT AS produced FROM n""",
    "fresh_messages": "SELECT event_id, (user_id % 9)::INT AS param_version, floor((event_id % 64) * ((user_id % 9 - 5) / 2 + 1) * 4)::BIGINT AS budget FROM events WHERE user_id % 9 >= 5",
    "windowed_usage": """WITH m AS (SELECT max(ts) - INTERVAL 10 MINUTE AS w FROM events) SELECT strftime(time_bucket(INTERVAL 5 MINUTE, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) + 0.0 AS total
      FROM events, m GROUP BY time_bucket(INTERVAL 5 MINUTE, ts), event_type, w HAVING time_bucket(INTERVAL 5 MINUTE, any_value(ts)) + INTERVAL 5 MINUTE <= w""",
    "dual_variable_stream": """WITH c AS (SELECT 'run' || user_id % 2 AS name, event_id % 3 + 1 AS batch, avg((value > CASE WHEN event_id % 3 = 1 THEN 80 ELSE 10 END)::INT) AS cost FROM events GROUP BY 1, 2),
      s AS (SELECT *, 1 + 0 * cost AS first, lead(cost) OVER w AS c2, lead(cost, 2) OVER w AS c3 FROM c WINDOW w AS (PARTITION BY name ORDER BY batch)),
      a AS (SELECT name, cost AS c1, c2, c3 FROM s WHERE batch = 1), b AS (SELECT *, greatest(0, least(3, 1.0::DOUBLE + 0.1::DOUBLE * (c2 - 0.05::DOUBLE))) AS l2 FROM a)
      SELECT name, k AS batch, round(CASE k WHEN 1 THEN c1 WHEN 2 THEN c2 ELSE c3 END, 6) + 0.0 AS cost, round(CASE k WHEN 1 THEN 1.0 ELSE l2 END, 6) + 0.0 AS lam, CASE k WHEN 2 THEN 0 ELSE 1 END AS streak, k <> 2 AS frozen
      FROM b, (VALUES (1::BIGINT), (2::BIGINT), (3::BIGINT)) v(k)""",
}
