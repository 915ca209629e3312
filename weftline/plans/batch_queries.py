"""Queries and checking SQL of batch algebra on rows and columns, of group statistics and of executed calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import advantages, batch, execution
from weftline.plans.samples import SAMPLES_SQL, rounded, samples, table


def _orders(s, d):
    o = table(s, d, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_custkey") % 7 == 0, F.lit(float("nan"))).when(F.col("o_custkey") % 7 > 1, F.col("o_totalprice")).alias("price"), "o_orderstatus")
    return batch.with_row_index(o, "o_orderkey")


def zipped_batches(s, d):
    """Two parts of a batch side by side: the columns of both are equal, nulls and NaNs too; each part is popped from the batch, one renamed."""
    o = _orders(s, d)
    kept, rest = o.select("row_idx", "o_orderkey", "price"), o.select("row_idx", "price", "o_orderstatus").withColumnsRenamed({"o_orderstatus": "status"})
    return batch.zip_union(kept, rest).select("o_orderkey", F.isnan("price").alias("odd"), F.when(~F.isnan("price"), F.col("price")).alias("price"), "status")


def permuted_and_restored(s, d):
    """Rows in a hashed order, their inverse index, and the batch in its old order again."""
    o = _orders(s, d).select("row_idx", "o_orderkey")
    order = batch.with_row_index(o.select(F.col("row_idx").alias("idx"), F.md5(F.col("o_orderkey").cast("string")).alias("h")), "h", row="pos").select("pos", "idx")
    moved = batch.reorder(o, order)
    back = batch.reorder(moved.select("row_idx", "o_orderkey"), batch.inverse(order))
    return moved.withColumnRenamed("row_idx", "moved").join(back, "o_orderkey").join(batch.inverse(order).select(F.col("pos").alias("row_idx"), F.col("idx").alias("inverse")), "row_idx").select("o_orderkey", "moved", "row_idx", "inverse")


def gathered_and_padded(s, d):
    """Rows by a list of indices with repeats, and the batch padded to a multiple of 64 with its leading rows."""
    o = _orders(s, d).select("row_idx", "o_orderkey")
    n = o.count()
    wanted = s.range(n).select(F.col("id").alias("pos"), F.floor(F.col("id") * F.col("id") % n).alias("idx"))
    picked = batch.gather(o, wanted).groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("picked"))
    padded = batch.pad_to_divisor(o, n, 64).groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("padded"), F.max("row_idx").alias("last"))
    return padded.join(picked, "o_orderkey", "left")


def unfolded(s, d):
    """The prices of each customer's orders, lists of any length, cut into two halves a row each."""
    lists = table(s, d, "orders").groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_totalprice"))), lambda x: x["o_totalprice"]).alias("prices"))
    out = batch.unfold_columns(lists, "prices", 2)
    return out.select("o_custkey", "part", F.size("prices").alias("n"), F.round(F.aggregate("prices", F.lit(0.0), lambda a, x: a + x), 2).alias("total"))


def group_moments(s, d):
    return rounded(advantages.group_moments(samples(s, d)), "mean", "std")


def column_sizes(s, d):
    return execution.sizes(table(s, d, "events").select("event_id", "event_type", "value", "props"))


#: Calls of tools that are there, blocked, unknown or without a server, in SQL that both engines know.
CALLED = """
WITH e AS (SELECT event_id, user_id % 6 AS a, event_id % 5 AS b, user_id % 7 AS c FROM events)
SELECT event_id AS id, CASE a WHEN 0 THEN 'find' WHEN 1 THEN 'open' WHEN 2 THEN 'open' WHEN 3 THEN 'lost' ELSE 'nowhere' END AS tool, CASE WHEN b = 0 THEN 'two' ELSE 'one' END AS domain,
  CASE b WHEN 1 THEN '{}' WHEN 2 THEN '{"id":1}' WHEN 3 THEN '{"id":"x","more":1}' ELSE '{"id":"x"}' END AS arguments, CASE WHEN c = 1 THEN 'open' ELSE 'none' END AS blocks, c FROM e"""


def executed_calls(s, d):
    """What each call comes to, down the ladder of checks to the handler's response."""
    table(s, d, "events").createOrReplaceTempView("_events_called")
    made = s.sql(CALLED.replace("FROM events)", "FROM _events_called)"))
    schema = '{"parameters":{"properties":{"id":{"type":"string"}},"required":["id"]}}'
    tools = s.createDataFrame([("find", "one", '{"input_schema":{"properties":{"id":{}}}}', 1), ("open", "one", schema, 2), ("open", "two", schema, 3), ("nowhere", None, schema, 4)], "tool string, server string, schema string, nth int")
    c = F.col("c")
    answers = made.where(c != 2).select("id", (c > 4).alias("success"), F.when(c > 4, '{"ok":true}').alias("observation"), F.when(c == 4, "").alias("error_type"), F.when(c > 2, F.concat(F.lit("m"), c.cast("string"))).alias("error_message"),
        (c == 6).alias("state_changed"), F.when(c == 0, "timeout").alias("transport"), (c != 3).alias("handled"), F.when((c == 4) & (F.col("id") % 3 > 0), F.when(F.col("id") % 3 == 1, "KeyError").otherwise("ValueError")).alias("raised"))
    return execution.executed(made.select("id", "tool", "domain", "arguments", F.array("blocks").alias("blocked")), tools, answers)


def cached_graphs(s, d):
    """Edges between kinds of parts, with those of a cached graph in place of a brand's own where the graph has the right shape."""
    p = table(s, d, "part").select(F.col("p_brand").alias("server"), F.concat(F.lit("get_"), F.col("p_type")).alias("source"), F.concat(F.lit("t"), (F.col("p_partkey") % 4).cast("string")).alias("target")).distinct().withColumn("relation", F.lit("implicit"))
    n = F.length("server") + F.ascii(F.right("server", F.lit(1)))
    graph = F.when(n % 4 == 0, '{"a":{"explicit":["b","c"],"implicit":[]},"b":{"explicit":[],"implicit":["a"]}}').when(n % 4 == 1, '{"a":{"explicit":["b"]}}').when(n % 4 == 2, "{}").otherwise("no json")
    return execution.overridden_edges(p, p.select("server").distinct().withColumn("graph", graph))


QUERIES = {f.__name__: f for f in (zipped_batches, permuted_and_restored, gathered_and_padded, unfolded, group_moments, column_sizes, executed_calls, cached_graphs)}

ORACLE_SQL = {
    "zipped_batches": "SELECT o_orderkey, CASE WHEN o_custkey % 7 <> 1 THEN o_custkey % 7 = 0 ELSE false END AS odd, CASE WHEN o_custkey % 7 > 1 THEN o_totalprice END AS price, o_orderstatus AS status FROM orders",
    "permuted_and_restored": """WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_idx, row_number() OVER (ORDER BY md5(o_orderkey::VARCHAR)) - 1 AS moved FROM orders) SELECT o_orderkey, moved, row_idx, moved AS inverse FROM o""",
    "gathered_and_padded": """WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders), w AS (SELECT r * r % (SELECT count(*) FROM orders) AS idx, count(*) AS picked FROM range((SELECT count(*) FROM orders)) t(r) GROUP BY 1)
      SELECT o_orderkey, 1 + (i < (64 - n % 64) % 64)::BIGINT AS padded, CASE WHEN i < (64 - n % 64) % 64 THEN i + n ELSE i END AS last, picked FROM o LEFT JOIN w ON idx = i""",
    "unfolded": """WITH r AS (SELECT o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_custkey) // 2 AS h FROM orders), p AS (SELECT DISTINCT o_custkey, h, part::INT AS part FROM r, range(2) t(part))
      SELECT p.o_custkey, p.part, p.h::INT AS n, round(coalesce(sum(o_totalprice), 0), 2) AS total FROM p LEFT JOIN r ON r.o_custkey = p.o_custkey AND r.i >= p.part * p.h AND r.i < (p.part + 1) * p.h GROUP BY 1, 2, 3""",
    "group_moments": f"WITH {SAMPLES_SQL} SELECT uid, count(*) AS n, round(CASE WHEN count(*) = 1 THEN 0 ELSE avg(score) END, 6) + 0.0 AS mean, round(CASE WHEN count(*) = 1 THEN 1 ELSE sqrt(greatest(var_samp(score), 1e-6)) END, 6) + 0.0 AS std FROM s GROUP BY uid",
    "column_sizes": """SELECT unnest(['event_id', 'event_type', 'value', 'props']) AS "column", n AS rows, unnest([8 * n, a, 8 * n, b])::BIGINT AS bytes FROM (SELECT count(*) AS n, sum(strlen(event_type)) AS a, sum(strlen(props::VARCHAR)) AS b FROM events)""",
    "executed_calls": f"""
WITH m AS ({CALLED}),
w AS (SELECT *, CASE WHEN blocks = 'open' AND tool = 'open' THEN 1 WHEN tool = 'lost' THEN 2 WHEN (tool IN ('open', 'nowhere') AND arguments <> '{{"id":"x"}}') OR (tool = 'find' AND arguments LIKE '%more%') THEN 3 WHEN tool = 'nowhere' THEN 4 WHEN c IN (0, 2) THEN 5 WHEN c = 3 THEN 6 WHEN c = 4 AND id % 3 > 0 THEN 7 ELSE 8 END AS k,
       CASE WHEN tool = 'find' THEN 'one' WHEN tool = 'open' THEN domain END AS server FROM m)
SELECT id, tool, server, k = 8 AND c > 4 AS success, CASE k WHEN 1 THEN '{{"error":"Tool ''open'' is not available for this task"}}' WHEN 3 THEN '{{"missing_required":[' || CASE WHEN arguments = '{{}}' THEN '"id"' ELSE '' END || '],"unexpected_keys":[' || CASE WHEN arguments LIKE '%more%' THEN '"more"' ELSE '' END || '],"type_errors":[' ||
    CASE WHEN arguments = '{{"id":1}}' THEN '"id"' ELSE '' END || '],"enum_errors":[]}}' WHEN 8 THEN CASE WHEN c > 4 THEN '{{"ok":true}}' END END AS observation,
  CASE k WHEN 1 THEN 'unknown_tool' WHEN 2 THEN 'unknown_tool' WHEN 3 THEN 'schema_invalid' WHEN 4 THEN 'server_unavailable' WHEN 5 THEN CASE c WHEN 0 THEN 'timeout' ELSE 'server_unavailable' END WHEN 6 THEN 'unknown_tool' WHEN 7 THEN CASE id % 3 WHEN 1 THEN 'precondition_failed' ELSE 'execution_error' END ELSE CASE WHEN c <= 4 THEN 'execution_error' END END AS error_type,
  CASE k WHEN 1 THEN 'tool blocked (missing function)' WHEN 2 THEN 'unknown tool' WHEN 3 THEN 'schema validation failed' WHEN 4 THEN 'tool has no server' WHEN 6 THEN 'unknown tool: ' || tool ELSE CASE WHEN c > 2 THEN 'm' || c ELSE '' END END AS error_message, k > 3 AS schema_valid, k = 8 AND c = 6 AS state_changed FROM w""",
    "cached_graphs": """
WITH p AS (SELECT DISTINCT p_brand AS server, 'get_' || p_type AS source, 't' || (p_partkey % 4) AS target FROM part), g AS (SELECT DISTINCT server, (length(server) + ascii(right(server, 1))) % 4 = 0 AS ours FROM p)
SELECT p.server, source, target, 'implicit' AS relation FROM p JOIN g USING (server) WHERE NOT ours
UNION ALL SELECT server, source, target, relation FROM g, (VALUES ('a', 'b', 'explicit'), ('a', 'c', 'explicit'), ('b', 'a', 'implicit')) v(source, target, relation) WHERE ours""",
}
