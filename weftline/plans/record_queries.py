"""Queries and checking SQL of decoded logs, resolved tasks and records."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from weftline.operators import records
from weftline.plans.samples import rounded, table
from weftline.plans.trajectory_log import LOG_SQL, event_log
from weftline.session import checkpoint_folder


def decoded_events(s, d):
    """Sessions packed as JSON lists, some of them broken, and decoded again with defaults."""
    item = F.to_json(F.struct(F.col("event_id").cast("string").alias("event_id"), F.col("step").alias("step_index"), "tool_name", F.col("arguments").alias("tool_arguments"), F.when(F.col("step") % 2 == 0, F.col("execution_success")).alias("execution_success"), "created_ids"))
    rows = event_log(s, d).groupBy("session").agg(F.array_sort(F.collect_list(F.struct("step", item.alias("j")))).alias("e"))
    raw = F.concat(F.lit("["), F.array_join(F.transform("e", lambda x: x["j"]), ","), F.when(F.col("session") % 10 == 3, "").when(F.col("session") % 10 == 4, ",7]").otherwise("]"))
    out = records.decoded_events(rows.select("session", raw.alias("raw")), "raw", ["session"])
    return out.select("session", "nth", "event_id", "step", "tool_name", F.size("arguments").alias("arguments"), "execution_success", F.size("created_ids").alias("created"), "latency_ms")


def promoted_columns(s, d):
    o = table(s, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 > 0, F.create_map(F.lit("uid"), F.concat(F.lit("u"), F.col("o_orderkey").cast("string")), F.lit("level"), F.col("o_orderpriority"))).alias("info"), F.col("o_orderstatus").alias("scenario_type"))
    name = F.coalesce(F.try_element_at("info", F.lit("uid")), F.concat(F.lit("unk_"), F.col("o_orderkey").cast("string")))
    return records.promoted(o, "info", {"episode_id": name, "level": F.lit("none"), "scenario_type": F.lit("single_step")}).drop("info")


def generic_targets(s, d):
    k = F.col("event_id") % 5
    some = F.create_map().cast("map<string,string>")
    args = F.when(k == 0, F.create_map(F.lit("note"), F.lit("x"), F.lit("Order_ID"), F.col("event_type"))).when(k == 1, F.create_map(F.lit("path"), F.concat(F.lit("/"), F.col("event_type")))).when(k == 2, F.create_map(F.lit("path"), F.lit(""), F.lit("to_account"), F.lit("a1"))).otherwise(some)
    seen = F.when(k == 3, F.create_map(F.lit("n"), F.lit("1"), F.lit("thread_id"), F.lit("t9"))).otherwise(some)
    return table(s, d, "events").select("event_id", records.generic_target(args, seen).alias("target"))


def resolved_tasks(s, d):
    from weftline.plans.task_queries import _packed

    t = _packed(s, d).withColumns({"required_tools": F.array(F.lit("get_order")), "allowed": F.when(F.col("task") % 7 == 0, F.array(F.lit("report_error"), F.lit("final_answer"))), "calls": F.when(F.col("task") % 13 == 0, F.slice("calls", F.lit(1), F.lit(0))).otherwise(F.col("calls"))})
    t = t.withColumn("calls", F.when(F.col("task") % 11 == 0, F.transform(F.slice("calls", F.lit(1), F.lit(1)), lambda c: F.struct(c["tool_name"].alias("tool_name"), c["arguments"].alias("arguments"), F.lit("clarification").alias("action")))).otherwise(F.col("calls")))
    out = records.resolved_tasks(t)
    return out.select("task", F.array_join(F.transform("required", lambda r: r["tool_name"]), ",").alias("required"), F.array_join("allowed_terminals", ",").alias("allowed"))


def domain_criteria(s, d):
    o = table(s, d, "orders").withColumns({"task": F.col("o_orderkey") % 100, "k": F.col("o_orderkey") % 5})
    container = F.element_at(F.array(*map(F.lit, ("orders", "accounts", "emails", "fs", "cart"))), (F.col("k") + 1).cast("int"))
    field = F.when(F.col("k") == 1, "balance").otherwise("status")
    states = o.select("task", container.alias("container"), F.col("o_orderkey").cast("string").alias("entity"), field.alias("field"), F.col("o_orderstatus").alias("value"), "o_totalprice", "o_orderkey")
    before = states.where("o_orderkey % 3 <> 0").select("task", "container", "entity", "field", "value")
    after = states.select("task", "container", "entity", "field", F.when(F.col("o_totalprice") > 250000, "X").otherwise(F.col("value")).alias("value"))
    names = F.filter(F.array(F.when(F.col("task") % 2 == 0, F.lit("create_order")), F.when(F.col("task") % 3 == 0, F.lit("transfer")), F.when(F.col("task") % 4 == 0, F.lit("send_email")), F.when(F.col("task") % 5 == 0, F.lit("mkdir")), F.when(F.col("task") % 7 == 0, F.lit("add_to_cart"))), lambda x: x.isNotNull())
    tools = o.select("task").distinct().select("task", F.explode(names).alias("tool_name"))
    return records.domain_criteria(tools, before, after)


def merged_metadata(s, d):
    o = table(s, d, "orders")
    return records.merged_or_error(o.where("o_orderkey % 3 < 2").select("o_orderkey", "o_orderstatus"), o.where("o_orderkey % 3 > 0").select("o_orderkey", F.when(F.col("o_totalprice") > 300000, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus")), "o_orderkey", "o_orderstatus")


def merged_rollouts(s, d):
    stats = table(s, d, "events").where("event_id % 3 > 0").select((F.floor(F.col("event_id") / 3)).alias("item_id"), (F.col("event_id") % 3).cast("int").alias("rollout"), "value")
    return records.merged_rollouts(table(s, d, "benchmark").select("item_id"), stats, "item_id", 3)


def experiment_record(s, d):
    docs = table(s, d, "documents").select("doc_id", "lang", F.concat(F.lit("k"), (F.col("doc_id") % 2).cast("string")).alias("kind"))
    return rounded(records.experiment_record(docs.where("doc_id % 10 > 0"), docs.where("doc_id % 10 = 0"), "lang", "kind", 2000), "yield")


def trace_documents(s, d):
    path = f"{checkpoint_folder(s)}/traces-{uuid.uuid4().hex}"
    t = event_log(s, d).select((F.col("session") % 10).alias("task"), "session", "step", "tool_name", "execution_success")
    traces = t.groupBy("task", "session").agg(F.array_sort(F.collect_list(F.struct("step", "tool_name", "execution_success"))).alias("turns"))
    records.write_traces(traces, path, "task")
    back = s.read.schema("task long, session long, turns array<struct<step:int,tool_name:string,execution_success:boolean>>").json(path)
    return back.groupBy("task").agg(F.count(F.lit(1)).alias("traces"), F.sum(F.size("turns")).alias("turns"), F.sum(F.size(F.filter("turns", lambda x: ~x["execution_success"]))).alias("errors"))


QUERIES = {f.__name__: f for f in (
    decoded_events, promoted_columns, generic_targets, resolved_tasks, domain_criteria, merged_metadata, merged_rollouts, experiment_record, trace_documents,
)}

ORACLE_SQL = {
    "decoded_events": f"""WITH {LOG_SQL}, r AS (SELECT *, (row_number() OVER (PARTITION BY session ORDER BY step) - 1)::INT AS nth FROM lg)
      SELECT session, nth, event_id::VARCHAR AS event_id, step, tool AS tool_name, ((order_id IS NOT NULL)::INT + (note IS NOT NULL)::INT + (page IS NOT NULL)::INT + (token IS NOT NULL)::INT) AS arguments,
        CASE WHEN step % 2 = 0 THEN ok ELSE false END AS execution_success, (op = 'create')::INT AS created, 0 AS latency_ms FROM r WHERE n <> 3""",
    "promoted_columns": "SELECT o_orderkey, o_orderstatus AS scenario_type, CASE WHEN o_orderkey % 3 > 0 THEN 'u' ELSE 'unk_' END || o_orderkey AS episode_id, CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority ELSE 'none' END AS level FROM orders",
    "generic_targets": "SELECT event_id, CASE event_id % 5 WHEN 0 THEN event_type WHEN 1 THEN '/' || event_type WHEN 2 THEN 'a1' WHEN 3 THEN 't9' ELSE '' END AS target FROM events",
    "resolved_tasks": f"""WITH {LOG_SQL}, ca AS (SELECT session AS task, step, action_type, tool FROM lg WHERE NOT (action_type <> 'tool_call' AND session % 10 = 7)),
      t AS (SELECT task, string_agg(tool, ',' ORDER BY step) FILTER (action_type = 'tool_call') AS tools, count(*) FILTER (action_type <> 'tool_call') > 0 AS ended, task % 10 = 0 OR task % 10 < 2 AS abst, task % 13 = 0 AS empty, task % 11 = 0 AND task % 13 <> 0 AS asks FROM ca GROUP BY task)
      SELECT task, CASE WHEN abst THEN '' WHEN NOT empty AND NOT asks AND tools IS NOT NULL THEN tools WHEN asks THEN '' ELSE 'get_order' END AS required,
        CASE WHEN task % 7 = 0 THEN 'report_error,final_answer' WHEN asks THEN 'ask_clarification' WHEN NOT empty AND ended THEN 'final_answer' WHEN abst THEN 'report_error' ELSE 'final_answer' END AS allowed FROM t""",
    "domain_criteria": """WITH o AS (SELECT o_orderkey % 100 AS task, o_orderkey % 5 AS k, o_orderkey AS e, o_orderstatus AS was, CASE WHEN o_totalprice > 250000 THEN 'X' ELSE o_orderstatus END AS now, o_orderkey % 3 <> 0 AS old FROM orders), c AS (SELECT * FROM o WHERE NOT old OR was <> now)
      SELECT task, 'state_equals' AS type, 'orders.' || e || '.status' AS path, now AS value FROM c WHERE k = 0 AND task % 2 = 0 UNION ALL SELECT task, 'state_equals', 'accounts.' || e || '.balance', now FROM c WHERE k = 1 AND task % 3 = 0
      UNION ALL SELECT task, 'email_count_gte', '', count(*)::VARCHAR FROM o WHERE k = 2 AND task % 4 = 0 GROUP BY task UNION ALL SELECT task, 'file_exists', e::VARCHAR, NULL FROM o WHERE k = 3 AND task % 5 = 0 AND NOT old
      UNION ALL SELECT DISTINCT task, 'cart_not_empty', '', NULL FROM o WHERE k = 4 AND task % 7 = 0""",
    "merged_metadata": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 AND o_totalprice > 300000 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 3 = 1 AND o_totalprice > 300000 THEN 'conflict' END AS error FROM orders",
    "merged_rollouts": "SELECT b.item_id, r.k::INT AS rollout, e.value FROM benchmark b CROSS JOIN range(3) r(k) LEFT JOIN events e ON e.event_id = b.item_id * 3 + r.k AND r.k > 0",
    "experiment_record": """WITH l AS (SELECT '{' || string_agg('"' || lang || '":' || n, ',' ORDER BY lang) || '}' AS langs FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang)), k AS (SELECT '{"k0":' || sum((doc_id % 2 = 0)::INT) || ',"k1":' || sum((doc_id % 2 = 1)::INT) || '}' AS kinds FROM documents)
      SELECT sum((doc_id % 10 > 0)::INT)::BIGINT AS train, sum((doc_id % 10 = 0)::INT)::BIGINT AS val, any_value(langs) AS langs, any_value(kinds) AS kinds, round(count(*) / 2000, 6) + 0.0 AS "yield" FROM documents, l, k""",
    "trace_documents": f"WITH {LOG_SQL} SELECT n AS task, count(DISTINCT session) AS traces, count(*) AS turns, sum((NOT ok)::INT)::BIGINT AS errors FROM lg GROUP BY n",
}
