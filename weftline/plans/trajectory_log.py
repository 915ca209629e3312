"""Audited sessions made of the events table, in the shape of operators.verdicts, and the same in SQL.

Five events of a user in a row are a session. The kind of an event decides its tool,
the number in its properties the ids, arguments and marks, so that every rule is
both kept and broken by many sessions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.plans.samples import table


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").withColumns({"i": F.row_number().over(w) - 1, "k": F.get_json_object("props", "$.k").cast("int")})
    kind = F.col("event_type")
    e = e.withColumns({"step": F.col("i") % 5, "ends": (F.col("i") % 5 == 4) & (F.col("k") % 4 != 0), "rid": F.concat(F.lit("r"), (F.col("k") % 10).cast("string"))})
    tool = F.when(F.col("ends"), "").when(kind == "view", "get_order").when(kind == "click", "list_items").when(kind == "signup", "create_order").when(kind == "purchase", "update_order").otherwise("delete_order")
    operation = F.when(F.col("ends"), "terminal").when(kind.isin("view", "click"), "query").when(kind == "signup", "create").when(kind == "purchase", "update").otherwise("delete")
    number = F.col("k").cast("string")
    base = F.when(F.col("ends"), F.array().cast("array<struct<key:string,value:string>>")).when(kind == "click", F.array(F.struct(F.lit("page").alias("key"), number.alias("value")))).when(
        kind.isin("signup", "purchase"), F.array(F.struct(F.lit("order_id").alias("key"), F.col("rid").alias("value")), F.struct(F.lit("note").alias("key"), F.concat(F.lit("n"), number).alias("value")))
    ).otherwise(F.array(F.struct(F.lit("order_id").alias("key"), F.col("rid").alias("value"))))
    secret = F.when((F.col("k") % 25 == 0) & ~F.col("ends"), F.array(F.struct(F.lit("api_token").alias("key"), F.concat(F.lit("t"), number).alias("value")))).otherwise(F.array().cast("array<struct<key:string,value:string>>"))
    only = lambda op, c: F.when(~F.col("ends") & (kind == op), F.array(c)).otherwise(F.array().cast("array<string>"))
    return e.select(
        (F.col("user_id") * 1000 + F.floor(F.col("i") / 5)).alias("session"), "step", "event_id", F.when(F.col("ends"), "final_answer").otherwise("tool_call").alias("action_type"),
        tool.alias("tool_name"), F.map_from_entries(F.concat(base, secret)).alias("arguments"), operation.alias("operation"), F.when(F.col("ends"), "").otherwise(F.col("rid")).alias("target_id"),
        only("signup", F.col("rid")).alias("created_ids"), only("error", F.col("rid")).alias("deleted_ids"), only("purchase", F.concat(F.lit("f"), (F.col("k") % 4).cast("string"))).alias("changed_fields"),
        F.when(F.col("k") == 99, "e1").otherwise("").alias("duplicate_of"), F.when(F.col("k") == 98, "owner").otherwise("").alias("identity_violation"), F.when(F.col("k") == 97, "skip").otherwise("").alias("forbidden_transition"),
        F.when(~F.col("ends") & kind.isin("view", "click"), F.concat(F.lit("seen t"), (F.col("k") - F.col("k") % 5).cast("string"))).alias("observation"),
        (F.col("value") >= 10).alias("execution_success"), (F.col("k") % 7 != 0).alias("schema_valid"),
    )


def session_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = lambda *xs: F.array(*[F.lit(x) for x in xs])
    call = lambda tool, **a: F.struct(F.lit(tool).alias("tool_name"), F.create_map(*[F.lit(x) for k, v in a.items() for x in (k, v)]).alias("arguments"))
    goal = lambda kind, path, value: F.struct(F.lit(kind).alias("type"), F.lit(path).alias("path"), F.lit(value).alias("value"))
    s = event_log(spark, sf_dir).select("session").distinct()
    n = F.col("session") % 10
    idle = n == 0
    need = F.array(call("get_order", order_id="r1"), call("create_order", order_id="R2 ", note="n5"), call("update_order", order_id="r3"))
    return s.select(
        "session", F.when(idle, F.slice(need, 1, 0)).otherwise(need).alias("required"), F.when(idle, words().cast("array<string>")).otherwise(words("get_order", "create_order", "update_order")).alias("required_names"),
        words("r0", "r1", "r2", "r3", "r4", "r5", "r6", "r7").alias("target_ids"), words("r6").alias("protected"), words("f3").alias("protected_fields"),
        F.create_map(F.lit("r1"), words("f1"), F.lit("r2"), words("f0", "f2")).alias("protected_by_resource"), F.when(n % 2 == 0, "preserve").otherwise("domain_defined").alias("identity_policy"),
        words("final_answer").alias("allowed_terminals"), F.lit("please use t50").alias("user_query"),
        F.array(goal("state_exists", "orders.r1", None), goal("state_absent", "orders.r4", None), goal("state_equals", "orders.r2.status", "open")).alias("criteria"),
        F.when(n < 8, F.create_map(F.lit("orders.r9.status"), F.lit("open"), F.concat(F.lit("orders.r"), (F.lit(2) + n % 3).cast("string"), F.lit(".status")), F.when(n < 5, "open").otherwise("closed"))).alias("final_state"),
    )


LOG_SQL = """
x AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, (props->>'$.k')::INT AS k FROM events),
y AS (SELECT *, (i % 5)::INT AS step, i % 5 = 4 AND k % 4 <> 0 AS ends, 'r' || (k % 10) AS rid, user_id * 1000 + i // 5 AS session FROM x),
lg AS (
  SELECT session, step, event_id, k, CASE WHEN ends THEN 'final_answer' ELSE 'tool_call' END AS action_type,
    CASE WHEN ends THEN '' WHEN event_type = 'view' THEN 'get_order' WHEN event_type = 'click' THEN 'list_items' WHEN event_type = 'signup' THEN 'create_order' WHEN event_type = 'purchase' THEN 'update_order' ELSE 'delete_order' END AS tool,
    CASE WHEN ends THEN 'terminal' WHEN event_type IN ('view', 'click') THEN 'query' WHEN event_type = 'signup' THEN 'create' WHEN event_type = 'purchase' THEN 'update' ELSE 'delete' END AS op,
    CASE WHEN ends THEN '' ELSE rid END AS target, value >= 10 AS ok, k % 7 <> 0 AS fits,
    CASE WHEN NOT ends AND event_type <> 'click' THEN rid END AS order_id, CASE WHEN NOT ends AND event_type IN ('signup', 'purchase') THEN 'n' || k END AS note,
    CASE WHEN NOT ends AND event_type = 'click' THEN k END AS page, CASE WHEN NOT ends AND k % 25 = 0 THEN 't' || k END AS token,
    CASE WHEN NOT ends AND event_type IN ('view', 'click') THEN 'seen t' || (k - k % 5) END AS seen, session % 10 AS n FROM y)"""
