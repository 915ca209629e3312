"""Queries and checking SQL of answer grading, action parsing and token arrays."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import answers, arrays, contracts
from weftline.functions import text as tx
from weftline.plans.samples import rounded, table


def _solutions(s, d):
    i = F.col("doc_id").cast("string")
    kinds = (
        F.concat(F.lit("so\nAnswer: "), i, F.lit(" km")), F.concat(F.lit("Answer: x = $"), i, F.lit("$ dollars")), F.concat(F.lit("answer : \\frac"), F.right(i, F.lit(1)), F.lit("2")),
        F.concat(F.lit("\\text{"), i, F.lit("} no line")),
    )
    return table(s, d, "documents").select("doc_id", F.element_at(F.array(*kinds), (F.col("doc_id") % 4 + 1).cast("int")).alias("solution"), F.when(F.col("doc_id") % 3 == 0, F.lit("7")).otherwise(i).alias("truth"))


def dapo_score(s, d):
    return _solutions(s, d).select("doc_id", answers.answer_score(F.col("solution"), F.col("truth")).alias("a")).select("doc_id", "a.*")


def question_score(s, d):
    """Whole texts between answer tags, repeated or not closed, against golds that match or don't."""
    t = F.concat(F.repeat(F.lit("<answer> the "), (F.col("item_id") % 13 + 1).cast("int")), F.col("text"), F.when(F.col("item_id") % 4 == 0, F.lit("")).otherwise(F.lit("</answer>")))
    gold = F.array(F.concat(F.repeat(F.lit("answer "), (F.col("item_id") % 13).cast("int")), F.when(F.col("item_id") % 5 == 0, F.reverse("text")).otherwise(F.col("text"))))
    return table(s, d, "benchmark").select("item_id", answers.question_score(t, gold, wrong=0.1).alias("score"))


def action_parse(s, d):
    i = F.col("event_id").cast("string")
    kinds = (F.concat(F.lit("<tool_call> "), i, F.lit(" </tool_call>")), F.concat(F.lit('{"name": "f'), i, F.lit('"}')), F.concat(F.lit("a plain answer "), i), F.lit("hm"), F.lit(" "))
    e = table(s, d, "events").select("event_id", F.element_at(F.array(*kinds), (F.col("event_id") % 5 + 1).cast("int")).alias("output"))
    return e.select("event_id", answers.parsed_action(F.col("output")).alias("p")).select("event_id", "p.*")


def point_reward(s, d):
    points = F.transform(F.sequence(F.lit(0), (F.col("event_id") % 4).cast("int")), lambda i: F.struct((F.col("value") + i * 10.0).alias("x"), F.lit(1.0).alias("y")))
    return rounded(table(s, d, "events").select("event_id", answers.point_reward(points, F.lit(20.0), F.lit(0.0), F.lit(45.0), F.lit(2.0)).alias("reward")), "reward")


def _ids(s, d):
    return table(s, d, "orders").select("o_orderkey", F.transform(F.sequence(F.lit(0), (F.col("o_orderkey") % 9).cast("int")), lambda i: (F.col("o_orderkey") + i * 3) % 11).alias("ids"))


def response_mask(s, d):
    m = arrays.response_mask(F.col("ids"), 4)
    return _ids(s, d).select("o_orderkey", F.array_join(m, ",").alias("mask"), F.array_join(arrays.positions(m), ",").alias("positions"), F.array_join(arrays.without_padding(F.col("ids"), m), ",").alias("kept"))


def array_fit(s, d):
    c = F.col("ids")
    return _ids(s, d).select("o_orderkey", *[F.array_join(arrays.fitted(c, 5, 0, left, side), ",").alias(side) for left, side in ((True, "left"), (False, "right"), (True, "middle"))])


def uid_parse(s, d):
    uid = F.concat_ws("___", F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderstatus")), F.when(F.col("o_orderkey") % 3 > 1, F.col("o_orderpriority")))
    return table(s, d, "orders").select("o_orderkey", contracts.group_id_parts(uid).alias("p")).select("o_orderkey", "p.*")


#: States of all servers and a criterion of each type and shape, made of an event, in SQL that both engines know.
CRITERIA = """
WITH e AS (SELECT event_id, user_id % 7 AS a, event_id % 5 AS b, user_id % 3 AS c, event_id % 26 AS k FROM events)
SELECT event_id, a, b, c, k,
  '{"shop":{"cart":' || CASE c WHEN 0 THEN '[]' WHEN 1 THEN '[{"product_id":"P1"}]' ELSE 'null' END || ',"orders":{' || CASE WHEN b = 0 THEN '' ELSE '"O1":{"status":"s' || b || '","items":[{"product_id":"P' || a || '"},{"product_id":' || b || '}]}' END || '}},' ||
  '"mail":{"emails":{' || CASE WHEN a = 0 THEN '' ELSE '"M1":{"labels":["x","l' || b || '"]}' END || CASE WHEN a > 3 THEN ',"M2":{}' ELSE '' END || '}},"bank":{"transactions":[' || CASE WHEN c = 1 THEN '1' ELSE '' END || '],"n":' || a || ',"f":' || b || '.0,"t":"' || a || '","y":' || CASE WHEN c = 0 THEN 'true' ELSE 'null' END || '},' ||
  '"fs":{"cwd":"/d' || c || '","fs":{"/a.txt":"x","/f' || b || '":{}}},"crm":{"deals":{"D1":{"lead_id":"L' || c || '"}}},"chat":{"channels":{"C1":{"messages":[' || CASE WHEN b > 2 THEN '"hi","ho"' ELSE '' END || ']}}}}' AS state,
  CASE k WHEN 0 THEN '{"type":"state_equals","server":"bank","path":"n","value":4}' WHEN 1 THEN '{"type":"state_equals","server":"bank","path":"n","value":4,"op":"gt"}' WHEN 2 THEN '{"type":"state_equals","server":"bank","path":"t","value":4,"op":"gt"}'
    WHEN 3 THEN '{"type":"state_equals","server":"bank","path":"t","value":4}' WHEN 4 THEN '{"type":"state_equals","server":"bank","path":"f","value":3,"op":"lte"}' WHEN 5 THEN '{"type":"state_equals","server":"bank","path":"f","value":2}' WHEN 6 THEN '{"type":"state_equals","server":"bank","path":"n","value":3,"op":"lt"}'
    WHEN 7 THEN '{"type":"state_equals","server":"bank","path":"t","value":"2","op":"neq"}' WHEN 8 THEN '{"type":"state_exists","server":"bank","path":"y"}' WHEN 9 THEN '{"type":"state_absent","server":"bank","path":"y"}' WHEN 10 THEN '{"type":"cart_empty","server":"shop"}' WHEN 11 THEN '{"type":"cart_not_empty","server":"shop"}'
    WHEN 12 THEN '{"type":"email_count_gte","server":"mail","value":2}' WHEN 13 THEN '{"type":"order_contains_product","server":"shop","product_id":"P2"}' WHEN 14 THEN '{"type":"order_contains_product","server":"shop","product_id":2}' WHEN 15 THEN '{"type":"missing_function"}'
    WHEN 16 THEN '{"type":"transaction_exists","server":"bank"}' WHEN 17 THEN '{"type":"label_added","server":"mail","email_id":"M1","label":"l3"}' WHEN 18 THEN '{"type":"cwd_equals","server":"fs","path":"/d1"}' WHEN 19 THEN '{"type":"file_exists","server":"fs","path":"/f2"}' WHEN 20 THEN '{"type":"deal_exists_for_lead","server":"crm","lead_id":"L2"}'
    WHEN 21 THEN '{"type":"message_sent","server":"chat","channel_id":"C1"}' WHEN 22 THEN '{"type":"order_exists","server":"shop","status":"s3"}' WHEN 23 THEN '{"type":"order_exists","server":"shop"}' WHEN 24 THEN '{"type":"state_equals","server":"chat","path":"channels.C1.messages_count","value":2,"op":"gte"}' ELSE '{"type":"other","server":"shop"}' END AS criterion
FROM e"""


def criteria(s, d):
    table(s, d, "events").createOrReplaceTempView("_events_of_criteria")
    made = s.sql(CRITERIA.replace("FROM events)", "FROM _events_of_criteria)"))
    return made.select("event_id", contracts.criterion_met(F.col("state"), F.col("criterion")).alias("met"))


def token_amount(s, d):
    c = table(s, d, "conversations").where("role <> 'system'")
    return c.groupBy("conv_id").agg(F.sum(tx.word_count(F.col("text"))).alias("words"), F.max("turn").alias("last_turn"))


QUERIES = {f.__name__: f for f in (dapo_score, question_score, action_parse, point_reward, response_mask, array_fit, uid_parse, criteria, token_amount)}


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


# Fixed values of the grading's definition, stated here on their own so that the check doesn't read the code under test.
_REPLACED = (("an ", ""), ("a ", ""), (".$", "$"), ("\\$", ""), ("\\ ", ""), (" ", ""), ("mbox", "text"), (",\\text{and}", ","), ("\\text{and}", ","), ("\\text{m}", "\\text{}"))
_GONE = (
    "square", "ways", "integers", "dollars", "mph", "inches", "hours", "km", "units", "\\ldots", "sue", "points", "feet", "minutes", "digits", "cents", "degrees", "cm", "gm", "pounds", "meters",
    "meals", "edges", "students", "childrentickets", "multiples", "\\text{s}", "\\text{.}", "\\text{\ns}", "\\text{}^2", "\\text{}^3", "\\text{\n}", "\\text{}", "\\mathrm{th}", "^\\circ",
    "^{\\circ}", "\\;", ",\\!", "{,}", '"', "\\dots",
)


def _normal_sql(x: str) -> str:
    x = f"string_split({x}, '=')[-1]"
    for a, b in (*_REPLACED, *((r, "") for r in _GONE)):
        x = f"replace({x}, {_quoted(a)}, {_quoted(b)})"
    for pattern, to in (
        (r"(.*?)(\$)(.*?)(\$)(.*)", r"$\3$"), (r"(\\text\{)(.*?)(\})", r"\2"), (r"(\\textbf\{)(.*?)(\})", r"\2"), (r"(\\overline\{)(.*?)(\})", r"\2"),
        (r"(\\boxed\{)(.*)(\})", r"\2"), (r"(frac)([^{])(.)", r"frac{\2}{\3}"), (r"(sqrt)([^{])", r"sqrt{\2}"),
    ):
        x = f"regexp_replace({x}, {_quoted(pattern)}, {_quoted(to)}, 'g')"
    return f"trim(list_transform([replace({x}, '$', '')], lambda z: CASE WHEN regexp_full_match(replace(z, ',', ''), '\\d+') THEN replace(z, ',', '') ELSE z END)[1])"


_IDS = "i AS (SELECT o_orderkey, list_transform(range(0, o_orderkey % 9 + 1), lambda k: (o_orderkey + k * 3) % 11) AS ids FROM orders)"
_FIT = "array_to_string(CASE WHEN len(ids) < 5 THEN {} ELSE {} END, ',')"
ORACLE_SQL = {
    "dapo_score": f"""WITH t AS (SELECT doc_id, ['so' || chr(10) || 'Answer: ' || doc_id || ' km', 'Answer: x = $' || doc_id || '$ dollars', 'answer : \\frac' || right(doc_id::VARCHAR, 1) || '2', '\\text{{' || doc_id || '}} no line'][doc_id % 4 + 1] AS t,
        CASE WHEN doc_id % 3 = 0 THEN '7' ELSE doc_id::VARCHAR END AS truth FROM documents),
      p AS (SELECT doc_id, coalesce(regexp_extract_all(t, '(?i)Answer\\s*:\\s*([^\\n]+)', 1)[-1], '[INVALID]') AS e, truth FROM t),
      n AS (SELECT doc_id, {_normal_sql('e')} AS pred, {_normal_sql('truth')} AS truth FROM p)
      SELECT doc_id, CASE WHEN pred = truth THEN 1.0 ELSE -1.0 END::DOUBLE AS score, pred = truth AS acc, pred FROM n""",
    "question_score": "SELECT item_id, CASE WHEN item_id % 4 = 0 THEN 0.0 WHEN item_id % 5 = 0 THEN 0.1 WHEN item_id % 13 + 1 > 10 THEN 0.25 ELSE 1.0 END::DOUBLE AS score FROM benchmark",
    "action_parse": """SELECT event_id, ['tool_call', 'tool_call', 'final_answer', 'unparseable', 'unparseable'][event_id % 5 + 1] AS action_type,
      [event_id::VARCHAR, '{"name": "f' || event_id || '"}', 'a plain answer ' || event_id, 'hm', ''][event_id % 5 + 1] AS content FROM events""",
    "point_reward": """WITH r AS (SELECT event_id, (event_id % 4 + 1)::INT AS n, list_position(list_transform(range(0, event_id % 4 + 1), lambda i: value + i * 10.0::DOUBLE BETWEEN 20 AND 45), true) AS k FROM events)
      SELECT event_id, round(CASE WHEN k > 0 THEN 1 / sqrt(n * k) ELSE -1.0::DOUBLE / n END, 6) + 0.0 AS reward FROM r""",
    "response_mask": f"""WITH {_IDS}, m AS (SELECT o_orderkey, ids, list_transform(ids, lambda x, k: (coalesce(list_position(ids, 4), 0) = 0 OR k <= list_position(ids, 4))::INT) AS m FROM i)
      SELECT o_orderkey, array_to_string(m, ',') AS mask, array_to_string(list_transform(m, lambda x, k: greatest(list_sum(m[1:k]) - 1, 0)::INT), ',') AS positions, array_to_string(ids[len(ids) - list_sum(m)::INT + 1 :], ',') AS kept FROM m""",
    "array_fit": f"""WITH {_IDS}, p AS (SELECT *, list_transform(range(0, greatest(5 - len(ids), 0)), lambda x: 0::BIGINT) AS pad FROM i)
      SELECT o_orderkey, {_FIT.format('list_concat(pad, ids)', 'ids[-5:]')} AS "left", {_FIT.format('list_concat(ids, pad)', 'ids[1:5]')} AS "right",
        {_FIT.format('list_concat(pad, ids)', 'CASE WHEN len(ids) = 5 THEN ids ELSE list_concat(ids[1:2], ids[-3:]) END')} AS middle FROM p""",
    "uid_parse": "SELECT o_orderkey, o_orderkey::VARCHAR AS task, CASE WHEN o_orderkey % 3 > 0 THEN o_orderstatus ELSE 'complete' END AS level, CASE WHEN o_orderkey % 3 > 1 THEN o_orderpriority ELSE 'normal_safe_success' END AS scenario FROM orders",
    "criteria": f"""
WITH m AS ({CRITERIA})
SELECT event_id, CASE k WHEN 0 THEN a = 4 WHEN 1 THEN a > 4 WHEN 2 THEN false WHEN 3 THEN false WHEN 4 THEN b <= 3 WHEN 5 THEN b = 2 WHEN 6 THEN a < 3 WHEN 7 THEN a <> 2 WHEN 8 THEN c = 0 WHEN 9 THEN c > 0 WHEN 10 THEN c = 0 WHEN 11 THEN c = 1 WHEN 12 THEN a > 3
  WHEN 13 THEN b > 0 AND a = 2 WHEN 14 THEN b = 2 WHEN 15 THEN true WHEN 16 THEN c = 1 WHEN 17 THEN a > 0 AND b = 3 WHEN 18 THEN c = 1 WHEN 19 THEN b = 2 WHEN 20 THEN c = 2 WHEN 21 THEN b > 2 WHEN 22 THEN b = 3 WHEN 23 THEN b > 0 WHEN 24 THEN b > 2 ELSE false END AS met FROM m""",
    "token_amount": "SELECT conv_id, sum(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')))::BIGINT AS words, max(turn) AS last_turn FROM conversations WHERE role <> 'system' GROUP BY conv_id",
}
