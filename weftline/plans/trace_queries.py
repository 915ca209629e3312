"""Queries and checking SQL of call traces and of draws with replacement."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import draws, sampling, traces
from weftline.plans.samples import SAMPLES_SQL, rounded, samples, table

#: Tasks of an order each: its line items are calls, the customer's segment the domain. Numbers are cut small, so that traces repeat and come near each other.
_ARGS = """CASE WHEN l_linenumber = 6 THEN 'no json' WHEN l_linenumber = 5 THEN '{"b":{"y":"' || l_returnflag || '","x":[1, 2]},"a":' || (l_partkey % 2) || '}' ELSE '{"id":"r' || (l_orderkey % 5) || '","flag": "' || l_returnflag || ',:\\"' || '","n":' || (l_linenumber % 2 * (l_suppkey % 2)) || '}' END"""


def _tasks(s, d):
    args = F.expr(_ARGS.replace("\\", "\\\\"))
    items = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.when(F.col("l_orderkey") % 11 == 0, "final_answer").when(F.col("l_linenumber") % 2 == 0, None).otherwise("tool_call").alias("action"),
        F.concat(F.lit("get_"), F.lower("l_linestatus")).alias("tool_name"), args.alias("arguments"))
    call = F.struct("l_linenumber", "l_partkey", "l_suppkey", "action", "tool_name", "arguments")
    calls = items.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(call)), lambda c: F.struct(c["action"].alias("action"), c["tool_name"].alias("tool_name"), c["arguments"].alias("arguments"))).alias("calls"))
    o = table(s, d, "orders").select("o_orderkey", F.concat(F.lit("d"), (F.col("o_custkey") % 5).cast("string")).alias("domain"), F.concat(F.lit("  Find "), F.lower("o_orderpriority"), F.lit(' \t"NOW"  ')).alias("query"), F.col("o_orderstatus").alias("scenario"))
    t = o.join(calls, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    original = F.when(F.col("o_orderkey") % 22 == 0, F.array(F.struct(F.lit("tool_call").alias("action"), F.lit("lost").alias("tool_name"), F.lit('{"k":null}').alias("arguments"))))
    return t.select("o_orderkey", "domain", "query", "scenario", "calls", original.alias("original")).withColumn("signature", traces.signatures(F.col("calls"), F.col("original")))


def trace_signatures(s, d):
    return _tasks(s, d).select("o_orderkey", F.size("signature").alias("calls"), F.md5(F.array_join("signature", "\x1d")).alias("signature"))


def trace_dedup(s, d):
    """The greedy scan at 0.70 within a domain, over all tasks."""
    return traces.without_similar(_tasks(s, d), "o_orderkey", "domain", "signature").select("o_orderkey", "domain")


def task_identities(s, d):
    """How many tasks have one identity, and the first of them."""
    t = _tasks(s, d).withColumn("identity", traces.fingerprint(F.col("domain"), F.col("scenario"), F.col("query"), F.slice("calls", 1, 1)))
    return traces.audited(t, "o_orderkey", "identity")


def bootstrap_at_n(s, d):
    """Balances of a nation's customers, the segment as prediction: seeded bootstrap of best, worst and majority."""
    c = table(s, d, "customer").select("c_nationkey", "c_acctbal", "c_mktsegment", "c_custkey")
    out = draws.bootstrap(c, "c_nationkey", "c_acctbal", "c_mktsegment", "c_custkey")
    return rounded(out, "best", "best_std", "worst", "worst_std", "maj", "maj_std", digits=6)


def pf_multinomial(s, d):
    """As many rows as there are, drawn by the square of their score."""
    df = sampling.reweighted(samples(s, d).select("uid", "pos", (F.col("score") / 1e4).alias("score")), "score", "pow", 2.0)
    return draws.multinomial(df, "weight", ["uid", "pos"], 42).select("uid", "pos", "copies")


QUERIES = {f.__name__: f for f in (trace_signatures, trace_dedup, task_identities, bootstrap_at_n, pf_multinomial)}

_TASKS_SQL = f"""
it AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_orderkey % 11 <> 0 AS is_call, 'get_' || lower(l_linestatus) AS tool, {_ARGS} AS arguments FROM lineitem),
pt AS (
  SELECT *, CASE WHEN l_linenumber = 6 THEN '' WHEN l_linenumber = 5 THEN 'a=' || (l_partkey % 2) || chr(31) || 'b={{"x":[1,2],"y":"' || l_returnflag || '"}}'
    ELSE 'flag=' || l_returnflag || ',:"' || chr(31) || 'id=r' || (l_orderkey % 5) || chr(31) || 'n=' || (l_linenumber % 2 * (l_suppkey % 2)) END AS pairs,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, tool, arguments) - 1 AS i FROM it),
tk AS (
  SELECT o_orderkey, 'd' || (o_custkey % 5) AS domain, CASE WHEN any_value(l_orderkey) IS NOT NULL AND o_orderkey % 11 <> 0 THEN list(i || chr(30) || tool || chr(30) || pairs ORDER BY i) WHEN o_orderkey % 22 = 0 THEN ['0' || chr(30) || 'lost' || chr(30) || 'k=null'] ELSE [] END AS sig
  FROM orders LEFT JOIN pt ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_custkey)"""

ORACLE_SQL = {
    "trace_signatures": f"WITH {_TASKS_SQL} SELECT o_orderkey, len(sig)::INT AS calls, md5(array_to_string(sig, chr(29))) AS signature FROM tk",
    # equal traces first, as they always go; then the scan over the rest, domain by domain
    "trace_dedup": f"""
WITH RECURSIVE {_TASKS_SQL},
u AS MATERIALIZED (SELECT domain, sig, min(o_orderkey) AS k FROM tk WHERE len(sig) > 0 GROUP BY domain, sig),
tok AS MATERIALIZED (SELECT domain, k, len(sig) AS n, unnest(sig) AS t FROM u),
p AS MATERIALIZED (SELECT a.domain, a.k AS a, b.k AS b FROM tok a JOIN tok b ON a.domain = b.domain AND a.t = b.t AND a.k < b.k GROUP BY a.domain, a.k, b.k, a.n, b.n HAVING count(*) >= 0.7 * (a.n + b.n - count(*))),
e AS (SELECT domain, b, list(a) AS earlier FROM p GROUP BY domain, b),
q AS MATERIALIZED (SELECT domain, k, row_number() OVER (PARTITION BY domain ORDER BY k) AS i, earlier FROM (SELECT u.domain, k, coalesce(earlier, []) AS earlier FROM u LEFT JOIN e ON e.b = k AND e.domain = u.domain)),
open AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY i) AS j FROM q WHERE k IN (SELECT a FROM p UNION SELECT b FROM p)),
r AS (
  SELECT DISTINCT domain, 0::BIGINT AS j, []::BIGINT[] AS kept FROM open
  UNION ALL
  SELECT r.domain, o.j, CASE WHEN list_has_any(r.kept, o.earlier) THEN r.kept ELSE list_append(r.kept, o.k) END FROM r JOIN open o ON o.domain = r.domain AND o.j = r.j + 1)
SELECT k AS o_orderkey, domain FROM q WHERE k NOT IN (SELECT k FROM open)
UNION ALL
SELECT unnest(kept), domain FROM (SELECT domain, kept FROM r QUALIFY j = max(j) OVER (PARTITION BY domain))
UNION ALL
SELECT o_orderkey, domain FROM tk WHERE len(sig) = 0""",
    "task_identities": f"""
WITH {_TASKS_SQL},
f AS (SELECT l_orderkey, arg_min(struct_pack(ok := is_call OR l_linenumber < 0, tool := tool, a := CASE WHEN l_linenumber = 6 THEN '{{}}' WHEN l_linenumber = 5 THEN '{{"a": ' || (l_partkey % 2) || ', "b": {{"x": [1, 2], "y": "' || l_returnflag || '"}}}}'
    ELSE '{{"flag": "' || l_returnflag || ',:\\"", "id": "r' || (l_orderkey % 5) || '", "n": ' || (l_linenumber % 2 * (l_suppkey % 2)) || '}}' END), i) AS c FROM (SELECT pt.* FROM pt) GROUP BY l_orderkey),
g AS (SELECT o_orderkey, sha256('{{"calls": [' || CASE WHEN c.ok THEN '{{"arguments": ' || c.a || ', "tool_name": "' || c.tool || '"}}' ELSE '' END || '], "domain": "d' || (o_custkey % 5) || '", "query": "find ' || lower(o_orderpriority) || ' \\"now\\"", "scenario": "' || o_orderstatus || '"}}') AS identity
  FROM orders LEFT JOIN f ON l_orderkey = o_orderkey)
SELECT identity, count(*) AS tasks, min(o_orderkey) AS first FROM g GROUP BY identity""",
    "bootstrap_at_n": """
WITH s AS (SELECT c_nationkey AS u, c_acctbal AS x, c_mktsegment AS p, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS k, count(*) OVER (PARTITION BY c_nationkey) AS n_all FROM customer),
z AS (SELECT u, n_all, unnest(list_append(list_filter([2, 4, 8, 16, 32, 64, 128, 256, 512, 1024, 2048], lambda y: y < n_all), n_all)) AS n FROM (SELECT DISTINCT u, n_all FROM s WHERE n_all > 1)),
d AS (SELECT u, n, n_all, r, unnest(range(0, n)) AS i FROM (SELECT *, unnest(range(1, 1001)) AS r FROM z)),
k AS (SELECT u, n, r, i, floor(('0x' || left(md5('42:' || u || ':' || n || ':' || r || ':' || i), 13))::BIGINT / 4503599627370496.0::DOUBLE * n_all)::BIGINT AS k FROM d),
g AS (SELECT k.u, n, r, i, x, p FROM k JOIN s ON s.u = k.u AND s.k = k.k),
v AS (SELECT u, n, r, p, count(*) AS votes, min(i) AS first_at, arg_min(x, i) AS x, max(x) AS hi, min(x) AS lo FROM g GROUP BY u, n, r, p),
o AS (SELECT u, n, r, max(hi) AS best, min(lo) AS worst, arg_max(x, votes * 1000000 - first_at) AS maj FROM v GROUP BY u, n, r)
SELECT u AS c_nationkey, n, round(avg(best), 6) + 0.0 AS best, round(stddev_pop(best), 6) + 0.0 AS best_std, round(avg(worst), 6) + 0.0 AS worst, round(stddev_pop(worst), 6) + 0.0 AS worst_std,
  round(avg(maj), 6) + 0.0 AS maj, round(stddev_pop(maj), 6) + 0.0 AS maj_std FROM o GROUP BY u, n""",
}
