"""Queries and checking SQL of line tools, entity tables and listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import entities, textfiles
from weftline.plans.samples import rounded, table


def _files(s, d):
    return table(s, d, "documents").select(F.concat("lang", F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), "doc_id", F.col("text").alias("content"))


def file_head_tail(s, d):
    c = F.col("content")
    return _files(s, d).select("doc_id", F.md5(textfiles.head(c, 3)).alias("head"), F.md5(textfiles.tail(c, 2)).alias("tail"))


def file_counts(s, d):
    return _files(s, d).select("doc_id", textfiles.counts(F.col("content")).alias("c")).select("doc_id", "c.*")


def file_grep(s, d):
    shown = F.transform("hits", lambda h: F.concat_ws(":", h["line_no"], h["line"]))
    return textfiles.grep(_files(s, d), "the ").select("path", "count", F.size("hits").alias("shown"), F.md5(F.array_join(shown, "\n")).alias("hits"))


def file_sort(s, d):
    c = F.col("content")
    return _files(s, d).select("doc_id", F.md5(textfiles.sorted_lines(c)).alias("up"), F.md5(textfiles.sorted_lines(c, reverse=True, unique=True)).alias("down"))


def file_cut_awk(s, d):
    return _files(s, d).select("doc_id", F.md5(textfiles.field(F.col("content"), 2)).alias("second"), F.md5(textfiles.field(F.col("content"), 1, ",")).alias("first"))


def file_sed(s, d):
    return _files(s, d).select("doc_id", F.md5(textfiles.substituted(F.col("content"), "[aeiou]+", "_")).alias("text"))


def file_digests(s, d):
    return _files(s, d).select("doc_id", F.md5("content").alias("md5"), F.sha2("content", 256).alias("sha256"), F.md5(textfiles.hex_rows(F.col("content"))).alias("xxd"))


def file_usage(s, d):
    return textfiles.usage(_files(s, d), 2)


def file_diff(s, d):
    a = _files(s, d).select(F.col("doc_id").alias("path"), "content")
    b = a.withColumn("content", F.concat(F.regexp_replace("content", "^[^ ]+", "X"), F.lit("\nend")))
    return textfiles.extra_lines(a, b).select("path", "line_no", F.md5("line").alias("line"))


def file_join(s, d):
    n = table(s, d, "nation")
    a = n.select(F.lit("a").alias("path"), F.concat(F.col("n_regionkey").cast("string"), F.lit(" "), F.col("n_name")).alias("content"))
    b = table(s, d, "region").where("r_regionkey > 0").select(F.lit("b").alias("path"), F.concat(F.col("r_regionkey").cast("string"), F.lit(" "), F.col("r_name")).alias("content"))
    return textfiles.joined(a, b).select("line")


def search_products(s, d):
    return table(s, d, "part").where(F.contains(F.lower("p_name"), F.lit("a")) & F.col("p_retailprice").between(900, 1200)).select("p_partkey", "p_name")


def list_categories(s, d):
    return table(s, d, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("products"))


def average_rating(s, d):
    return rounded(table(s, d, "events").groupBy("event_type").agg(F.round(F.avg("value"), 1).alias("rating"), F.count(F.lit(1)).alias("reviews")), "rating", digits=1)


def cart_total(s, d):
    items = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("total"), F.count(F.lit(1)).alias("items"))
    return rounded(items.withColumn("due", F.when(F.col("items") >= 4, F.col("total") * 0.9).otherwise(F.col("total"))).select("l_orderkey", "due"), "due", digits=3)


def list_invoices(s, d):
    o = table(s, d, "orders")
    return o.where((F.col("o_orderstatus") == "O") & F.col("o_orderdate").between(F.lit("1996-01-01").cast("timestamp_ntz"), F.lit("1996-06-30").cast("timestamp_ntz"))).select("o_orderkey", "o_custkey")


def top_customers(s, d):
    return rounded(table(s, d, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("spent")).orderBy(F.desc("spent"), "o_custkey").limit(20), "spent", digits=2)


def message_search(s, d):
    c = table(s, d, "conversations").where(F.contains(F.lower("text"), F.lit("the")))
    return c.groupBy("role").agg(F.count(F.lit(1)).alias("messages"), F.countDistinct("conv_id").alias("conversations"))


def apply_mutations(s, d):
    state = table(s, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("value"))
    log = table(s, d, "orders").select(
        F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("seq"),
        F.element_at(F.array(F.lit("insert"), F.lit("update"), F.lit("delete")), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("op"), F.col("o_totalprice").alias("value"))
    out = entities.apply_mutations(state, log)
    return out.select("id", "alive", F.when(F.col("alive"), F.col("value")).alias("value"), F.size(F.filter("outcomes", lambda o: o["error"].isNotNull())).alias("errors"))


def guarded_transfers(s, d):
    acc = table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), (F.col("c_custkey") % 7 == 0).alias("frozen"))
    moves = table(s, d, "orders").select(F.col("o_custkey").alias("src"), (F.col("o_custkey") + F.col("o_orderkey") % 5).alias("dst"), F.col("o_orderkey").alias("seq"), (F.col("o_totalprice") / 100 - 500).alias("amount"))
    return entities.guarded_transfers(acc, moves).select("seq", "error")


def state_delta(s, d):
    """Orders that were no longer open before against those that aren't pending after, large ones marked anew."""
    a = table(s, d, "orders").where("o_orderstatus <> 'O'").select("o_orderkey", "o_orderstatus")
    b = table(s, d, "orders").where("o_orderstatus <> 'P'").select("o_orderkey", F.when(F.col("o_totalprice") > 300000, F.lit("X")).otherwise(F.col("o_orderstatus")).alias("o_orderstatus"))
    return entities.state_delta(a, b, "o_orderkey", "o_orderstatus")


def split_report(s, d):
    """Task rates by domain and scenario, and by each alone: grouping sets in one pass."""
    e = table(s, d, "events").withColumns({"ok": (F.col("value") > 20).cast("double"), "kind": (F.col("user_id") % 3).cast("string")})
    out = e.cube("event_type", "kind").agg(F.count(F.lit(1)).alias("n"), F.avg("ok").alias("success_rate"))
    return rounded(out.withColumns({"event_type": F.coalesce("event_type", F.lit("all")), "kind": F.coalesce("kind", F.lit("all"))}), "success_rate")


QUERIES = {f.__name__: f for f in (
    file_head_tail, file_counts, file_grep, file_sort, file_cut_awk, file_sed, file_digests, file_usage, file_diff, file_join, search_products,
    list_categories, average_rating, cart_total, list_invoices, top_customers, message_search, apply_mutations, guarded_transfers, state_delta, split_report,
)}

_L = "string_split(text, chr(10))"
_JOIN = "array_to_string({}, chr(10))"
ORACLE_SQL = {
    "file_head_tail": f"SELECT doc_id, md5({_JOIN.format(_L + '[1:3]')}) AS head, md5({_JOIN.format(f'list_slice({_L}, greatest(len({_L}) - 1, 1), len({_L}))')}) AS tail FROM documents",
    "file_counts": f"SELECT doc_id, len({_L})::INT AS lines, len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> ''))::INT AS words, length(text)::INT AS chars FROM documents",
    "file_grep": f"""WITH h AS (SELECT lang || '/' || source || '/' || doc_id AS path, list_filter(list_transform({_L}, lambda x, i: {{'n': i, 'x': x}}), lambda z: contains(z.x, 'the ')) AS h FROM documents)
      SELECT path, len(h)::INT AS count, least(len(h), 50)::INT AS shown, md5(array_to_string(list_transform(h[1:50], lambda z: z.n || ':' || z.x), chr(10))) AS hits FROM h WHERE len(h) > 0""",
    "file_sort": f"SELECT doc_id, md5({_JOIN.format(f'list_sort({_L})')}) AS up, md5({_JOIN.format(f'list_reverse_sort(list_distinct({_L}))')}) AS down FROM documents",
    "file_cut_awk": f"""SELECT doc_id, md5({_JOIN.format(f"list_transform({_L}, lambda x: coalesce(list_filter(string_split_regex(x, '\\s+'), lambda w: w <> '')[2], ''))")}) AS second,
      md5({_JOIN.format(f"list_transform({_L}, lambda x: coalesce(list_filter(string_split(x, ','), lambda w: w <> '')[1], ''))")}) AS first FROM documents""",
    "file_sed": f"SELECT doc_id, md5({_JOIN.format(f"list_transform({_L}, lambda x: regexp_replace(x, '[aeiou]+', '_', 'g'))")}) AS text FROM documents",
    "file_digests": "SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256, md5(array_to_string(regexp_extract_all(lower(hex(encode(text))), '.{1,32}'), chr(10))) AS xxd FROM documents",
    "file_usage": "SELECT lang AS folder, sum(length(text))::BIGINT AS chars, count(*) AS files FROM documents GROUP BY lang UNION ALL SELECT lang || '/' || source, sum(length(text))::BIGINT, count(*) FROM documents GROUP BY 1",
    "file_diff": f"""WITH a AS (SELECT doc_id, unnest({_L}) AS line, generate_subscripts({_L}, 1) AS n FROM documents),
      t AS (SELECT doc_id, regexp_replace(text, '^[^ ]+', 'X') || chr(10) || 'end' AS text FROM documents), b AS (SELECT doc_id, unnest({_L}) AS line, generate_subscripts({_L}, 1) AS n FROM t)
      SELECT b.doc_id AS path, b.n::INT AS line_no, md5(b.line) AS line FROM b LEFT JOIN a ON a.doc_id = b.doc_id AND a.n = b.n WHERE a.line IS DISTINCT FROM b.line""",
    "file_join": "SELECT n_regionkey || ' ' || n_name || CASE WHEN r_name IS NULL THEN '' ELSE ' ' || r_name END AS line FROM nation LEFT JOIN region ON n_regionkey = r_regionkey AND r_regionkey > 0",
    "search_products": "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'a') AND p_retailprice BETWEEN 900 AND 1200",
    "list_categories": "SELECT p_brand, count(*) AS products FROM part GROUP BY p_brand",
    "average_rating": "SELECT event_type, round(avg(value), 1) + 0.0 AS rating, count(*) AS reviews FROM events GROUP BY event_type",
    "cart_total": "SELECT l_orderkey, round(sum(l_extendedprice) * CASE WHEN count(*) >= 4 THEN 0.9::DOUBLE ELSE 1 END, 3) + 0.0 AS due FROM lineitem GROUP BY l_orderkey",
    "list_invoices": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'O' AND o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-06-30'",
    "top_customers": "SELECT o_custkey, round(sum(o_totalprice), 2) + 0.0 AS spent FROM orders GROUP BY o_custkey ORDER BY sum(o_totalprice) DESC, o_custkey LIMIT 20",
    "message_search": "SELECT role, count(*) AS messages, count(DISTINCT conv_id) AS conversations FROM conversations WHERE contains(lower(text), 'the') GROUP BY role",
    "guarded_transfers": """WITH m AS (SELECT o_orderkey AS seq, o_custkey AS src, o_custkey + o_orderkey % 5 AS dst, o_totalprice / 100 - 500 AS amount FROM orders)
      SELECT seq, CASE WHEN amount <= 0 THEN 'invalid_amount' WHEN a.c_custkey IS NULL OR b.c_custkey IS NULL THEN 'not_found' WHEN src % 7 = 0 OR dst % 7 = 0 THEN 'frozen' WHEN a.c_acctbal < amount THEN 'insufficient_funds' END AS error
      FROM m LEFT JOIN customer a ON a.c_custkey = src LEFT JOIN customer b ON b.c_custkey = dst""",
    "apply_mutations": """WITH RECURSIVE st AS (SELECT c_custkey AS id, c_acctbal AS v FROM customer WHERE c_acctbal > 0),
      l AS (SELECT o_custkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k, ['insert', 'update', 'delete'][o_orderkey % 3 + 1] AS op, o_totalprice AS v FROM orders),
      ids AS (SELECT id FROM st UNION SELECT id FROM l),
      r AS (SELECT ids.id, 0::BIGINT AS k, st.v AS v, st.id IS NOT NULL AS alive, 0 AS errors FROM ids LEFT JOIN st USING (id) UNION ALL
        SELECT r.id, l.k, CASE WHEN (op = 'insert') <> alive AND op <> 'delete' THEN l.v ELSE r.v END, CASE WHEN (op = 'insert') <> alive THEN op <> 'delete' ELSE alive END, errors + ((op = 'insert') = alive)::INT
        FROM r JOIN l ON l.id = r.id AND l.k = r.k + 1)
      SELECT id, alive, CASE WHEN alive THEN v END AS value, errors FROM r QUALIFY row_number() OVER (PARTITION BY id ORDER BY k DESC) = 1""",
    "state_delta": """WITH a AS (SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'O'), b AS (SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderstatus <> 'P')
      SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'created' WHEN b.o_orderkey IS NULL THEN 'deleted' ELSE 'changed' END AS change
      FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR a.o_orderstatus <> b.o_orderstatus""",
    "split_report": """SELECT coalesce(event_type, 'all') AS event_type, coalesce(kind, 'all') AS kind, count(*) AS n, round(avg((value > 20)::DOUBLE), 6) + 0.0 AS success_rate
      FROM (SELECT event_type, (user_id % 3)::VARCHAR AS kind, value FROM events) GROUP BY CUBE (event_type, kind)""",
}
