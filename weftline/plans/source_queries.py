"""Queries and checking SQL of generated rows, disturbed observations, schemas, batches after a filter and the vector index."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from weftline.functions import contracts, perturb
from weftline.operators import retrieval
from weftline.operators.batch import with_row_index
from weftline.plans.samples import SAMPLES_SQL, rounded, samples, table
from weftline.sources import generated as gen

#: Longest generated prompts that are kept, in characters.
MOST_CHARS = 60_000


def generated_rows(s, d):
    """Every document and what a generator makes of it: its text doubled, and its text once more where the id is odd; long ones are left out."""
    docs = table(s, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        new = [(-i - 1, t + t) for i, t in rows] + [(-i - 1, t) for i, t in rows if i % 2]
        return pa.RecordBatch.from_arrays([pa.array([i for i, _ in new], pa.int64()), pa.array([t for _, t in new], pa.string())], ["doc_id", "text"])

    out = gen.with_generated(docs, gen.generated(docs, make), F.length("text"), MOST_CHARS)
    return out.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.length("text")).alias("chars"))


def upsampled(s, d):
    return gen.upsampled(gen.first_again(table(s, d, "benchmark").select("item_id", "text"), "item_id"), 20).groupBy("item_id", "copy").agg(F.count(F.lit(1)).alias("rows"))


def dapo_batch(s, d):
    """Rows of groups whose rewards vary, and single rows; of these the first quarter of all rows, whole groups or not."""
    df = samples(s, d).select("uid", "pos", (F.col("score") > 30000).cast("double").alias("r"))
    kept = df.groupBy("uid").agg(F.stddev_pop("r").alias("d"), F.count(F.lit(1)).alias("n")).where("d > 0 or n = 1").select("uid")
    most = df.count() // 4
    return with_row_index(df.join(kept, "uid", "left_semi"), "uid", "pos").where(F.col("row_idx") < most).select("uid", "pos", "row_idx")


#: Observations with lists of line items under one of several keys, in SQL that both engines know.
OBSERVED = """
WITH o AS (SELECT o_orderkey, o_orderkey % 10 AS d, o_custkey % 6 AS k, o_custkey % 5 AS n FROM orders)
SELECT o_orderkey, d, k, n, CASE d WHEN 0 THEN 'calendar' WHEN 1 THEN 'shopping' WHEN 2 THEN 'banking' WHEN 3 THEN 'email' WHEN 4 THEN 'filesystem' WHEN 5 THEN 'payments' WHEN 6 THEN 'crm' WHEN 7 THEN 'team_chat' WHEN 8 THEN 'shopping' ELSE 'other' END AS domain,
  CASE k WHEN 0 THEN '"text"' ELSE '{"total":' || n || ',"' || CASE k WHEN 1 THEN 'items' WHEN 2 THEN 'results' WHEN 3 THEN 'updated' WHEN 4 THEN 'matches' ELSE 'plain' END || '":[' ||
    CASE n WHEN 0 THEN '' WHEN 1 THEN '{"id":1}' WHEN 2 THEN '{"id":1},2' WHEN 3 THEN '{"id":1},{"id":2},{"id":3,"status":"ok"}' ELSE '{"id":1},{"id":2},{"id":3},{"id":4},{"id":5},{"id":6}' END || ']}' END AS observation FROM o"""


def disturbed(s, d):
    """Each domain's disturbances of observations of every shape, at a chance that reaches all of them."""
    table(s, d, "orders").createOrReplaceTempView("_orders_observed")
    made = s.sql(OBSERVED.replace("FROM orders)", "FROM _orders_observed)"))
    out = made.withColumn("seen", perturb.disturbed(F.col("observation"), F.col("domain"), F.col("o_orderkey"), 42, 0.4))
    v = F.try_parse_json("seen")
    size = lambda k: F.size(contracts.members(contracts.member(v, F.lit(k))))
    failed = F.size(F.filter(contracts.members(F.coalesce(contracts.member(v, F.lit("results")), contracts.member(v, F.lit("updated")))), lambda x: F.coalesce(F.try_variant_get(contracts.member(x, F.lit("error")), F.lit("$"), "string").startswith("Transient"), F.lit(False))))
    return out.select(
        "o_orderkey", (F.col("seen") == F.col("observation")).alias("same"), F.coalesce(F.get_json_object("seen", "$.error") == "Internal Server Error", F.lit(False)).alias("error"), F.get_json_object("seen", "$.next_cursor").alias("cursor"),
        size("items").alias("items"), F.get_json_object("seen", "$.snippet_count").cast("int").alias("snippets"), F.get_json_object("seen", "$.failed_count").cast("int").alias("failed_count"), failed.alias("failed"))


def schema_errors(s, d):
    """Arguments of every shape against schemas with required, typed and enumerated properties, unions of types among them."""
    e = table(s, d, "events").select("event_id", (F.col("event_id") % 7).alias("a"), (F.col("user_id") % 6).alias("b"))
    schema = ('{"input_schema":{"required":["id","kind"],"properties":{"id":{"type":"string"},"kind":{"type":"string","enum":["x","y"]},"n":{"type":["integer","null"]},"f":{"type":"number"},"o":{"type":["object","array"]},"e":{"enum":[1,2.5,"1"]},"any":{}}}}')
    value = F.when(F.col("b") == 0, "1").when(F.col("b") == 1, '"1"').when(F.col("b") == 2, "null").when(F.col("b") == 3, "2.5").when(F.col("b") == 4, "[1]").otherwise("true")
    key = F.when(F.col("a") == 0, "n").when(F.col("a") == 1, "f").when(F.col("a") == 2, "o").when(F.col("a") == 3, "e").when(F.col("a") == 4, "kind").when(F.col("a") == 5, "any").otherwise("extra")
    text = F.when(F.col("event_id") % 11 == 0, "[]").otherwise(F.concat(F.lit("{"), F.when(F.col("event_id") % 3 > 0, '"id":"i",').otherwise(""), F.lit('"'), key, F.lit('":'), value, F.lit("}")))
    rules = s.range(1).select(contracts.schema_rules(F.lit(schema)).alias("rules"))
    out = e.select("event_id", text.alias("text")).crossJoin(F.broadcast(rules)).select("event_id", contracts.rule_errors(F.col("text"), F.col("rules")).alias("e"))
    return out.select("event_id", "e.valid", *[F.array_join(f"e.{c}", ",").alias(c) for c in ("missing", "unexpected", "type_errors", "enum_errors")])


def nearest_indexed(s, d):
    """The three nearest vectors, by an inverted file, of every one whose id is divisible by 20."""
    v = table(s, d, "embeddings")
    centroids = retrieval.fitted_centroids(v, "vec_id", "embedding")
    index = retrieval.inverted_file(v, "vec_id", "embedding", centroids)
    return rounded(retrieval.nearest_indexed(index, centroids, v.where("vec_id % 20 = 0"), "vec_id", "embedding", 3, retrieval.probes_for(v, "vec_id", "embedding", centroids)), "cosine", digits=5)


QUERIES = {f.__name__: f for f in (generated_rows, upsampled, dapo_batch, disturbed, schema_errors, nearest_indexed)}

_DRAW = "('0x' || left(md5('42:{}:' || o_orderkey), 13))::BIGINT / 4503599627370496.0::DOUBLE"
ORACLE_SQL = {
    "generated_rows": f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
a AS (SELECT doc_id, length(text) AS c FROM t UNION ALL SELECT -doc_id - 1, 2 * length(text) FROM t WHERE 2 * length(text) <= {MOST_CHARS} UNION ALL SELECT -doc_id - 1, length(text) FROM t WHERE doc_id % 2 = 1 AND length(text) <= {MOST_CHARS})
SELECT doc_id, count(*) AS rows, sum(c)::BIGINT AS chars FROM a GROUP BY doc_id""",
    "upsampled": "SELECT item_id, copy::INT AS copy, count(*) + CASE WHEN item_id = (SELECT min(item_id) FROM benchmark) THEN 1 ELSE 0 END AS rows FROM benchmark, range(1, 21) r(copy) GROUP BY item_id, copy",
    "dapo_batch": f"""WITH {SAMPLES_SQL}, g AS (SELECT uid FROM s GROUP BY uid HAVING stddev_pop((score > 30000)::DOUBLE) > 0 OR count(*) = 1)
      SELECT uid, pos, row_number() OVER (ORDER BY uid, pos) - 1 AS row_idx FROM s WHERE uid IN (FROM g) QUALIFY row_idx < (SELECT count(*) // 4 FROM s)""",
    "disturbed": f"""
WITH m AS ({OBSERVED}),
u AS (SELECT *, {_DRAW.format('intermittent_api_error')} < 0.4 AS err, {_DRAW.format('paginated_response')} < 0.4 AND k IN (1, 2) AND n > 1 AS page, {_DRAW.format('incomplete_intermediate')} < 0.4 AND k IN (1, 2, 4) AND n > 1 AS snip,
        {_DRAW.format('partial_batch_failure')} < 0.4 AND k IN (2, 3) AND n > 1 AS fail, {_DRAW.format('snippets')} AS draw, [0, 1, 2, 3, 6][n + 1] AS size FROM m),
w AS (SELECT *, CASE WHEN domain IN ('email', 'team_chat') THEN CASE WHEN page THEN 'page' WHEN fail THEN 'fail' END WHEN domain = 'shopping' THEN CASE WHEN page THEN 'page' WHEN snip THEN 'snip' END ELSE CASE WHEN err THEN 'err' WHEN fail THEN 'fail' END END AS what FROM u),
f AS (SELECT o_orderkey, count(*) FILTER (r <= greatest(1, size // 3) AND NOT (n = 2 AND i = 1))::INT AS failed FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY md5('42:' || o_orderkey || ':' || i)) AS r FROM (SELECT *, unnest(range(size)) AS i FROM w)) GROUP BY o_orderkey)
SELECT w.o_orderkey, what IS NULL AS same, coalesce(what = 'err', false) AS error, CASE WHEN what = 'page' THEN 'page_2' END AS cursor, CASE WHEN what = 'page' THEN size // 2 WHEN coalesce(what, 'fail') = 'fail' AND k = 1 THEN size ELSE 0 END::INT AS items,
  CASE WHEN what = 'snip' THEN least(size, 1 + floor(draw * 3)) END::INT AS snippets, CASE WHEN what = 'fail' THEN greatest(1, size // 3) END::INT AS failed_count, CASE WHEN what = 'fail' THEN coalesce(failed, 0) ELSE 0 END::INT AS failed FROM w LEFT JOIN f USING (o_orderkey)""",
    "schema_errors": """
WITH e AS (SELECT event_id, event_id % 7 AS a, user_id % 6 AS b, event_id % 3 > 0 AS id, event_id % 11 > 0 AS ok FROM events),
f AS (SELECT *, CASE WHEN ok THEN concat_ws(',', CASE WHEN NOT id THEN 'id' END, CASE WHEN a <> 4 THEN 'kind' END) ELSE '' END AS missing, CASE WHEN ok AND a = 6 THEN 'extra' ELSE '' END AS unexpected,
  CASE WHEN NOT ok THEN 'arguments must be object' WHEN a = 0 AND b NOT IN (0, 2) THEN 'n' WHEN a = 1 AND b NOT IN (0, 3) THEN 'f' WHEN a = 2 AND b <> 4 THEN 'o' WHEN a = 4 AND b <> 1 THEN 'kind' ELSE '' END AS type_errors,
  CASE WHEN NOT ok THEN '' WHEN a = 3 AND b NOT IN (0, 1, 3, 5) THEN 'e' WHEN a = 4 THEN 'kind' ELSE '' END AS enum_errors FROM e)
SELECT event_id, missing = '' AND unexpected = '' AND type_errors = '' AND enum_errors = '' AS valid, missing, unexpected, type_errors, enum_errors FROM f""",
}
