"""Queries and checking SQL of batch algebra, metrics, joins, dedup, text, events and graphs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.functions import text as tx
from weftline.operators import balance, batch, graph, metrics, relational, splits, trajectories
from weftline.plans.samples import SAMPLES_SQL, rounded, samples, table


def _orders(s, d):
    return table(s, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")


def _events(s, d):
    return table(s, d, "events")


def batch_row_index(s, d):
    return batch.with_row_index(_orders(s, d), "o_orderkey")


def _indexed(s, d):
    return batch_row_index(s, d).select("row_idx", "o_orderkey")


def batch_slice(s, d):
    return batch.take_slice(_indexed(s, d), 10, 5000, 7)


def batch_repeat(s, d):
    return batch.repeat_rows(_indexed(s, d), 3)


def batch_tile(s, d):
    df = _indexed(s, d)
    return batch.repeat_rows(df, 2, interleave=False, total=df.count())


def batch_chunk(s, d):
    return _indexed(s, d).withColumn("part", batch.split_of(1000))


def pad_to_divisor(s, d):
    df = _indexed(s, d)
    return batch.pad_to_divisor(df, df.count(), 4096)


def unfold(s, d):
    v = table(s, d, "embeddings")
    return rounded(batch.unfold_columns(v.select("vec_id", "embedding"), "embedding", 4).select(
        "vec_id", "part", F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x).alias("total")), "total", digits=3)


def zip_union(s, d):
    a = _indexed(s, d)
    b = batch.with_row_index(_orders(s, d), "o_orderkey").select("row_idx", "o_orderkey", "o_totalprice")
    return batch.zip_union(a, b)


def group_index(s, d):
    return batch.group_index(table(s, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment")


def reduce_metrics(s, d):
    e = _events(s, d).select(F.concat("event_type", F.when(F.col("event_id") % 3 == 0, F.lit("_max")).when(F.col("event_id") % 3 == 1, F.lit("_min")).otherwise(F.lit(""))).alias("key"), "value")
    return rounded(metrics.reduce_by_name(e), "value")


_KEYED = "SELECT event_type || CASE WHEN event_id % 3 = 0 THEN '_max' WHEN event_id % 3 = 1 THEN '_min' ELSE '' END AS key, value FROM events"


def metrics_aggregator(s, d):
    e = _events(s, d).select(F.concat("event_type", F.element_at(F.array(*[F.lit(x) for x in ("_sum", "_max", "_last", "_avg")]), (F.col("event_id") % 4 + 1).cast("int"))).alias("key"), "value", F.col("event_id").alias("step"))
    return rounded(metrics.aggregate_metrics(e), "value", digits=4)


def mean_std_at_n(s, d):
    df = samples(s, d).select(F.col("level").alias("source"), "uid", F.sqrt("score").alias("score"))
    return rounded(metrics.at_n(df), "mean_at_n", "std_at_n")


def maj_vote(s, d):
    return metrics.majority(samples(s, d), ["uid"], "level", "score", "pos")


def best_at_n(s, d):
    df = samples(s, d).select(F.lit("all").alias("source"), "uid", (F.sqrt("score") / 100).alias("score"))
    return rounded(metrics.expected_at_n(df), "best", "best_std", "worst", "worst_std", digits=5)


def length_percentiles(s, d):
    return metrics.index_percentile(table(s, d, "documents"), "n_chars", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


def length_stats(s, d):
    return metrics.length_report(table(s, d, "documents"), "n_chars", 8000)


def group_integrity(s, d):
    df = samples(s, d).groupBy("uid", "level").agg(F.count(F.lit(1)).alias("n"))
    return df.withColumn("whole", (F.col("n") == 2).cast("int")).groupBy("level", "n").agg(F.count(F.lit(1)).alias("groups"), F.sum("whole").alias("whole"))


def batch_metrics(s, d):
    return rounded(metrics.describe(samples(s, d), ["score", "length", "lp"]), "mean", "greatest", "least", digits=4)


def tail_ratio(s, d):
    return rounded(metrics.tail_share(_events(s, d), "value"), "tail_share", "least", "greatest")


def interval_overlap(s, d):
    e = _events(s, d).select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("start"), (F.unix_micros(F.col("ts").cast("timestamp")) + F.floor(F.col("value") * 1000000)).alias("end")).where("value > 0")
    pairs = relational.overlapping(e, "start", "end", "event_id", 60e6)
    return pairs.groupBy(F.col("event_id_a").alias("event_id")).agg(F.count(F.lit(1)).alias("conflicts"))


def train_test_overlap(s, d):
    a, b = table(s, d, "documents").where("doc_id % 2 = 0"), table(s, d, "documents").where("doc_id % 2 = 1")
    return b.withColumn("fp", relational.fingerprint(F.col("text"))).join(a.select(relational.fingerprint(F.col("text")).alias("fp")).distinct(), "fp", "left_semi").select("doc_id")


def exact_dedup(s, d):
    return relational.first_wins(table(s, d, "documents"), [relational.fingerprint(F.col("lang"), F.col("text"))], "doc_id").select("doc_id", "lang")


def _token_sets(s, d):
    return table(s, d, "benchmark").select("item_id", F.lit("all").alias("block"), F.split(F.lower("text"), " ").alias("tokens")).unionByName(
        table(s, d, "benchmark").select((F.col("item_id") + 100000).alias("item_id"), F.lit("all").alias("block"), F.split(F.lower(F.regexp_replace("text", " [^ ]+$", "")), " ").alias("tokens")))


def jaccard_pairs(s, d):
    return rounded(relational.jaccard_pairs(_token_sets(s, d), "item_id", "block", "tokens", 0.7), "similarity").select("a", "b", "similarity")


def greedy_dedup(s, d):
    sets = _token_sets(s, d)
    return relational.greedy_keep(sets, "item_id", relational.jaccard_pairs(sets, "item_id", "block", "tokens", 0.7)).select("item_id")


def _split(s, d):
    docs = table(s, d, "documents").select("doc_id", "lang", "source")
    n = docs.count()
    return splits.exact_split(docs, "lang", "source", "doc_id", n - n // 10 - n // 20, n // 10)


def stratified_split(s, d):
    """A tenth of the rows validates, a twentieth is left out, the rest trains: exact numbers over language and source."""
    return _split(s, d).select("doc_id", "split")


def split_counts(s, d):
    return _split(s, d).groupBy("source").agg(F.sum((F.col("split") == "val").cast("long")).alias("val"), F.count(F.lit(1)).alias("rows"))


def quota_rounds(s, d):
    docs = table(s, d, "documents")
    names = ["de", "en", "es", "fr"]
    return splits.quota_rounds(docs, "lang", "text", "doc_id", splits.even_targets(names, docs.count() // 5)).select("doc_id", "lang")


def keep_last_turn(s, d):
    return relational.best_of(table(s, d, "conversations"), ["conv_id"], F.desc("turn")).select("conv_id", "turn", "role")


def uniq_lines(s, d):
    lines = table(s, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("at", F.struct("doc_id", "pos"))
    return relational.distinct_in_order(lines, "line", "at").select(F.md5("line").alias("line"), "count", F.col("first_pos.doc_id").alias("first_doc"), F.col("first_pos.pos").alias("first_line"))


def tool_usage_topk(s, d):
    return _events(s, d).groupBy("event_type").agg(F.count(F.lit(1)).alias("uses")).orderBy(F.desc("uses"), "event_type").limit(3)


def overlong_filter(s, d):
    return table(s, d, "documents").where(tx.word_count(F.col("text")) <= 500).select("doc_id")


def lookup_pricing(s, d):
    items = F.collect_list(F.struct(F.col("l_partkey").alias("id"), F.col("l_quantity").alias("quantity")))
    orders = table(s, d, "lineitem").groupBy("l_orderkey").agg(items.alias("items"))
    return rounded(relational.priced(orders, "l_orderkey", "items", table(s, d, "part"), "p_partkey", "p_retailprice"), "total", digits=2)


def thread_messages(s, d):
    """The messages that a thread's list names, in list order, those that don't exist left out."""
    threads = table(s, d, "conversations").groupBy("conv_id").agg(F.max("turn").alias("m")).select("conv_id", F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("m") + 2, F.lit(2).cast("bigint")), lambda t: F.col("conv_id") * 1000 + t).alias("ids"))
    messages = table(s, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("message_id"), "role")
    return relational.lookup_in_order(threads, "ids", messages, "message_id").select("conv_id", "pos", "message_id", "role")


def statement(s, d):
    o = table(s, d, "orders").withColumn("month", F.date_format("o_orderdate", "yyyy-MM"))
    return rounded(relational.statement(o, ["o_custkey", "month"], "o_totalprice", F.col("o_orderstatus") == "F"), "debits", "credits", digits=2)


def _marked():
    return F.concat(F.lit("so <think>no</think> #### "), F.format_string("%,d", F.col("doc_id")), F.lit(" and #### "), F.col("n_chars").cast("string"))


def gsm8k_extract(s, d):
    t = table(s, d, "documents")
    a = tx.marked_answer(_marked())
    return t.select("doc_id", a.alias("answer"), tx.marked_answer(_marked(), "flexible").alias("number"), tx.marked_score(a, F.when(F.col("doc_id") % 2 == 0, F.col("n_chars").cast("string")).otherwise(F.lit("x")), wrong=0.1).alias("score"))


def strip_think(s, d):
    return table(s, d, "documents").select("doc_id", tx.strip_think(F.when(F.col("doc_id") % 2 == 0, _marked()).otherwise(F.concat(F.lit("a <think> b "), F.col("source")))).alias("text"))


def qa_normalize(s, d):
    return table(s, d, "benchmark").select("item_id", tx.normal_answer(F.concat(F.lit("The  answer, an "), F.col("text"), F.lit("!"))).alias("answer"))


def _answers(s, d):
    """Whole texts as gold answers, and predictions that match, lack a word, say more, or say another thing."""
    t, k = F.col("text"), F.col("item_id") % 4
    said = F.when(k == 0, F.concat(F.lit("The "), F.translate(t, "aeinrst", "AEINRST"), F.lit("!"))).when(k == 1, F.regexp_replace(t, r"^\S+\s", "")).when(k == 2, F.concat(F.lit("I think "), t, F.lit(" indeed."))).otherwise(F.reverse(t))
    return table(s, d, "benchmark").select("item_id", "text", said.alias("said"))


def em_scores(s, d):
    gold = F.array(F.lit("other"), F.col("text"))
    return _answers(s, d).select("item_id", tx.exact_match(F.col("said"), gold).alias("em"), tx.contained_match(F.col("said"), F.array("text")).alias("sub_em"))


def qa_extract(s, d):
    """The last answer block of texts with two blocks, one over several lines, an open one, or none."""
    k = F.col("item_id") % 4
    t = F.when(k == 0, F.concat(F.lit("<answer> first </answer> then <answer> "), "text", F.lit(" </answer> end"))).when(k == 1, F.concat(F.lit("<answer>\n"), F.replace("text", F.lit(" "), F.lit("\n")), F.lit("</answer>"))).when(
        k == 2, F.concat(F.lit("<answer> "), "text")).otherwise(F.col("text"))
    return table(s, d, "benchmark").select("item_id", tx.answer_block(t).alias("answer"))


def last_boxed(s, d):
    """The last box of whole texts: nested, none, never closed, or the second of two."""
    k = F.col("item_id") % 4
    t = F.when(k == 0, F.concat("text", F.lit(" \\boxed{1} so \\boxed{{"), "text", F.lit("}^{2}} end"))).when(k == 1, F.col("text")).when(k == 2, F.concat(F.lit("\\boxed{"), "text")).otherwise(F.concat("text", F.lit("\\boxed{"), F.col("item_id").cast("string"), F.lit("}"), "text"))
    return table(s, d, "benchmark").select("item_id", tx.last_boxed(t).alias("boxed"))


def tool_kinds(s, d):
    name = F.concat(F.element_at(F.array(*[F.lit(x) for x in ("create_", "get_", "delete_", "update_", "send_", "x_")]), (F.col("event_id") % 6 + 1).cast("int")), F.col("event_type"))
    return _events(s, d).select("event_id", tx.operation_of(name).alias("kind"), tx.operation_of(name, "query delete create update", "query").alias("adapter_kind"))


def prompt_hash(s, d):
    return table(s, d, "benchmark").select("item_id", tx.short_hash(F.col("text")).alias("hash"))


def stale_years(s, d):
    """Old years anywhere in whole texts: a date, a path, or numbers that only look alike."""
    k, year = F.col("doc_id") % 3, (F.col("doc_id") % 20 + 2015).cast("string")
    mark = F.when(k == 0, F.concat(F.lit(" on "), year, F.lit("-01-02."))).when(k == 1, F.concat(F.lit(" in "), year, F.lit("/x"))).otherwise(F.concat(F.lit(" no 1"), year, F.lit("-5")))
    return table(s, d, "documents").select("doc_id", tx.has_stale_year(F.concat(F.coalesce("text", F.lit("")), mark)).alias("stale"))


def overlong_penalty(s, d):
    return rounded(table(s, d, "documents").select("doc_id", tx.overlong_penalty(F.col("n_chars"), 8000, 2000, 1.0).alias("penalty")), "penalty")


_NEED = ["view", "click", "purchase"]


def ordered_coverage(s, d):
    seq = trajectories.sequences(_events(s, d), "user_id", "event_type", "ts", "event_id")
    return seq.select("user_id", trajectories.cursor(F.col("names"), _NEED).alias("met"), trajectories.aligned(F.col("names"), _NEED).alias("aligned"), trajectories.order_violated(F.col("names"), "view", "purchase").alias("violated"))


def repeated_effects(s, d):
    return trajectories.repeated_effects(_events(s, d), "user_id", ["event_type"], "ts", "event_id").groupBy("user_id").agg(F.count(F.lit(1)).alias("repeats"))


def recreated(s, d):
    e = _events(s, d).withColumn("entity", F.col("event_id") % 3)
    return trajectories.created_and_deleted(e, "user_id", "entity", "event_type", "view", "click", "ts", "event_id")


def potential_difference(s, d):
    return rounded(trajectories.potential_shaping(_events(s, d), "user_id", "value", 0.99, "ts", "event_id").select("event_id", "shaping"), "shaping")


def dual_ascent_state(s, d):
    """Multipliers of two runs over daily costs, the second of which is dear until late and so stalls and thaws."""
    daily = _events(s, d).groupBy((F.col("user_id") % 2).alias("run"), F.to_date("ts").alias("day")).agg(F.avg((F.col("value") > F.when(F.col("user_id") % 2 == 0, 50).otherwise(25)).cast("double")).alias("cost"))
    late = (F.dayofmonth("day") > 20) & (F.col("run") == 1)
    daily = daily.withColumn("cost", F.when(late, F.col("cost") / 10).otherwise(F.col("cost")))
    out = trajectories.dual_ascent(daily, "run", "day", "cost", rate=0.1, stall_after=8)
    return rounded(out, "lam").withColumn("day", F.col("day").cast("string"))


def dependency_chains(s, d):
    n = table(s, d, "nation").select("n_nationkey", "n_regionkey")
    edges = n.alias("a").join(n.alias("b"), (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey"))).select(
        F.col("a.n_nationkey").alias("src"), F.col("b.n_nationkey").alias("dst"), F.lit("implicit").alias("relation"), F.col("b.n_nationkey").alias("pos"))
    return graph.simple_paths(edges, 5, 2).select(F.array_join("path", ">").alias("path"))


def _batches(s, d, rows=256):
    """Documents in batches of a fixed number of rows, so batches grow in number with the data and not in size."""
    docs = batch.with_row_index(table(s, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return docs.select(batch.split_of(rows).alias("batch"), "doc_id", "n_chars", balance.workload(F.col("n_chars")).alias("cost"))


def kk_partition(s, d):
    return balance.balanced(_batches(s, d), "batch", "doc_id", "cost", 4).groupBy("batch", "bin").agg(F.count(F.lit(1)).alias("n"), F.sum("cost").alias("cost"))


def greedy_partition(s, d):
    return balance.balanced(_batches(s, d), "batch", "doc_id", "cost", 4, "greedy").groupBy("batch", "bin").agg(F.count(F.lit(1)).alias("n"), F.sum("cost").alias("cost"))


def dynamic_micro_batches(s, d):
    return balance.micro_batches(_batches(s, d).select("batch", "doc_id", "n_chars"), "batch", "doc_id", "n_chars", 20000)


def zigzag_order(s, d):
    rank = Window.partitionBy("batch").orderBy(F.desc("cost"), "doc_id")
    return _batches(s, d).withColumn("rank", F.row_number().over(rank) - 1).select("batch", "doc_id", balance.zigzag(F.col("rank"), 4).alias("worker"))


def rollout_report(s, d):
    e = _events(s, d).withColumns({"version": F.col("user_id") % 7, "partial": F.col("event_type") == "error"})
    return rounded(metrics.rollout_report(e, "value", "version", "partial"), "tp50", "tp95", "tp99", "partial_ratio")


def timing_means(s, d):
    return rounded(metrics.timing_means(_events(s, d), "event_type", "value"), "mean")


def source_mean_scores(s, d):
    g = samples(s, d).groupBy("level", "uid").agg(F.array_sort(F.collect_list("score")).alias("scores"))
    return rounded(metrics.source_means(g, "level", "scores"), "mean_score", digits=4)


QUERIES = {f.__name__: f for f in (
    batch_row_index, batch_slice, batch_repeat, batch_tile, batch_chunk, pad_to_divisor, unfold, zip_union, group_index, reduce_metrics,
    metrics_aggregator, mean_std_at_n, maj_vote, length_percentiles, length_stats, group_integrity, batch_metrics, tail_ratio, interval_overlap,
    train_test_overlap, exact_dedup, jaccard_pairs, greedy_dedup, stratified_split, split_counts, keep_last_turn, uniq_lines, tool_usage_topk,
    overlong_filter, lookup_pricing, thread_messages, statement, gsm8k_extract, strip_think, qa_normalize, em_scores, qa_extract, last_boxed, tool_kinds,
    prompt_hash, stale_years, overlong_penalty, ordered_coverage, repeated_effects, recreated, potential_difference, dual_ascent_state,
    dependency_chains, kk_partition, greedy_partition, dynamic_micro_batches, zigzag_order, best_at_n, quota_rounds, rollout_report, timing_means, source_mean_scores,
)}

_IDX = "i AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS row_idx, o_orderkey, o_totalprice, o_orderstatus FROM orders)"
_FPR = "sha256('\"' || lower(trim(regexp_replace({}, '\\s+', ' ', 'g'))) || '\"')"
_SETS = """t AS (SELECT item_id, list_distinct(string_split(lower(text), ' ')) AS t FROM benchmark
  UNION ALL SELECT item_id + 100000, list_distinct(string_split(lower(regexp_replace(text, ' [^ ]+$', '')), ' ')) FROM benchmark),
 p AS (SELECT a.item_id AS a, b.item_id AS b, len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))) AS similarity
  FROM t a JOIN t b ON a.item_id < b.item_id)"""
_RULE = "CASE WHEN key LIKE '%last' THEN 'last' WHEN contains(key, 'max') THEN 'max' WHEN contains(key, 'avg') THEN 'avg' ELSE 'sum' END"
_MARK = "'so <think>no</think> #### ' || format('{:,}', doc_id) || ' and #### ' || n_chars"

_NORMAL = r"array_to_string(list_filter(string_split_regex(regexp_replace(lower({}), '[!-/:-@\[-`{{-~]', '', 'g'), '\s+'), lambda w: w NOT IN ('', 'a', 'an', 'the')), ' ')"
_SAID = r"CASE item_id % 4 WHEN 0 THEN 'The ' || translate(text, 'aeinrst', 'AEINRST') || '!' WHEN 1 THEN regexp_replace(text, '^\S+\s', '') WHEN 2 THEN 'I think ' || text || ' indeed.' ELSE reverse(text) END"
#: Quotas by largest remainders, first over sources, then over the languages of a source; then the rest over cells.
_CELLS = """c AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source), t AS (SELECT sum(n)::BIGINT AS n, sum(n)::BIGINT // 10 AS v, sum(n)::BIGINT - sum(n)::BIGINT // 10 - sum(n)::BIGINT // 20 AS tr FROM c),
  s1 AS (SELECT source, sum(c.n)::BIGINT AS sn, sum(c.n)::BIGINT * any_value(t.v) / any_value(t.n) AS raw, any_value(t.v) AS v FROM c, t GROUP BY source),
  s2 AS (SELECT *, least(sn - 1, greatest(1, floor(raw))) AS base FROM s1),
  s3 AS (SELECT source, sn, base + (row_number() OVER (ORDER BY raw - base DESC, sn DESC, source DESC) <= v - sum(base) OVER ())::INT AS q FROM s2),
  d1 AS (SELECT lang, c.source, c.n, q, c.n * q / sn AS raw FROM c JOIN s3 USING (source)),
  d2 AS (SELECT lang, source, n, floor(raw) + (row_number() OVER (PARTITION BY source ORDER BY raw - floor(raw) DESC, n DESC, lang DESC) <= q - sum(floor(raw)) OVER (PARTITION BY source))::INT AS vq FROM d1),
  e1 AS (SELECT d2.*, n - vq AS r, (n - vq) * (SELECT tr FROM t) / sum(n - vq) OVER () AS raw FROM d2),
  e2 AS (SELECT *, floor(raw) + (row_number() OVER (ORDER BY raw - floor(raw) DESC, r DESC, lang DESC, source DESC) <= (SELECT tr FROM t) - sum(floor(raw)) OVER ())::INT AS tq FROM e1),
  k AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY md5('42:' || doc_id), doc_id) AS k FROM documents),
  sp AS (SELECT doc_id, k.source, CASE WHEN k <= vq THEN 'val' WHEN k <= vq + tq THEN 'train' END AS split FROM k JOIN e2 ON k.lang IS NOT DISTINCT FROM e2.lang AND k.source IS NOT DISTINCT FROM e2.source)"""
_BATCHES = "b AS (SELECT ((row_number() OVER (ORDER BY doc_id) - 1) // 256)::INT AS batch, doc_id, 24576 * n_chars + n_chars * n_chars AS cost FROM documents)"

ORACLE_SQL = {
    "batch_row_index": f"WITH {_IDX} SELECT * FROM i",
    "batch_slice": f"WITH {_IDX} SELECT row_idx, o_orderkey FROM i WHERE row_idx >= 10 AND row_idx < 5000 AND (row_idx - 10) % 7 = 0",
    "batch_repeat": f"WITH {_IDX} SELECT row_idx * 3 + k AS row_idx, o_orderkey FROM i, range(3) r(k)",
    "batch_tile": f"WITH {_IDX} SELECT row_idx + k * (SELECT count(*) FROM orders) AS row_idx, o_orderkey FROM i, range(2) r(k)",
    "batch_chunk": f"WITH {_IDX} SELECT row_idx, o_orderkey, (row_idx // 1000)::INT AS part FROM i",
    "pad_to_divisor": f"WITH {_IDX}, n AS (SELECT count(*) AS n FROM orders) SELECT row_idx + k * n AS row_idx, o_orderkey FROM i, n, range(4096) r(k) WHERE row_idx + k * n < ceil(n / 4096) * 4096",
    "unfold": "SELECT vec_id, k::INT AS part, round(list_sum(list_transform(embedding[k * 16 + 1 : k * 16 + 16], lambda x: x::DOUBLE)), 3) + 0.0 AS total FROM embeddings, range(4) r(k)",
    "zip_union": f"WITH {_IDX} SELECT row_idx, o_orderkey, o_totalprice FROM i",
    "group_index": "SELECT c_custkey, c_mktsegment, (dense_rank() OVER (ORDER BY c_mktsegment) - 1)::INT AS group_idx FROM customer",
    "reduce_metrics": f"SELECT key, round(CASE WHEN contains(key, 'max') THEN max(value) WHEN contains(key, 'min') THEN min(value) ELSE avg(value) END, 6) + 0.0 AS value FROM ({_KEYED}) GROUP BY key",
    "metrics_aggregator": f"""WITH k AS (SELECT event_type || ['_sum', '_max', '_last', '_avg'][event_id % 4 + 1] AS key, value, event_id FROM events)
      SELECT key, {_RULE} AS rule, round(CASE {_RULE} WHEN 'last' THEN arg_max(value, event_id) WHEN 'max' THEN max(value) WHEN 'avg' THEN avg(value) ELSE sum(value) END, 4) + 0.0 AS value FROM k GROUP BY key""",
    "mean_std_at_n": f"""WITH {SAMPLES_SQL}, u AS (SELECT level AS source, uid, count(*) AS n, avg(sqrt(score)) AS m, stddev_pop(sqrt(score)) AS d FROM s GROUP BY level, uid)
      SELECT source, n, count(*) AS groups, round(avg(m), 6) + 0.0 AS mean_at_n, round(avg(d), 6) + 0.0 AS std_at_n FROM u GROUP BY source, n""",
    "maj_vote": f"""WITH {SAMPLES_SQL}, v AS (SELECT uid, level, count(*) AS votes, min(pos) AS f, arg_min(score, pos) AS score FROM s GROUP BY uid, level)
      SELECT uid, level, score, votes FROM v QUALIFY row_number() OVER (PARTITION BY uid ORDER BY votes DESC, f) = 1""",
    "length_percentiles": "WITH l AS (SELECT list_sort(list(n_chars)) AS v FROM documents) SELECT v[greatest(0, floor(len(v) * 0.5::DOUBLE)::INT - 1) + 1] AS p50, v[greatest(0, floor(len(v) * 0.95::DOUBLE)::INT - 1) + 1] AS p95, v[greatest(0, floor(len(v) * 0.99::DOUBLE)::INT - 1) + 1] AS p99 FROM l",
    "length_stats": """WITH l AS (SELECT list_sort(list(n_chars)) AS v FROM documents) SELECT (SELECT count(n_chars) FROM documents) AS n, (SELECT max(n_chars) FROM documents) AS longest,
      (SELECT count(*) FROM documents WHERE n_chars > 8000) AS overflow, (SELECT count(*) FROM documents WHERE n_chars > 7200 AND n_chars <= 8000) AS near_limit,
      v[greatest(0, floor(len(v) * 0.5::DOUBLE)::INT - 1) + 1] AS p50, v[greatest(0, floor(len(v) * 0.95::DOUBLE)::INT - 1) + 1] AS p95, v[greatest(0, floor(len(v) * 0.99::DOUBLE)::INT - 1) + 1] AS p99 FROM l""",
    "group_integrity": f"WITH {SAMPLES_SQL}, g AS (SELECT uid, level, count(*) AS n FROM s GROUP BY uid, level) SELECT level, n, count(*) AS groups, sum((n = 2)::INT)::BIGINT AS whole FROM g GROUP BY level, n",
    "batch_metrics": f"""WITH {SAMPLES_SQL} SELECT 'score' AS name, round(avg(score), 4) + 0.0 AS mean, round(max(score), 4) + 0.0 AS greatest, round(min(score), 4) + 0.0 AS least FROM s
      UNION ALL SELECT 'length', round(avg(length), 4) + 0.0, round(max(length), 4) + 0.0, round(min(length), 4) + 0.0 FROM s UNION ALL SELECT 'lp', round(avg(lp), 4) + 0.0, round(max(lp), 4) + 0.0, round(min(lp), 4) + 0.0 FROM s""",
    "tail_ratio": "WITH q AS (SELECT quantile_cont(value, 0.9) AS q FROM events) SELECT round(avg((value > q)::DOUBLE), 6) + 0.0 AS tail_share, round(min(value), 6) + 0.0 AS least, round(max(value), 6) + 0.0 AS greatest FROM events, q",
    "interval_overlap": """WITH e AS (SELECT event_id, epoch_us(ts) AS s, epoch_us(ts) + floor(value * 1000000)::BIGINT AS t FROM events WHERE value > 0)
      SELECT a.event_id, count(*) AS conflicts FROM e a JOIN e b ON a.s < b.t AND a.t > b.s AND a.event_id <> b.event_id GROUP BY a.event_id""",
    "train_test_overlap": f"SELECT doc_id FROM documents WHERE doc_id % 2 = 1 AND {_FPR.format('text')} IN (SELECT {_FPR.format('text')} FROM documents WHERE doc_id % 2 = 0)",
    "exact_dedup": "SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lower(trim(regexp_replace(lang, '\\s+', ' ', 'g'))), lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) ORDER BY doc_id) = 1",
    "jaccard_pairs": f"WITH {_SETS} SELECT a, b, round(similarity, 6) AS similarity FROM p WHERE similarity >= 0.7",
    "stratified_split": f"WITH {_CELLS} SELECT doc_id, split FROM sp WHERE split IS NOT NULL",
    "split_counts": f"WITH {_CELLS} SELECT source, sum((split = 'val')::INT)::BIGINT AS val, count(*) AS rows FROM sp WHERE split IS NOT NULL GROUP BY source",
    "keep_last_turn": "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1",
    "uniq_lines": "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents), g AS (SELECT line, count(*) AS count, min({'d': doc_id, 'p': pos}) AS f FROM l GROUP BY line) SELECT md5(line) AS line, count, f.d AS first_doc, f.p::INT AS first_line FROM g",
    "tool_usage_topk": "SELECT event_type, count(*) AS uses FROM events GROUP BY event_type ORDER BY uses DESC, event_type LIMIT 3",
    "overlong_filter": "SELECT doc_id FROM documents WHERE len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) <= 500",
    "lookup_pricing": "SELECT l_orderkey, round(sum(l_quantity * p_retailprice), 2) + 0.0 AS total FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey",
    "thread_messages": """WITH t AS (SELECT conv_id, max(turn) AS m FROM conversations GROUP BY conv_id), i AS (SELECT conv_id, unnest(range(0, m + 3, 2)) AS turn FROM t)
      SELECT i.conv_id, (i.turn // 2)::INT AS pos, i.conv_id * 1000 + i.turn AS message_id, role FROM i JOIN conversations c ON c.conv_id = i.conv_id AND c.turn = i.turn""",
    "statement": """SELECT o_custkey, strftime(o_orderdate, '%Y-%m') AS month, round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END), 2) + 0.0 AS debits,
      round(sum(CASE WHEN o_orderstatus <> 'F' THEN o_totalprice ELSE 0 END), 2) + 0.0 AS credits FROM orders GROUP BY 1, 2""",
    "gsm8k_extract": f"""WITH m AS (SELECT doc_id, n_chars, right({_MARK}, 300) AS t FROM documents), a AS (SELECT doc_id, n_chars, regexp_replace(regexp_extract_all(t, '#### (\\-?[0-9\\.\\,]+)', 1)[-1], '[,$]', '', 'g') AS answer,
        list_filter(regexp_extract_all(t, '(\\-?[0-9\\.\\,]+)', 1), lambda x: x NOT IN ('', '.'))[-1] AS number FROM m)
      SELECT doc_id, answer, number, CASE WHEN answer IS NULL THEN 0.0 WHEN answer = CASE WHEN doc_id % 2 = 0 THEN n_chars::VARCHAR ELSE 'x' END THEN 1.0 ELSE 0.1 END::DOUBLE AS score FROM a""",
    "strip_think": f"""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN {_MARK} ELSE 'a <think> b ' || source END AS t FROM documents)
      SELECT doc_id, trim(replace(regexp_replace(regexp_replace(t, '(?s)<think>.*?</think>', '', 'g'), '(?s)<think>.*', '', 'g'), '</think>', '')) AS text FROM t""",
    "qa_normalize": r"""SELECT item_id, array_to_string(list_filter(string_split_regex(regexp_replace(lower('The  answer, an ' || text || '!'), '[!-/:-@\[-`{-~]', '', 'g'), '\s+'),
      lambda w: w NOT IN ('', 'a', 'an', 'the')), ' ') AS answer FROM benchmark""",
    "qa_extract": "SELECT item_id, CASE item_id % 4 WHEN 0 THEN trim(text) WHEN 1 THEN trim(replace(text, ' ', chr(10)), ' ' || chr(10)) END AS answer FROM benchmark",
    "last_boxed": "SELECT item_id, CASE item_id % 4 WHEN 0 THEN '{' || text || '}^{2}' WHEN 3 THEN item_id::VARCHAR END AS boxed FROM benchmark",
    "tool_kinds": """SELECT event_id, ['create', 'query', 'delete', 'update', 'create', 'query'][event_id % 6 + 1] AS kind, ['create', 'query', 'delete', 'update', 'create', 'query'][event_id % 6 + 1] AS adapter_kind FROM events""",
    "prompt_hash": "SELECT item_id, left(sha1(text), 16) AS hash FROM benchmark",
    "stale_years": "SELECT doc_id, regexp_matches(text, '\\b202[0-5][-/]') OR (doc_id % 3 < 2 AND doc_id % 20 + 2015 BETWEEN 2020 AND 2025) AS stale FROM documents",
    "overlong_penalty": "SELECT doc_id, round(least(-(n_chars - 6000) / 2000::DOUBLE, 0), 6) + 0.0 AS penalty FROM documents",
    "repeated_effects": "WITH r AS (SELECT user_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events) SELECT user_id, count(*) AS repeats FROM r WHERE k > 1 GROUP BY user_id",
    "recreated": """WITH g AS (SELECT *, max((event_type = 'click')::INT) OVER (PARTITION BY user_id, event_id % 3 ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gone FROM events)
      SELECT user_id, max((event_type = 'view' AND coalesce(gone, 0) = 1)::INT) AS recreated, sum((event_type = 'view')::INT)::BIGINT AS created, sum((event_type = 'click')::INT)::BIGINT AS deleted FROM g GROUP BY user_id""",
    "potential_difference": "SELECT event_id, round(0.99::DOUBLE * coalesce(lead(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) - value, 6) + 0.0 AS shaping FROM events",
    "dual_ascent_state": """WITH RECURSIVE a AS (SELECT user_id % 2 AS run, ts::DATE AS day, avg((value > CASE WHEN user_id % 2 = 0 THEN 50 ELSE 25 END)::DOUBLE) AS c FROM events GROUP BY 1, 2),
      b AS (SELECT run, day, CASE WHEN run = 1 AND day(day) > 20 THEN c / 10 ELSE c END AS c, row_number() OVER (PARTITION BY run ORDER BY day) AS k FROM a),
      r AS (SELECT DISTINCT run, 0::BIGINT AS k, NULL::DATE AS day, 1.0::DOUBLE AS lam, 0 AS streak, false AS frozen FROM b UNION ALL
        SELECT run, k, day, CASE WHEN f AND up THEN lam ELSE greatest(0, least(lam + 0.1::DOUBLE * (c - 0.05::DOUBLE), 3)) END, st, f FROM (
          SELECT *, CASE WHEN c > 0.5 THEN frozen OR (up AND st >= 8) ELSE frozen AND st >= 8 END AS f FROM (
            SELECT b.run, b.k, b.day, b.c, r.lam, r.frozen, b.c > 0.05::DOUBLE AS up, CASE WHEN b.c > 0.5 THEN r.streak + (b.c > 0.05::DOUBLE)::INT ELSE greatest(0, r.streak - 1) END AS st FROM r JOIN b ON b.run = r.run AND b.k = r.k + 1)))
      SELECT run, day::VARCHAR AS day, round(lam, 6) + 0.0 AS lam, streak, frozen FROM r WHERE k > 0""",
    "dependency_chains": """WITH RECURSIVE e AS (SELECT a.n_nationkey AS s, b.n_nationkey AS d FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey
        QUALIFY row_number() OVER (PARTITION BY a.n_nationkey ORDER BY b.n_nationkey) <= 2),
      p AS (SELECT [s, d] AS path FROM e UNION ALL SELECT list_append(path, d) FROM p JOIN e ON path[-1] = s WHERE len(path) < 5 AND NOT list_contains(path, d)) SELECT array_to_string(path, '>') AS path FROM p""",
    "em_scores": f"WITH p AS (SELECT item_id, {_NORMAL.format(_SAID)} AS p, {_NORMAL.format('text')} AS g FROM benchmark) SELECT item_id, (p = g OR p = 'other')::INT AS em, contains(p, g)::INT AS sub_em FROM p",
    "ordered_coverage": """WITH e AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
      a AS (SELECT user_id, min(k) FILTER (event_type = 'view') AS v, min(k) FILTER (event_type = 'purchase') AS p FROM e GROUP BY user_id),
      b AS (SELECT a.user_id, any_value(v) AS v, any_value(p) AS p, min(k) FILTER (event_type = 'click' AND k > coalesce(v, 0)) AS c FROM a JOIN e USING (user_id) GROUP BY a.user_id),
      d AS (SELECT b.user_id, any_value(v) AS v, any_value(p) AS p, any_value(c) AS c, min(k) FILTER (event_type = 'purchase' AND k > coalesce(c, v, 0)) AS q FROM b JOIN e USING (user_id) GROUP BY b.user_id)
      SELECT user_id, CASE WHEN v IS NULL THEN 0 WHEN c IS NULL THEN 1 WHEN q IS NULL THEN 2 ELSE 3 END AS met,
        (v IS NOT NULL)::INT + (c IS NOT NULL)::INT + (q IS NOT NULL)::INT AS aligned, (p IS NOT NULL AND (v IS NULL OR v > p))::INT AS violated FROM d""",
    "best_at_n": f"""WITH {SAMPLES_SQL}, r AS (SELECT uid, sqrt(score) / 100 AS x, row_number() OVER (PARTITION BY uid ORDER BY score) AS i, count(*) OVER (PARTITION BY uid) AS m FROM s),
      e AS (SELECT uid, x, i, m, unnest(list_append(list_filter([2, 4, 8, 16, 32, 64], lambda k: k < m), m)) AS n FROM r),
      g AS (SELECT uid, n::INT AS n, sum(x * (pow(i / m, n) - pow((i - 1) / m, n))) AS b, sum(x * x * (pow(i / m, n) - pow((i - 1) / m, n))) AS b2, sum(x * (pow((m - i + 1) / m, n) - pow((m - i) / m, n))) AS w, sum(x * x * (pow((m - i + 1) / m, n) - pow((m - i) / m, n))) AS w2 FROM e GROUP BY uid, n)
      SELECT 'all' AS source, uid, n, round(b, 5) + 0.0 AS best, round(sqrt(greatest(b2 - b * b, 0)), 5) + 0.0 AS best_std, round(w, 5) + 0.0 AS worst, round(sqrt(greatest(w2 - w * w, 0)), 5) + 0.0 AS worst_std FROM g""",
    "greedy_dedup": f"""WITH RECURSIVE {_SETS}, i AS (SELECT item_id, row_number() OVER (ORDER BY item_id) AS k FROM t), e AS (SELECT b, list(a) AS earlier FROM p WHERE similarity >= 0.7 GROUP BY b), q AS (SELECT i.*, coalesce(earlier, []) AS earlier FROM i LEFT JOIN e ON e.b = i.item_id),
      r AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS kept UNION ALL SELECT q.k, CASE WHEN list_has_any(r.kept, q.earlier) THEN r.kept ELSE list_append(r.kept, q.item_id) END FROM r JOIN q ON q.k = r.k + 1)
      SELECT unnest(kept) AS item_id FROM r WHERE k = (SELECT max(k) FROM i)""",
    "quota_rounds": """WITH f AS (SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang, lower(trim(text, ' ')) ORDER BY doc_id) = 1), n AS (SELECT count(*) // 5 AS n FROM documents)
      SELECT doc_id, lang FROM f, n WHERE lang IN ('de', 'en', 'es', 'fr') QUALIFY row_number() OVER (PARTITION BY lang ORDER BY doc_id) <= n // 4 + (list_position(['de', 'en', 'es', 'fr'], lang) - 1 < n % 4)::INT""",
    "greedy_partition": f"""WITH RECURSIVE {_BATCHES}, o AS MATERIALIZED (SELECT batch, cost, row_number() OVER (PARTITION BY batch ORDER BY doc_id) AS k FROM b),
      r AS (SELECT DISTINCT batch, 0::BIGINT AS k, [0, 0, 0, 0]::BIGINT[] AS loads, 0 AS bin, 0::BIGINT AS cost FROM o
        UNION ALL SELECT o.batch, o.k, list_transform(loads, lambda x, i: x + CASE WHEN i = p THEN o.cost ELSE 0 END), (p - 1)::INT, o.cost FROM (SELECT *, list_position(loads, list_min(loads)) AS p FROM r) r JOIN o ON o.batch = r.batch AND o.k = r.k + 1)
      SELECT batch, bin, count(*) AS n, sum(cost)::BIGINT AS cost FROM r WHERE k > 0 GROUP BY batch, bin""",
    "zigzag_order": f"WITH {_BATCHES}, r AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY cost DESC, doc_id) - 1 AS k FROM b) SELECT batch, doc_id, (CASE WHEN k // 4 % 2 = 0 THEN k % 4 ELSE 3 - k % 4 END)::INT AS worker FROM r",
    "rollout_report": """SELECT round(quantile_cont(value, 0.5), 6) + 0.0 AS tp50, round(quantile_cont(value, 0.95), 6) + 0.0 AS tp95, round(quantile_cont(value, 0.99), 6) + 0.0 AS tp99,
      count(DISTINCT user_id % 7) AS versions, round(avg((event_type = 'error')::DOUBLE), 6) + 0.0 AS partial_ratio, count(*) AS n FROM events""",
    "timing_means": "SELECT event_type, round(avg(value), 6) + 0.0 AS mean FROM events GROUP BY event_type",
    "source_mean_scores": f"WITH {SAMPLES_SQL}, g AS (SELECT level, uid, avg(score) AS m FROM s GROUP BY level, uid) SELECT level, round(avg(m), 4) + 0.0 AS mean_score, count(*) AS rows FROM g GROUP BY level",
}
