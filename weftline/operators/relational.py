"""Joins, set operations, deduplication and splits of datasets."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from itertools import combinations
from math import comb

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.session import checkpointed

#: Rounds of greedy_keep before the rest may be scanned in one task, and the edges that such a task holds at most.
ROUNDS = 8
SCAN_EDGES = 1_000_000
#: Keys of several tokens that a set has at most, about; keys of a single token come on top.
KEYS = 256


def overlapping(df: DataFrame, start: str, end: str, key: str, width: float, keep: list[str] | None = None) -> DataFrame:
    """Ordered pairs of different rows whose half-open intervals overlap: a.start < b.end and a.end > b.start.

    Buckets come in levels, each four times as wide as the one before, from `width`
    on. An interval lives on the level where it spans two or three buckets at most and visits
    the buckets of all wider levels, so a long one makes few rows too. A pair meets
    on the wider level of the two, in the bucket where the later of both starts.
    start and end are numbers.
    """
    level = lambda span: F.greatest(F.lit(0), F.ceil(F.log(4.0, F.greatest(span / width, F.lit(1.0))))).cast("int")
    keep = list(dict.fromkeys([key, start, end, *(keep or [])]))
    rows = df.select(*keep, level(F.col(end) - F.col(start)).alias("_l"))
    levels = rows.agg(F.coalesce(F.max("_l"), F.lit(0)).alias("_top"))
    wide = lambda c, at: F.floor(F.col(c) / (F.lit(float(width)) * F.pow(F.lit(4.0), at)))
    homes = rows.select(*[F.col(c).alias(f"{c}_a") for c in keep], F.col("_l").alias("_la"), F.explode(F.sequence(wide(start, F.col("_l")), wide(end, F.col("_l")))).alias("_b"))
    visits = rows.crossJoin(F.broadcast(levels)).select("*", F.explode(F.sequence(F.col("_l"), F.col("_top"))).alias("_at"))
    visits = visits.select(*[F.col(c).alias(f"{c}_b") for c in keep], F.col("_l").alias("_lb"), F.col("_at").alias("_la"), F.explode(F.sequence(wide(start, F.col("_at")), wide(end, F.col("_at")))).alias("_b"))
    met = homes.join(visits, ["_la", "_b"]).where((F.col(f"{start}_a") < F.col(f"{end}_b")) & (F.col(f"{end}_a") > F.col(f"{start}_b")) & (F.col(f"{key}_a") != F.col(f"{key}_b")))
    later = F.floor(F.greatest(f"{start}_a", f"{start}_b") / (F.lit(float(width)) * F.pow(F.lit(4.0), F.col("_la"))))
    met = met.where(later == F.col("_b"))
    a, b = (F.struct(*[F.col(f"{c}_{side}").alias(c) for c in keep]) for side in ("a", "b"))
    both = met.select(F.explode(F.when(F.col("_lb") < F.col("_la"), F.array(F.struct(a.alias("x"), b.alias("y")), F.struct(b.alias("x"), a.alias("y")))).otherwise(F.array(F.struct(a.alias("x"), b.alias("y"))))).alias("p"))
    return both.select(*[F.col(f"p.{side}.{c}").alias(f"{c}_{name}") for side, name in (("x", "a"), ("y", "b")) for c in keep])


def lookup_in_order(lists: DataFrame, ids: str, table: DataFrame, key: str) -> DataFrame:
    """The rows that a list column names, in list order with their position; missing ones are dropped."""
    return lists.select("*", F.posexplode(ids).alias("pos", key)).drop(ids).join(table, key)


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key: the last by order."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def first_wins(df: DataFrame, keys: list[Column], *order: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def fingerprint(*parts: Column) -> Column:
    """SHA-256 of the parts, each in quotes; texts are compared without case and outer or repeated white space."""
    norm = [F.concat(F.lit('"'), F.lower(F.trim(F.regexp_replace(F.coalesce(p.cast("string"), F.lit("")), r"\s+", " "))), F.lit('"')) for p in parts]
    return F.sha2(F.concat_ws(", ", *norm), 256)


def distinct_in_order(df: DataFrame, line: str, pos: str) -> DataFrame:
    """Distinct lines with their counts, known by where they were first seen."""
    return df.groupBy(line).agg(F.count(F.lit(1)).alias("count"), F.min(pos).alias("first_pos"))


def least_overlap(n: int, m: int, least: float) -> int:
    """The smallest overlap at which sets of n and m tokens have a Jaccard similarity of at least `least`; more than both hold where there is none."""
    return next((o for o in range(max(1, int(least * (n + m) / (1 + least)) - 1), min(n, m) + 1) if o / (n + m - o) >= least), min(n, m) + 1)


def shared_picks(n: int, m: int, least: float) -> int:
    """How many tokens a key for pairs of sets of n and m tokens joins: as many as keep the keys of a set for all sizes of similar sets within KEYS, or one."""
    o, top = least_overlap(n, m, least), max(n, m)
    most = KEYS // (int(top / least) - int(top * least) + 1)
    return next((picks for picks in range(o, 1, -1) if comb(top - o + picks, picks) <= most), 1)


def _keys(least: float, sizes: list[int]):
    """Batches of (block, id, hashes of a set's tokens from rare to frequent) as a row a key: its digest, the id, and whether the set is the smaller (0) or larger (1) of a pair or either (2)."""
    plans: dict[int, set[tuple[int, str, int, int]]] = {n: set() for n in sizes}
    for n in sizes:
        for m in sizes:
            o = least_overlap(n, m, least)
            if n <= m and o <= n:
                picks = shared_picks(n, m, least)
                for side, size in enumerate((n, m)):
                    # keys of one token serve all sizes, with the prefix of the least overlap that a set of this size may need
                    need = o if picks > 1 else next(x for x in range(1, size + 1) if x / size >= least)
                    plans[size].add((2 if n == m or picks == 1 else side, f"{n}:{m}" if picks > 1 else "", size - need + picks, picks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sides, digests = [], [], []

            def made() -> pa.RecordBatch:
                taken = batch.column(1).take(pa.array(ids, pa.int64()))
                return pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), taken, pa.array(sides, pa.int8())], ["digest", "id", "side"])

            for i, (block, tokens) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                words = [t.to_bytes(8, "little", signed=True) for t in tokens]
                for side, name, prefix, picks in plans[len(words)]:
                    start = blake2b(f"{name}:{block}:".encode(), digest_size=16)
                    for chosen in combinations(words[:prefix], picks):
                        key = start.copy()
                        key.update(b"".join(chosen))
                        digests.append(key.digest())
                        ids.append(i)
                        sides.append(side)
                if len(ids) >= 100_000:
                    yield made()
                    ids, sides, digests = [], [], []
            if ids:
                yield made()

    return run


def jaccard_pairs(df: DataFrame, key: str, block: str, tokens: str, least: float) -> DataFrame:
    """Pairs (a < b) of a block whose token sets have a Jaccard similarity of at least `least`.

    Prefix filtering with several tokens a key: tokens are ranked from rare to frequent, and sets of n and m tokens
    that must share o of them share k within the first n - o + k of the one and m - o + k of the other. So each set gives, for each size
    that a similar set has, a key for every choice of k tokens of its prefix; k is as large as KEYS keys a set allow: all o
    tokens for sets of up to about nine, whose meetings are then the pairs themselves, and one for sets of over about fifty. Frequent tokens so hardly ever pair rows, even where
    all tokens are frequent. Rows that meet are compared by their tokens. Empty sets have no pairs; a null block has none either.
    """
    named = df.select(F.col(key).alias("id"), F.col(block).alias("block"), F.array_distinct(tokens).alias("t")).where((F.size("t") > 0) & F.col("block").isNotNull())
    sets = checkpointed(named)
    each = sets.select("id", "block", F.explode("t").alias("token"))
    counts = each.groupBy("block", "token").agg(F.count(F.lit(1)).alias("c"))
    ordered = each.join(counts, ["block", "token"]).groupBy("id", "block").agg(F.array_sort(F.collect_list(F.struct("c", F.xxhash64("token").alias("h"), "token"))).alias("s"))
    sizes = [r[0] for r in sets.select(F.size("t")).distinct().collect()]
    kind = sets.schema["id"].dataType.simpleString()
    given = ordered.select(F.col("block").cast("string").alias("block"), "id", F.transform("s", lambda x: x["h"]).alias("h"))
    keys = checkpointed(given.mapInArrow(_keys(least, sizes), f"digest binary, id {kind}, side tinyint"))
    small, large = (keys.where(F.col("side") != other).select("digest", F.col("id").alias(c), F.col("side").alias(f"{c}_side")) for other, c in ((1, "x"), (0, "y")))
    met = small.join(large, "digest").where("if(x_side = 2, x < y, x <> y)").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    side = lambda c: sets.select(F.col("id").alias(c), F.col("t").alias(f"t{c}"), F.col("block").alias(block))
    common = F.size(F.array_intersect("ta", "tb"))
    similarity = common / (F.size("ta") + F.size("tb") - common)
    return met.join(side("a"), "a").join(side("b"), ["b", block]).select(block, "a", "b", similarity.alias("similarity")).where(F.col("similarity") >= least)


def scanned(left: DataFrame) -> DataFrame:
    """(id, kept) of undecided rows by the sequential scan in one task, from edges (a, b, ak) to earlier rows that aren't dropped."""
    kind = left.schema["b"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        kept = set(pdf["a"][pdf["ak"] == "kept"])
        earlier: dict = {}
        for a, b in zip(pdf["a"], pdf["b"], strict=True):
            earlier.setdefault(b, []).append(a)
        ids = sorted(set(pdf["a"][pdf["ak"] == "open"]) | set(earlier))
        decided = []
        for i in ids:
            decided.append(kept.isdisjoint(earlier.get(i, ())))
            if decided[-1]:
                kept.add(i)
        return pd.DataFrame({"id": ids, "kept": decided})

    return left.withColumn("_g", F.lit(0)).groupBy("_g").applyInPandas(run, f"id {kind}, kept boolean")


def greedy_keep(df: DataFrame, key: str, pairs: DataFrame) -> DataFrame:
    """Rows that a scan in key order keeps, where a row goes if a kept earlier one is similar.

    In rounds, until no row is undecided: an undecided row with a kept earlier
    neighbour is dropped, and one whose earlier neighbours are all dropped is kept;
    the result is that of the sequential scan. Each round's decisions are a
    checkpointed table of the rows with pairs only. Long chains decide about a row
    a round, so after ROUNDS rounds the rest is scanned in one task once it has SCAN_EDGES edges at most.
    """
    edges = checkpointed(pairs.select("a", "b"))
    state = checkpointed(edges.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("kept", F.lit(None).cast("boolean")))
    done = 0
    while not state.where("kept is null").isEmpty():
        if done >= ROUNDS:
            is_open = state.where("kept is null").select(F.col("id").alias("b"))
            ends = state.where("kept is null or kept").select(F.col("id").alias("a"), F.when(F.col("kept"), "kept").otherwise("open").alias("ak"))
            left = checkpointed(edges.join(is_open, "b", "left_semi").join(ends, "a"))
            if left.count() <= SCAN_EDGES:
                found = scanned(left).withColumnRenamed("kept", "found")
                state = checkpointed(state.join(found, "id", "left").select("id", F.coalesce("kept", "found", F.lit(True)).alias("kept")))
                break
        earlier = edges.join(state.select(F.col("id").alias("a"), F.col("kept").alias("ak")), "a").groupBy("b").agg(
            F.coalesce(F.max("ak"), F.lit(False)).alias("any_kept"), F.max(F.col("ak").isNull()).alias("any_open")
        )
        joined = state.join(earlier, state["id"] == earlier["b"], "left")
        decided = F.when(F.col("any_kept"), F.lit(False)).when(F.coalesce("any_open", F.lit(False)), F.lit(None).cast("boolean")).otherwise(F.lit(True))
        state = checkpointed(joined.select("id", F.coalesce("kept", decided).alias("kept")))
        done += 1
    gone = state.where("kept = false").select(F.col("id").alias(key))
    return df.join(gone, key, "left_anti")


def quota_split(df: DataFrame, strata: list[str], key: str, share: float, seed: int = 42) -> DataFrame:
    """`split` is "val" for about `share` of each stratum, at least one row where it has two, else "train".

    Rows of a stratum are ranked by a hash of their key, so the split depends on no
    order of files and each stratum is its own group.
    """
    w = Window.partitionBy(*strata)
    rank = F.row_number().over(w.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key))
    n = F.count(F.lit(1)).over(w)
    quota = F.when(n < 2, F.lit(0)).otherwise(F.greatest(F.floor(n * F.lit(share)), F.lit(1)))
    return df.withColumn("split", F.when(rank <= quota, F.lit("val")).otherwise(F.lit("train")))


def best_of(df: DataFrame, groups: list[str], *order: Column) -> DataFrame:
    """The first row of each group in an order."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).where("_k = 1").drop("_k")


def priced(orders: DataFrame, key: str, items: str, table: DataFrame, item: str, price: str) -> DataFrame:
    """(key, total): quantity times price over an order's list of items (structs of id and quantity), by a lookup in list order; unknown items add nothing."""
    listed = orders.select(key, F.posexplode(items).alias("pos", "_i")).select(key, "pos", F.col("_i.id").alias(item), F.col("_i.quantity").alias("_q"))
    return listed.join(table.select(item, price), item).groupBy(key).agg(F.sum(F.col("_q") * F.col(price)).alias("total"))


def statement(df: DataFrame, keys: list[str], amount: str, debit: Column) -> DataFrame:
    """Debits and credits by key: conditional sums in one pass."""
    part = lambda c: F.sum(F.when(c, F.col(amount)).otherwise(0.0))
    return df.groupBy(*keys).agg(part(debit).alias("debits"), part(~F.coalesce(debit, F.lit(False))).alias("credits"))


def last_n(df: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The last n rows of each key with the number of all: a top-k report."""
    w = Window.partitionBy(key)
    ranked = df.withColumn("total", F.count(F.lit(1)).over(w)).withColumn("_k", F.row_number().over(w.orderBy(F.desc(order))))
    return ranked.where(F.col("_k") <= n).drop("_k")
