"""Mixing sources to target weights by systematic sampling, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import WORD, checkpointed, quoted, small_or_shuffled

#: Fixed by the query's contract: sources in code-point order weigh 3, 1, 2, and so on.
CYCLE = (3, 1, 2)
SHARE = 1.5
MOST_COPIES = 2.0

#: Rows of a hash bucket at most, on average, before buckets take another hex digit.
BUCKET_ROWS = 200_000

#: Sources as keys that are never null and sort as the contract orders them, null last.
SOURCE_KEY = "coalesce(concat('s', source), 't')"


def unit_hash(col: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5; other SQL engines can repeat it."""
    return F.conv(F.substring(F.md5(col), 1, 13), 16, 10).cast("bigint") / F.lit(float(2**52))


def text_key() -> Column:
    """Tells texts apart, null from empty too."""
    return F.xxhash64("text", F.col("text").isNull())


def source_targets(sized: DataFrame, cycle=CYCLE, share: float = SHARE, most: float = MOST_COPIES) -> DataFrame:
    """Words each source should give: `share` of all words by weight, at most `most` times its own.

    The excess over a source's limit goes to the others by weight until none is
    above. That fixed point is a water level: targets are least(limit, level *
    weight). Sources are sorted by limit / weight; with all before a source filled,
    the rest share one level, which rises up to the first source whose limit it does
    not reach and falls after it: so the highest level below its source's limit is
    the one. Prefix sums run over the (few) sources. A source of no words gets 0.
    Input: src, size. Output: src, source_size, target, rate.
    """
    totals = sized.groupBy("src").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy("src")) - 1
    weights = F.array(*[F.lit(float(x)) for x in cycle])
    everything = Window.partitionBy()
    before = Window.orderBy("full_at", "src").rowsBetween(Window.unboundedPreceding, -1)
    sum_before = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0.0))
    limit = most * F.col("source_size")
    levels = (
        totals.withColumn("weight", F.get(weights, F.pmod(rank, F.lit(len(cycle)))))
        .withColumn("full_at", limit / F.col("weight"))
        .withColumn("wanted", share * F.sum("source_size").over(everything) - sum_before(limit))
        .withColumn("open_weight", F.sum("weight").over(everything) - sum_before(F.col("weight")))
        .withColumn("here", F.col("wanted") / F.col("open_weight"))
        .withColumn("level", F.max(F.when(F.col("here") <= F.col("full_at"), F.col("here"))).over(everything))
        .withColumn("target", F.coalesce(F.least(limit, F.col("level") * F.col("weight")), limit))
    )
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return levels.select("src", "source_size", "target", rate.alias("rate"))


def decided(docs: DataFrame, seed: int = 17, cycle=CYCLE, share: float = SHARE, most: float = MOST_COPIES) -> DataFrame:
    """How many copies of each document a mix takes.

    Systematic sampling: the expected copies of the documents of a source (its
    rate each) are prefix-summed, one random offset a source is added, and a copy
    is emitted for each integer boundary crossed. Documents lie in the order of
    size class, then hash, so that every size is sampled evenly and the words
    taken come near the target. The prefix sum is made in two levels: counts of
    (source, size class, hash bucket) give where a bucket begins, and row numbers
    run within buckets only, whose number grows with the rows, so a source with a
    third of all rows spreads over thousands of windows.

    A null text has size 0; a null source is a source of its own, last in order;
    documents of size 0 get copies like others but add no words; repeated rows
    count each; no rows give no rows. Only doc_id, text and source are read.
    Returns doc_id, src, text_key, size, source_size, target, copies.
    """
    words = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("bigint")
    # where a row lies among those of its source and size: told by its text as well, so that rows of one id, or of none, are spread like others
    spot = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5(F.coalesce("text", F.lit("")))))
    sized = checkpointed(docs.select("doc_id", F.expr(SOURCE_KEY).alias("src"), text_key().alias("text_key"), words.alias("size"), spot.alias("spot")))
    digits, hashed, n = F.col("size").cast("string"), 2, sized.count()
    while n > 16**hashed * BUCKET_ROWS:
        hashed += 1
    placed = (
        sized
        .withColumn("class", F.length(digits) * 100 + F.substring(digits, 1, 2).cast("int"))
        .withColumn("bucket", F.substring("spot", 1, hashed))
        .withColumn("nth", F.row_number().over(Window.partitionBy("src", "class", "bucket").orderBy("spot", "size", "text_key")))
    )
    first = Window.partitionBy("src").orderBy("class", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    begins = (
        placed.groupBy("src", "class", "bucket").agg(F.count(F.lit(1)).alias("n"))
        .select("src", "class", "bucket", F.coalesce(F.sum("n").over(first), F.lit(0)).alias("begins"))
        .join(source_targets(sized, cycle, share, most), "src")
    )
    offset = unit_hash(F.concat(F.lit(f"{seed}:"), F.col("src")))
    crossed = lambda pos: F.floor(pos * F.col("rate") + offset)
    pos = F.col("begins") + F.col("nth")
    return (
        placed.join(begins, ["src", "class", "bucket"])
        .withColumn("copies", F.least(crossed(pos) - crossed(pos - 1), F.lit(int(most))).cast("bigint"))
        .select("doc_id", "src", "text_key", "size", "source_size", "target", "copies")
    )


def mix(docs: DataFrame, seed: int = 17, cycle=CYCLE, share: float = SHARE, most: float = MOST_COPIES) -> DataFrame:
    """The decisions as doc_id, source, size, source_size, target, copies, taken."""
    return decided(docs, seed, cycle, share, most).select(
        "doc_id", F.when(F.col("src") != "t", F.expr("substring(src, 2)")).alias("source"), "size",
        "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"),
    )


def mixed(docs: DataFrame, seed: int = 17, cycle=CYCLE, share: float = SHARE, most: float = MOST_COPIES) -> DataFrame:
    """The documents as the mix takes them: each row as often as it has copies, with all its columns.

    Rows are told apart by doc_id, source and text. Rows equal in all three whose
    copies differ are numbered, and their total is dealt out over them. Null ids,
    sources and texts are values like others; other columns may have any names; no
    rows give none.
    """
    key = ["doc_id", "src", "text_key"]
    taken = checkpointed(decided(docs, seed, cycle, share, most).groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"), F.sum("copies").alias("total"), F.min("copies").alias("least"), F.max("copies").alias("most")))
    # the columns of docs travel in a struct, so that no name of theirs meets a name made here
    keyed = docs.select(F.col("doc_id"), F.expr(SOURCE_KEY).alias("src"), text_key().alias("text_key"), F.struct(*map(quoted, docs.columns)).alias("row"))

    def joined(table: DataFrame, row_bytes: int) -> DataFrame:
        named = small_or_shuffled(table.withColumnsRenamed({c: f"{c}_2" for c in key}), row_bytes)
        return keyed.join(named, (F.col("src") == F.col("src_2")) & (F.col("text_key") == F.col("text_key_2")) & F.col("doc_id").eqNullSafe(F.col("doc_id_2")))

    copied = joined(taken.where("least = most and least > 0").select(*key, F.col("least").alias("copies")), 40).select("row", "copies")
    uneven = taken.where("least < most").select(*key, "n", "total")
    if not uneven.isEmpty():
        nth = F.row_number().over(Window.partitionBy(*key).orderBy(F.md5(F.to_json("row"))))
        share_of = lambda c: F.expr(f"total * {c} div n")
        dealt = joined(uneven, 56).withColumn("nth", nth).select("row", (share_of("nth") - share_of("(nth - 1)")).alias("copies"))
        copied = copied.unionByName(dealt.where("copies > 0"))
    return copied.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


#: The same result for another SQL engine, over a table of documents.
ORACLE = """
WITH sized AS (
  SELECT doc_id, coalesce('s' || source, 't') AS src, md5('17:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))) AS spot,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size
  FROM documents),
totals AS (SELECT src, sum(size)::BIGINT AS source_size FROM sized GROUP BY src),
weighed AS (
  SELECT *, [3.0, 1.0, 2.0][1 + ((row_number() OVER (ORDER BY src) - 1) % 3)]::DOUBLE AS weight FROM totals),
filled AS (
  SELECT *, 2.0::DOUBLE * source_size / weight AS full_at FROM weighed),
levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2.0::DOUBLE * source_size) OVER b, 0))
            / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS here
  FROM filled
  WINDOW b AS (ORDER BY full_at, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT src, source_size,
         coalesce(least(2.0::DOUBLE * source_size,
                        (max(CASE WHEN here <= full_at THEN here END) OVER ()) * weight),
                  2.0::DOUBLE * source_size) AS target
  FROM levels),
ranked AS (
  SELECT s.*, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
         ('0x' || substr(md5('17:' || s.src), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS off,
         row_number() OVER (PARTITION BY s.src ORDER BY len(s.size::VARCHAR) * 100 + substr(s.size::VARCHAR, 1, 2)::INT,
                            s.spot, s.size) AS pos
  FROM sized s JOIN targets t USING (src))
SELECT doc_id, size, source_size, target,
       (least(floor(pos * rate + off) - floor((pos - 1) * rate + off), 2))::BIGINT * size AS taken
FROM ranked
"""
