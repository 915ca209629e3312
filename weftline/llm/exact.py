"""Exact dedup that parts heavy hitters from the rest, in DataFrame operations only.

Every text is read once, for its digest. Misra-Gries counters find the digests that a
stated share of all rows has: the sketches of Spark's approx_top_k keep a bounded number
of counters and decrement all of them when they run out. Tasks fill them, WAYS groups of
tasks merge theirs, and one row is left; candidates are then counted exactly. The
verified winners (at most HEAVY rows) are broadcast, so the rows of a large group of
copies are decided where they lie. Other digests have too few rows each to burden a task
and are shuffled as usual, without their texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import checkpointed, quoted

#: Counters of a sketch. A digest with more than about 7 / COUNTERS of the rows is always among the candidates.
COUNTERS = 10_000
#: Candidates at most: there are no more digests than this with one row in HEAVY.
HEAVY = 1000
#: Groups of tasks whose sketches are merged first.
WAYS = 256

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(text: str = "text") -> Column:
    """SHA-256 (hex) of a text whose letters A-Z are lower case; null counts as empty.

    Texts of as many bytes as characters have no other letters, so the faster lower() does the same there.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    lowered = F.when(F.octet_length(whole) == F.char_length(whole), F.lower(whole)).otherwise(F.translate(whole, UPPER, LOWER))
    return F.sha2(lowered.cast("binary"), 256)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, row (a number of its own) and sha of every row, stored, so that later steps don't read the texts again."""
    return checkpointed(docs.select(F.col("doc_id"), digest().alias("sha")).withColumn("row", F.monotonically_increasing_id()))


def frequent(rows: DataFrame) -> DataFrame:
    """sha of the digests that Misra-Gries counters hold in the end, at most HEAVY rows; all with a share over 1 / HEAVY are among them."""
    tasks = rows.select("sha", F.pmod(F.spark_partition_id(), F.lit(WAYS)).alias("way"))
    # grouped by a value that all rows share: a partition without rows would give an empty sketch, which can't be merged
    one = F.pmod("way", F.lit(1))
    merged = tasks.groupBy("way").agg(F.expr(f"approx_top_k_accumulate(sha, {COUNTERS})").alias("k")).groupBy(one.alias("one")).agg(
        F.expr(f"approx_top_k_estimate(approx_top_k_combine(k, {COUNTERS}), {HEAVY})").alias("top")
    )
    return merged.select(F.explode("top.item").alias("sha"))


def winners(rows: DataFrame) -> DataFrame:
    """sha, keep (doc_id, row) and n of the heavy digests, counted over all rows: at most HEAVY rows, which may be broadcast."""
    found = checkpointed(frequent(rows))
    counted = rows.join(F.broadcast(found), "sha").groupBy("sha").agg(F.max(order()).alias("keep"), F.count(F.lit(1)).alias("n"))
    return checkpointed(counted.where("n > 1"))


def order() -> Column:
    """The largest is the row that stays: of the largest doc_id, nulls before all others, and of equal ones any single row."""
    return F.struct(F.col("doc_id"), F.col("row"))


def decisions(docs: DataFrame) -> DataFrame:
    """For every row of docs: doc_id, keep_id, group_size, kept and text_sha256.

    Texts are equal when they are identical after A-Z are lowered; of equal texts the
    row with the largest doc_id stays. Null texts count as empty ones. A null doc_id
    comes before all others, so keep_id is null only for groups that have no other;
    of rows that share the doc_id that stays exactly one is kept. No rows give none;
    other columns aren't read.
    """
    rows = digests(docs)
    heavy = F.broadcast(winners(rows))
    told = lambda keep, n: ("doc_id", F.col(f"{keep}.doc_id").alias("keep_id"), F.col(n).alias("group_size"), (F.col(f"{keep}.row") == F.col("row")).alias("kept"), F.col("sha").alias("text_sha256"))
    own = Window.partitionBy("sha")
    light = rows.join(heavy.select("sha"), "sha", "left_anti").select("doc_id", "row", "sha", F.max(order()).over(own).alias("keep"), F.count(F.lit(1)).over(own).alias("n"))
    return rows.join(heavy, "sha").select(*told("keep", "n")).unionByName(light.select(*told("keep", "n")))


def without_copies(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns, whatever their names.

    Rows of heavy digests that don't have the winner's doc_id go where they lie; what is left is
    aggregated by digest, first within tasks, so that repeated rows of one doc_id don't meet either.
    """
    heavy = winners(digests(docs)).select(F.col("sha"), F.col("keep.doc_id").alias("best"), F.lit(True).alias("big"))
    packed = docs.select(F.col("doc_id"), digest().alias("sha"), F.struct(*map(quoted, docs.columns)).alias("whole"))
    left = packed.join(F.broadcast(heavy), "sha", "left").where(F.col("big").isNull() | F.col("doc_id").eqNullSafe(F.col("best")))
    # max_by passes over null keys, so a null doc_id is told by a struct
    kept = left.groupBy("sha").agg(F.max_by("whole", F.struct(F.col("doc_id"))).alias("whole"))
    return kept.select(*[F.col("whole").getField(c).alias(c) for c in docs.columns])


ORACLE = f"""
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept, text_sha256
FROM d
WINDOW w AS (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST)
"""
