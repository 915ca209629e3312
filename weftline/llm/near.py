"""Near copies by word shingles: ball hashing and MinHash bands find candidates, exact Jaccard similarity decides.

Ball hashing alone (simhash.py) misses most copies of a similarity between 0.8
and 0.9, whose fingerprints differ in six to twelve bits. So every text also gets
BANDS keys of BAND_ROWS minimum hashes each, and texts with a key in common are
candidates as well: at a similarity of 0.8 one of the keys is equal with a
probability of 1 - (1 - 0.8 ** 5) ** 16, or 0.998.

A bucket holds the texts with one key, or with fingerprints that balls join. Every pair in
a bucket is decided, but for those that links have already joined: first each text meets one
head; then small buckets are compared in full, and texts of large buckets meet a head of the bucket's
largest component; last what is still apart in a large bucket is compared in full, block by
block: two blocks of sets meet in a task, so a set moves once for a whole block of partners.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import bounded_batches, checkpointed, give_back, small_or_shuffled
from weftline.llm.components import stars
from weftline.llm.simhash import SEED, SHINGLES_AT_ONCE, linked_pairs, majority, one_of_each, shingle_hashes, text_key

WORDS = 5
LEAST = 0.8
BANDS = 16
BAND_ROWS = 5
#: Shingles that are hashed by all functions at once.
AT_ONCE = 4096
#: Members up to which a bucket's pairs are listed one by one.
SMALL = 6
#: Sets and shingles that a block of a large bucket should hold.
BLOCK, BLOCK_SHINGLES = 64, 1 << 19

_DRAWS = np.random.default_rng(SEED).integers(0, 1 << 63, (3, BANDS * BAND_ROWS), np.uint64)
_FLIPS, _FACTORS, _MIXERS = _DRAWS[0][:, None], (_DRAWS[1] * np.uint64(2) + np.uint64(1))[:, None], _DRAWS[2] * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None, k: int = WORDS) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted; texts of fewer words are one shingle, those of none are alike."""
    hashes = [np.unique(part) for part in shingle_hashes(text, k)]
    return np.unique(np.concatenate(hashes)) if hashes else np.zeros(1, np.uint64)


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """BANDS keys, each of BAND_ROWS minimum hashes and told apart by its number."""
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), AT_ONCE):
        np.minimum(least, ((shingles[None, i : i + AT_ONCE] ^ _FLIPS) * _FACTORS).min(1), out=least)
    mixed = (least ^ least >> np.uint64(31)) * _MIXERS
    mixed = (mixed ^ mixed >> np.uint64(29)).reshape(BANDS, BAND_ROWS)
    return np.bitwise_xor.reduce(mixed, 1)


def signatures(docs: DataFrame, k: int = WORDS) -> DataFrame:
    """doc_id, text_key, set_key, fp, size (distinct shingles) and keys for every row; null texts count as empty.

    set_key is a digest of 128 bits of the set of shingles: texts with one key are alike and are one node.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            prints, sizes, keys, digests = np.zeros(len(texts), np.uint64), np.zeros(len(texts), np.int32), np.zeros((len(texts), BANDS), np.uint64), []
            for i, text in enumerate(texts):
                parts = list(shingle_hashes(text, k))
                own = np.unique(np.concatenate(parts)) if parts else np.zeros(1, np.uint64)
                prints[i], sizes[i], keys[i] = majority(parts), len(own), band_keys(own)
                digests.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * BANDS), pa.array(keys.reshape(-1).view(np.int64)))
            columns = [batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(prints.view(np.int64)), pa.array(sizes), lists]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "set_key", "fp", "size", "keys"])
            give_back()

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_key().alias("text_key"), "text").mapInArrow(run, "doc_id long, text_key long, set_key binary, fp long, size int, keys array<long>")


def shingle_sets(ids: DataFrame, docs: DataFrame, k: int = WORDS) -> DataFrame:
    """node and its sorted shingle hashes, for ids (node, and doc_id and text_key of one of its rows). Stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, k) for t in batch.column(1).to_pylist()]
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets], dtype=np.int32)]).astype(np.int32)
            values = np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], ["node", "shingles"])
            give_back()

    bounded_batches(docs.sparkSession)
    named = small_or_shuffled(ids.select("node", F.col("doc_id").alias("id_2"), F.col("text_key").alias("key_2")), 24)
    own = (F.col("text_key") == F.col("key_2")) & F.col("doc_id").eqNullSafe(F.col("id_2"))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_key().alias("text_key"), "text").join(named, own).select("node", "text")
    sets = texts.mapInArrow(run, "node long, shingles array<long>")
    return checkpointed(sets.groupBy("node").agg(F.first("shingles").alias("shingles")))


def fits(a: str, b: str, least: float) -> Column:
    """Whether two sizes allow the similarity."""
    return F.least(a, b) / F.greatest(a, b) >= F.lit(least)


def verified(pairs: DataFrame, sets: DataFrame, least: float = LEAST) -> DataFrame:
    """The pairs (nodes a and b, roots ra and rb) whose shingle sets have a Jaccard similarity of at least `least`. Only the sets of these nodes move. Stored."""
    ids = checkpointed(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    own = sets.join(small_or_shuffled(ids, 16), "node", "left_semi")
    one, two = (own.select(F.col("node").alias(c), F.col("shingles").alias(f"s{c}")) for c in ("a", "b"))
    both = pairs.join(one, "a").join(two, "b").withColumn("common", F.size(F.array_intersect("sa", "sb")))
    return checkpointed(both.where(F.col("common") / (F.size("sa") + F.size("sb") - F.col("common")) >= F.lit(least)).select(*pairs.columns))


def as_pair(x: Column, y: Column) -> list[Column]:
    """a, b, ra and rb of two members (structs of node and root)."""
    return [x["node"].alias("a"), y["node"].alias("b"), F.least(x["root"], y["root"]).alias("ra"), F.greatest(x["root"], y["root"]).alias("rb")]


def to_one_head(placed: DataFrame, least: float) -> DataFrame:
    """Pairs: each node with one head of its buckets, that which most of them have. A bucket's head is the node of the least hash."""
    other = F.struct(F.xxhash64("node").alias("h"), "node", "size")
    heads = checkpointed(placed.groupBy("nth", "key").agg(F.min(other).alias("o")))
    met = placed.join(heads, ["nth", "key"]).where(F.col("node") != F.col("o.node")).where(fits("size", "o.size", least)).groupBy("node", F.col("o.node").alias("other")).agg(F.count(F.lit(1)).alias("n"))
    return met.groupBy("node").agg(F.max_by("other", F.struct("n", "other")).alias("other")).select(
        F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct().select("a", "b", F.col("a").alias("ra"), F.col("b").alias("rb"))


def within_small(placed: DataFrame, small: DataFrame, least: float) -> DataFrame:
    """All pairs of different roots within buckets of up to SMALL members."""
    met = placed.join(small, ["nth", "key"]).groupBy("nth", "key").agg(F.sort_array(F.collect_list(F.struct("node", "size", "root"))).alias("m"))
    one = met.select("m", F.posexplode("m").alias("i", "x")).select("x", F.explode(F.slice("m", F.col("i") + 2, F.size("m"))).alias("y"))
    return one.where((F.col("x.root") != F.col("y.root")) & fits("x.size", "y.size", least)).select(*as_pair(F.col("x"), F.col("y")))


def main_roots(placed: DataFrame) -> DataFrame:
    """nth, key, main (the root that most members have) and a head of it, for buckets of more than one root. Aggregates only. Stored."""
    by_root = placed.groupBy("nth", "key", "root").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.xxhash64("node", F.lit(1)).alias("h"), "node", "size", "root")).alias("head"))
    return checkpointed(by_root.groupBy("nth", "key").agg(F.max(F.struct("n", "root", "head")).alias("m"), F.count(F.lit(1)).alias("roots")).where("roots > 1").select("nth", "key", F.col("m.root").alias("main"), F.col("m.head").alias("head")))


def to_main_heads(placed: DataFrame, heads: DataFrame, least: float) -> DataFrame:
    """Pairs: nodes outside a bucket's main root with its head."""
    met = placed.join(heads, ["nth", "key"]).where(F.col("root") != F.col("main")).where(fits("size", "head.size", least))
    return met.select(*as_pair(F.struct("node", "root"), F.col("head")))


def linked_in_blocks(placed: DataFrame, heads: DataFrame, sets: DataFrame, least: float = LEAST) -> DataFrame:
    """Links (ra, rb) between roots, found among all pairs of different roots in the buckets of `heads`. Stored.

    The members of a bucket's main root and the others are dealt to blocks by hashes, as many as their number and the
    size of their sets ask for. Each block of others meets each block of both kinds in a group of its own, of a
    bounded size but for single texts that exceed it alone; pairs within the main root need no comparison.
    """
    marked = placed.join(heads.select("nth", "key", "main"), ["nth", "key"]).withColumn("other", F.col("root") != F.col("main"))
    blocks = lambda of: F.greatest(F.ceil(F.count(F.when(of, 1)) / BLOCK), F.ceil(F.sum(F.when(of, F.col("size")).otherwise(0)) / BLOCK_SHINGLES)).cast("int")
    counts = checkpointed(marked.groupBy("nth", "key").agg(blocks(F.col("other")).alias("no"), blocks(~F.col("other")).alias("nm")))
    dealt = marked.join(counts, ["nth", "key"]).withColumn("own", F.pmod(F.xxhash64("node"), F.when(F.col("other"), F.col("no")).otherwise(F.col("nm"))).cast("int"))
    # group (i, j): block i of the others with block j of the others (j >= i, counted on after the main ones) or of the main ones
    upto = lambda a, b: F.filter(F.sequence(a, F.greatest(a, b)), lambda x: x <= b)
    zero, last = F.lit(0), F.col("no") - 1
    as_first = F.transform(F.concat(upto(zero, F.col("nm") - 1), upto(F.col("nm") + F.col("own"), F.col("nm") + last)), lambda j: F.struct(F.col("own").alias("i"), j.alias("j"), F.lit(True).alias("first")))
    as_second = F.transform(upto(zero, F.col("own") - 1), lambda i: F.struct(i.alias("i"), (F.col("nm") + F.col("own")).alias("j"), F.lit(False).alias("first")))
    as_main = F.transform(upto(zero, last), lambda i: F.struct(i.alias("i"), F.col("own").alias("j"), F.lit(False).alias("first")))
    placed_in = dealt.select("nth", "key", "node", "root", F.explode(F.when(F.col("other"), F.concat(as_first, as_second)).otherwise(as_main)).alias("g"))
    groups = placed_in.select("nth", "key", "g.i", "g.j", "g.first", "node", "root").join(sets, "node")

    def compare(table: pa.Table) -> pa.Table:
        first, roots = (table.column(c).to_numpy() for c in ("first", "root"))
        lists = table.column("shingles").combine_chunks()
        ends, values = lists.offsets.to_numpy(), lists.values.to_numpy()
        sizes = np.diff(ends)
        firsts, seconds = np.flatnonzero(first), np.flatnonzero(~first)
        if not len(seconds):  # a block with itself
            seconds = firsts
        held = np.concatenate([values[ends[x] : ends[x + 1]] for x in firsts])
        owner = np.repeat(np.arange(len(firsts)), sizes[firsts])
        order = np.argsort(held, kind="stable")
        held, owner = held[order], owner[order]
        joined = set()
        for y in seconds:
            own = values[ends[y] : ends[y + 1]]
            begin, end = np.searchsorted(held, own, "left"), np.searchsorted(held, own, "right")
            hits = np.repeat(begin, end - begin) + np.arange((end - begin).sum()) - np.repeat(np.cumsum(end - begin) - (end - begin), end - begin)
            common = np.bincount(owner[hits], minlength=len(firsts))
            alike = (common >= least * (sizes[firsts] + sizes[y] - common)) & (roots[firsts] != roots[y])
            joined.update((min(x, roots[y]), max(x, roots[y])) for x in roots[firsts[alike]])
        return pa.table({"ra": pa.array([int(x[0]) for x in joined], pa.int64()), "rb": pa.array([int(x[1]) for x in joined], pa.int64())})

    return checkpointed(groups.select("nth", "key", "i", "j", "first", "root", "shingles").groupBy("nth", "key", "i", "j").applyInArrow(compare, "ra long, rb long").distinct())


def near_copies(docs: DataFrame, k: int = WORDS, least: float = LEAST) -> DataFrame:
    """doc_id, text_key and root for every row: rows with one root are joined by links of verified near copies.

    Texts of equal shingle sets are one node. Nodes that share a band's key, or whose fingerprints balls
    join, lie in a bucket; every pair of a bucket is compared unless links have joined it before, so no link between
    two texts of a bucket is lost, whatever the bucket's size. Links are exact similarities of at least `least`.

    Null and empty texts are alike; repeated rows are one node and share its root;
    long texts are taken whole; only doc_id and text are read; no rows give none.
    """
    rows = checkpointed(signatures(docs, k))
    own = F.struct("doc_id", "text_key")
    nodes = rows.groupBy("set_key").agg(F.first("fp").alias("fp"), F.first("size").alias("size"), F.first("keys").alias("keys"), F.min(own).alias("of"))
    nodes = checkpointed(nodes.withColumn("node", F.monotonically_increasing_id()))
    prints = checkpointed(nodes.select("fp").distinct())
    balls = stars(linked_pairs(prints, prints.count()))
    ball = nodes.join(small_or_shuffled(checkpointed(balls.toDF("fp", "ball")), 16), "fp", "left").select("node", "size", F.lit(-1).alias("nth"), F.coalesce("ball", "fp").alias("key"))
    placed = nodes.select("node", "size", F.posexplode("keys").alias("nth", "key")).unionByName(ball)
    buckets = checkpointed(placed.groupBy("nth", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    placed = checkpointed(placed.join(small_or_shuffled(buckets.select("nth", "key"), 24), ["nth", "key"]))
    in_some = checkpointed(placed.select("node").distinct())
    sets = shingle_sets(checkpointed(nodes.join(small_or_shuffled(in_some, 16), "node", "left_semi").select("node", "of.doc_id", "of.text_key")), docs, k)

    def rooted(part: DataFrame) -> DataFrame:
        return part.join(small_or_shuffled(roots, 16), "node", "left").withColumn("root", F.coalesce("root", "node"))

    def joined(found: DataFrame) -> DataFrame:
        """Roots after links between roots: only these are joined into components, and nodes follow theirs."""
        new = checkpointed(stars(found.select(F.col("ra").alias("a"), F.col("rb").alias("b"))))
        follow = small_or_shuffled(new.toDF("was", "now"), 16)
        return checkpointed(roots.join(follow, F.col("root") == F.col("was"), "left").select("node", F.coalesce("now", "root").alias("root")).union(new))

    roots = checkpointed(stars(verified(checkpointed(to_one_head(placed, least)), sets, least).select("a", "b")))
    here = checkpointed(rooted(placed))
    small = small_or_shuffled(buckets.where(F.col("n") <= SMALL).select("nth", "key"), 24)
    large = here.join(small_or_shuffled(buckets.where(F.col("n") > SMALL).select("nth", "key"), 24), ["nth", "key"])
    pairs = within_small(here, small, least).union(to_main_heads(large, main_roots(large), least)).distinct()
    roots = joined(verified(checkpointed(pairs), sets, least))
    here = checkpointed(rooted(large.drop("root")))
    roots = joined(linked_in_blocks(here, main_roots(here), sets, least))
    labels = checkpointed(nodes.join(small_or_shuffled(roots, 16), "node", "left").select("set_key", F.coalesce("root", "node").alias("root")))
    return rows.join(labels, "set_key").select("doc_id", "text_key", "root")


def without_near_copies(docs: DataFrame, k: int = WORDS, least: float = LEAST) -> DataFrame:
    """The documents of which no near copy with a smaller doc_id is linked, with all their columns."""
    return one_of_each(docs, near=near_copies(docs, k, least))
