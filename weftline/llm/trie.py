"""The prefix trie of conversations, from prefix digests, owned chains and sums over them.

A turn's digest is hashed with its place; the XOR of these hashes over the first d turns (two
lanes of 64 bits) is the digest of the prefix of depth d, so prefix digests are running XORs,
which can be made in parts of a conversation and joined up. A node is a depth and a prefix
digest, its owner the smallest conversation with it. Ownership is monotone: who owns a
depth owns all deeper ones, so a conversation owns one chain of nodes, from its first owned depth
to its end. That depth is found by binary search, all conversations at once: each round
joins one probe a conversation and block with the minima of shared nodes. Chains hang
on nodes of other chains; their sums are added up to all chains above by doubling pointers, in
rounds that grow with the logarithm of the height.

No conversation is gathered: rows lie in range partitions, running values carry over between
them, and searches run in blocks of BLOCK depths.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import WORD, checkpointed, partitions_for, small_or_shuffled

#: Conversations in a row that share a first one, and the most turns that may be taken from it, less one.
FAMILY, HEADS = 20, 4
#: Depths that one row of the search holds.
BLOCK = 1024
ROWS = 100_000
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), part, digest and words of every turn, stored.

    Turns are in the order of `turn`, nulls first, ties by the MD5 of role and text. Rows lie in range
    partitions (part); positions are ranks within a part plus the rows of the same conversation before it.
    """
    spark = conversations.sparkSession
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    turns = checkpointed(conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn",
        F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))).alias("digest"),
        F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("words"),
    ).withColumn("row", F.monotonically_increasing_id()))
    order = ("conv_id", "turn", "digest", F.xxhash64("row"), "row")  # repeated rows too are dealt over partitions
    placed = checkpointed(turns.repartitionByRange(partitions_for(spark, turns.count(), ROWS), *order).withColumn("part", F.spark_partition_id()))
    within = Window.partitionBy("part", "conv_id").orderBy("turn", "digest", "row")
    return carried(placed.withColumn("pos", F.row_number().over(within).cast("bigint")), "conv_id", "part", {"pos": F.max("pos")}, F.sum, lambda a, b: a + b)


def carried(df: DataFrame, key: str, part: str, totals: dict[str, Column], joined, add, descending: bool = False) -> DataFrame:
    """Columns that run within (key, part), continued over the parts of a key: the totals of the parts before are added. Most keys have one part."""
    sums = df.groupBy(key, part).agg(*[t.alias(c) for c, t in totals.items()], F.count(F.lit(1)).alias("_n"))
    order = F.col(part).desc() if descending else F.col(part)
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(key, part, *[joined(c).over(before).alias(f"_{c}") for c in totals]).where(F.col(f"_{next(iter(totals))}").isNotNull())
    out = df.join(small_or_shuffled(checkpointed(starts), 24 + 8 * len(totals)), [key, part], "left")
    return checkpointed(out.withColumns({c: F.when(F.col(f"_{c}").isNull(), F.col(c)).otherwise(add(F.col(c), F.col(f"_{c}"))) for c in totals}).drop(*[f"_{c}" for c in totals]))


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rebuilt conversations: (conv_id, size) of each, and conv_id, pos, part, digest, words of each turn.

    A conversation takes the first h turns of the first one of its family and then its own from h on;
    h is the CRC-32 of its id modulo HEADS. Both parts are stored.
    """
    turns = numbered(conversations)
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    h = F.when(base == F.col("conv_id"), 0).otherwise(F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS)
    known = sizes.select("conv_id", "n", base.alias("base"), h.alias("h"))
    firsts = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    known = checkpointed(known.join(firsts, "base", "left").select("conv_id", "base", "h", "n", F.least("h", F.coalesce("base_n", F.lit(0))).alias("taken")))
    heads = turns.where((F.col("conv_id") % FAMILY == 0) & (F.col("pos") < HEADS)).select(F.col("conv_id").alias("base"), "pos", "digest", "words")
    given = known.where("taken > 0").join(heads, "base").where("pos <= taken").select("conv_id", "pos", F.lit(-1).alias("part"), "digest", "words")
    own = turns.join(known.select("conv_id", "h", "taken"), "conv_id").where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "part", "digest", "words")
    return known.select("conv_id", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("size")), given.unionByName(own)


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, depth, words and the two lanes p, q of the prefix's digest, for every turn; stored."""
    lane = lambda k: F.xxhash64(F.lit(k), "digest", "pos")
    upto = Window.partitionBy("conv_id", "part").orderBy("pos")
    run = turns.withColumn("x", lane(1)).withColumn("y", lane(2)).select(
        "conv_id", F.col("pos").alias("depth"), "part", "words", "x", "y", F.bit_xor("x").over(upto).alias("p"), F.bit_xor("y").over(upto).alias("q"))
    return carried(run, "conv_id", "part", {"p": F.bit_xor("x"), "q": F.bit_xor("y")}, F.bit_xor, lambda a, b: a.bitwiseXOR(b)).select("conv_id", "depth", "words", "p", "q")


def minima(chain: DataFrame) -> DataFrame:
    """owner and n_convs of every (depth, p, q) that more than one conversation has; all others own themselves. Stored."""
    return checkpointed(chain.groupBy("depth", "p", "q").agg(F.min("conv_id").alias("owner"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 1"))


def first_owned(chain: DataFrame, shared: DataFrame) -> DataFrame:
    """conv_id, first (the first owned depth; one beyond the end if none is) and above (owner of the node before it; null for depth 0).

    Binary search within blocks of BLOCK depths: a row has the digests between its bounds only, so what
    rounds move shrinks by half, and rows that are done leave. The blocks of a conversation are searched
    independently; as ownership is monotone, its first owned depth is the least that a block finds.
    """
    block = F.expr(f"(depth - 1) div {BLOCK}")
    held = chain.groupBy("conv_id", block.alias("block")).agg(F.sort_array(F.collect_list(F.struct("depth", "p", "q"))).alias("left"))
    # left: the depths of which it isn't known yet whether they are owned; first: the least depth known to be owned; above: owner of the greatest known not to be
    state = checkpointed(held.select("conv_id", "left", F.lit(None).cast("bigint").alias("first"), F.lit(None).cast("bigint").alias("above"), F.element_at("left", -1)["depth"].alias("last")))
    done = []
    nodes = small_or_shuffled(shared, 40)
    while not state.isEmpty():
        probe = state.withColumn("mid", F.expr("(size(left) - 1) div 2")).withColumn("at", F.get("left", F.col("mid")))
        met = probe.join(nodes.select("depth", "p", "q", "owner"), (F.col("at.depth") == nodes.depth) & (F.col("at.p") == nodes.p) & (F.col("at.q") == nodes.q), "left")
        owned = F.coalesce(F.col("owner") == F.col("conv_id"), F.lit(True))
        state = checkpointed(met.select(
            "conv_id", F.when(owned, F.expr("slice(left, 1, mid)")).otherwise(F.expr("slice(left, mid + 2, size(left))")).alias("left"),
            F.when(owned, F.col("at.depth")).otherwise(F.col("first")).alias("first"), F.when(owned, F.col("above")).otherwise(F.col("owner")).alias("above"), "last",
        ))
        done.append(state.where(F.size("left") == 0).drop("left"))
        state = state.where(F.size("left") > 0)
    found = done[0] if done else state.drop("left")
    for more in done[1:]:
        found = found.unionByName(more)
    # the block with the first owned depth may begin with it: then the block before it, in which none is owned, knows the node above
    none = F.col("first").isNull()
    best = found.groupBy("conv_id").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.max_by("above", F.when(F.col("above").isNotNull(), F.col("last"))).alias("above"), F.max(F.when(none, F.col("last"))).alias("no"))
    return checkpointed(best.select("conv_id", F.coalesce("first", F.col("last") + 1).alias("first"), "above"))


def totals(chains: DataFrame, own: DataFrame) -> DataFrame:
    """conv_id, leaves and saved of every chain with all chains that hang below it.

    chains: conv_id and up (the chain on which it hangs, null for the root). own: conv_id, leaves, saved of
    the chain alone. Each round adds to a chain what those 1, 2, 4, ... levels below it have summed up so far.
    """
    now = checkpointed(chains.join(own, "conv_id").select("conv_id", "up", "leaves", "saved"))
    while not now.where("up IS NOT NULL").isEmpty():
        given = checkpointed(now.where("up IS NOT NULL").groupBy(F.col("up").alias("conv_id")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s")))
        up = now.where("up IS NOT NULL").select(F.col("conv_id").alias("at"), F.col("up").alias("next"))
        now = checkpointed(
            now.join(small_or_shuffled(given, 24), "conv_id", "left").join(small_or_shuffled(checkpointed(up), 16), F.col("up") == F.col("at"), "left")
            .select("conv_id", F.col("next").alias("up"), (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved"))
        )
    return now.select("conv_id", "leaves", "saved")


def end_digests(ends: DataFrame) -> DataFrame:
    """conv_id, depth and ends_sha256 of the nodes (conv_id, depth) at which conversations `who` end.

    Ids are sorted by ranges and joined to pieces within a partition; the pieces of a node, one a partition,
    are hashed in order by one task that holds one of them at a time.
    """
    spark = ends.sparkSession
    placed = ends.repartitionByRange(partitions_for(spark, ends.count(), ROWS), "conv_id", "depth", "who").withColumn("part", F.spark_partition_id())
    pieces = placed.groupBy("conv_id", "depth", "part").agg(F.array_join(F.sort_array(F.collect_list("who")).cast("array<string>"), ",").alias("piece"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha = None, None
        for batch in batches:
            out = []
            for key, piece in zip(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True), batch.column(2).to_pylist(), strict=True):
                if key == node:
                    sha.update(b",")
                else:
                    out += [(*node, sha.hexdigest())] if node else []
                    node, sha = key, hashlib.sha256()
                sha.update(piece.encode())
            yield pa.RecordBatch.from_pylist([dict(zip(("conv_id", "depth", "ends_sha256"), r, strict=True)) for r in out], schema=kind)
        if node:
            yield pa.RecordBatch.from_pylist([{"conv_id": node[0], "depth": node[1], "ends_sha256": sha.hexdigest()}], schema=kind)

    kind = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("ends_sha256", pa.string())])
    sorted_pieces = pieces.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "part").select("conv_id", "depth", "piece")
    return sorted_pieces.mapInArrow(run, "conv_id long, depth long, ends_sha256 string")


def nodes(conversations: DataFrame) -> DataFrame:
    """A row for every node of the trie of rebuilt conversations.

    conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256. Null roles and texts are empty; turns with equal `turn` are ordered by the MD5 of role and
    text, and repeated rows are turns of their own; rows of a null conv_id are of no conversation and are left
    out; no conversations give no nodes, not even the root. Only conv_id, turn, role and text are read.
    """
    sizes, turns = rebuilt(conversations)
    sizes = checkpointed(sizes)
    chain = prefixes(turns)
    shared = minima(chain)
    firsts = first_owned(chain, shared)
    root = sizes.agg(F.min("conv_id").alias("root"), F.count(F.lit(1)).alias("n")).first()
    if not root.n:
        return sizes.sparkSession.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    least = F.lit(root.root)
    known = checkpointed(sizes.join(firsts, "conv_id", "left").select("conv_id", "size", F.coalesce("first", F.lit(1)).alias("first"), F.coalesce("above", least).alias("above")))
    # the root is a chain of its own, told by a null id in `at`; conversations that own a depth have one chain each
    owned = known.where("first <= size")
    hung = checkpointed(owned.select("conv_id", F.when(F.col("first") > 1, F.col("above")).alias("at"), (F.col("first") - 1).alias("depth"), "first", "size"))
    alone = chain.join(hung.select("conv_id", "first", "size"), "conv_id").where("depth >= first")
    counts = shared.select(F.col("owner").alias("conv_id"), "depth", "n_convs")
    below = hung.where("at IS NOT NULL").groupBy(F.col("at").alias("conv_id"), "depth").agg(F.count(F.lit(1)).alias("hangs"))
    what = lambda df, **given: df.select("conv_id", "depth", *[given.get(c, F.lit(None)).cast("bigint").alias(c) for c in ("words", "first", "size", "n_convs", "hangs")])
    col = F.col
    merged = what(alone, words=col("words"), first=col("first"), size=col("size")).unionByName(what(counts, n_convs=col("n_convs"))).unionByName(what(below, hangs=col("hangs")))
    placed = checkpointed(merged.groupBy("conv_id", "depth").agg(*[F.max(c).alias(c) for c in ("words", "first", "size", "n_convs", "hangs")]).select(
        "conv_id", "depth", "first", "size", F.coalesce("n_convs", F.lit(1)).alias("n_convs"), F.coalesce("hangs", F.lit(0)).alias("hangs"),
        ((F.coalesce("n_convs", F.lit(1)) - 1) * F.col("words")).alias("saved"), ((F.col("depth") == F.col("size")) & F.col("hangs").isNull()).cast("bigint").alias("leaf"),
    ))
    own = placed.groupBy("conv_id").agg(F.sum("leaf").alias("leaves"), F.sum("saved").alias("saved"))
    whole = checkpointed(totals(hung.select("conv_id", F.col("at").alias("up")), own))
    given = hung.join(whole, "conv_id").groupBy(F.col("at").alias("to"), F.col("depth").alias("at_depth")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"), F.count(F.lit(1)).alias("n"))
    given = checkpointed(given)
    # sums from the end of a chain up to each of its nodes, in blocks
    summed = placed.join(small_or_shuffled(given.where("to IS NOT NULL"), 40), (F.col("conv_id") == F.col("to")) & (F.col("depth") == F.col("at_depth")), "left").select(
        "conv_id", "depth", "first", "size", "n_convs", "hangs", F.expr(f"depth div {BLOCK}").alias("part"),
        (F.col("leaf") + F.coalesce("l", F.lit(0))).alias("x"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("y"),
    )
    down = Window.partitionBy("conv_id", "part").orderBy(F.col("depth").desc())
    run = summed.withColumn("n_leaves", F.sum("x").over(down)).withColumn("saved_tokens", F.sum("y").over(down))
    run = carried(run, "conv_id", "part", {"n_leaves": F.sum("x"), "saved_tokens": F.sum("y")}, F.sum, lambda a, b: a + b, descending=True)
    ended = known.where("size > 0").select(F.when(F.col("first") <= F.col("size"), F.col("conv_id")).otherwise(F.col("above")).alias("conv_id"), F.col("size").alias("depth"), F.col("conv_id").alias("who"))
    ended = ended.unionByName(known.where("size = 0").select(least.alias("conv_id"), F.lit(0).cast("bigint").alias("depth"), F.col("conv_id").alias("who")))
    shas = checkpointed(end_digests(checkpointed(ended)))
    up = hung.select("conv_id", F.col("first").alias("depth"), F.coalesce("at", least).alias("above"))
    inner = run.join(up, ["conv_id", "depth"], "left").select(
        "conv_id", "depth", F.coalesce("above", "conv_id").alias("parent_conv_id"), "n_convs", (F.col("hangs") + (F.col("depth") < F.col("size")).cast("bigint")).alias("n_children"), "n_leaves", "saved_tokens")
    top = given.where("to IS NULL").agg(F.sum("l").alias("l"), F.sum("s").alias("s"), F.sum("n").alias("n")).select(
        least.alias("conv_id"), F.lit(0).cast("bigint").alias("depth"), F.lit(None).cast("bigint").alias("parent_conv_id"), F.lit(root.n).cast("bigint").alias("n_convs"),
        F.coalesce("n", F.lit(0)).alias("n_children"), F.coalesce("l", F.lit(1)).alias("n_leaves"), F.coalesce("s", F.lit(0)).alias("saved_tokens"))
    return top.unionByName(inner).join(shas, ["conv_id", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY_SHA)))


#: The same nodes for another SQL engine: prefixes as digests of lists, subtrees by the nodes of each conversation.
ORACLE = f"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS base, count(*) AS n FROM t GROUP BY conv_id),
crc(i, v) AS (
  SELECT conv_id, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda a, x:
    list_reduce(list_prepend(xor(a, x), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda b, z: CASE WHEN b & 1 = 1 THEN xor(b >> 1, 3988292384) ELSE b >> 1 END)) FROM c),
k AS (SELECT c.conv_id, c.base, CASE WHEN c.base = c.conv_id THEN 0 ELSE xor(v, 4294967295) % 4 END AS h FROM c JOIN crc ON c.conv_id = i),
r AS (
  SELECT k.conv_id, t.pos, role, text FROM k JOIN t ON t.conv_id = k.base AND t.pos <= h
  UNION ALL
  SELECT k.conv_id, t.pos + 1000000, role, text FROM k JOIN t ON t.conv_id = k.conv_id AND t.pos > h),
o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS depth, md5(strlen(role)::VARCHAR || ':' || role || text) AS m, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words FROM r),
p AS (
  SELECT conv_id, depth, words, md5(string_agg(m, ',') OVER (PARTITION BY conv_id ORDER BY depth)) AS node FROM o
  UNION ALL
  SELECT conv_id, 0, 0, 'root' FROM c),
s AS (SELECT conv_id, max(depth) AS size FROM p GROUP BY conv_id),
nd AS (
  SELECT node, depth, min(p.conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
         sha256(coalesce(string_agg(p.conv_id::VARCHAR, ',' ORDER BY p.conv_id) FILTER (size = depth), '')) AS ends_sha256
  FROM p JOIN s USING (conv_id) GROUP BY node, depth),
e AS (SELECT DISTINCT a.node AS parent, b.node AS child FROM p a JOIN p b ON a.conv_id = b.conv_id AND b.depth = a.depth + 1),
kids AS (SELECT parent, count(*) AS n_children FROM e GROUP BY parent),
sub AS (SELECT DISTINCT a.node AS above, b.node AS below FROM p a JOIN p b ON a.conv_id = b.conv_id AND b.depth >= a.depth),
sums AS (
  SELECT above, sum(CASE WHEN n_children IS NULL THEN 1 ELSE 0 END)::BIGINT AS n_leaves, sum((n_convs - 1) * words)::BIGINT AS saved_tokens
  FROM sub JOIN nd ON nd.node = below LEFT JOIN kids ON kids.parent = below GROUP BY above)
SELECT nd.conv_id, nd.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, nd.n_convs, coalesce(n_children, 0)::BIGINT AS n_children, n_leaves, saved_tokens, nd.ends_sha256
FROM nd JOIN sums ON sums.above = nd.node LEFT JOIN kids ON kids.parent = nd.node LEFT JOIN e ON e.child = nd.node LEFT JOIN nd u ON u.node = e.parent
"""
