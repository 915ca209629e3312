"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints that differ in at most 2r bits have a variant in common
that differs from either in at most r bits. So every distinct fingerprint emits
all its variants within r bits, variants are shuffled, and fingerprints that meet
are verified and linked.

For r = 2 there are 2081 variants, too many to write out one by one. They are
dealt to buckets by a hash that is linear over bits: the bucket of fp ^ mask is
that of fp XORed with that of the mask. So a bucket needs only the fingerprints
that have a variant in it, eight bytes each, and makes those variants again.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import bounded_batches, checkpointed, quoted, small_or_shuffled
from weftline.llm.components import stars

SHINGLE = 4
RADIUS = 4
SEED = 42
BUCKET_BITS = 8
#: Fingerprints that a bucket holds at most, on average; more buckets are used beyond.
BUCKET_ROWS = 4_000_000
#: Variants that a task makes at once.
AT_ONCE = 1_000_000
SHINGLES_AT_ONCE = 200_000


def shingle_hashes(text: str | None, k: int = SHINGLE) -> Iterator[np.ndarray]:
    """The hashes of a text's shingles of k words, each occurrence, in parts; fewer words are one shingle, no words none."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return
    joined, hashed = b" ".join(words), xxhash.xxh64_intdigest
    ends = (np.cumsum(np.fromiter(map(len, words), np.int64, len(words))) + np.arange(len(words))).tolist()
    starts = [0, *(e + 1 for e in ends[:-1])]
    n = max(1, len(words) - k + 1)
    last = ends[k - 1 :] if len(words) >= k else ends[-1:]
    for i in range(0, n, SHINGLES_AT_ONCE):
        yield np.fromiter((hashed(joined[a:b], SEED) for a, b in zip(starts[i : i + SHINGLES_AT_ONCE], last[i : i + SHINGLES_AT_ONCE], strict=False)), np.uint64)


def majority(parts: Iterable[np.ndarray]) -> int:
    """The majority bits of hashes; 0 for none."""
    counts, n = np.zeros(64, np.int64), 0
    for part in parts:
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(part)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, k: int = SHINGLE) -> int:
    """The majority bits of the shingles' hashes, each occurrence counted; 0 for no words."""
    return majority(shingle_hashes(text, k))


def fingerprints(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """doc_id, text_key and fp, a signed 64-bit number, for every row; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t, k) for t in batch.column(2).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints)], ["doc_id", "text_key", "fp"])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_key().alias("text_key"), "text").mapInArrow(run, "doc_id long, text_key long, fp long")


class Ball:
    """All masks of at most `half` bits, and the linear hash that deals variants to buckets."""

    def __init__(self, half: int, bits: int):
        self.bits = bits
        columns = np.random.default_rng(SEED).integers(0, 1 << 32, 64, np.uint64)
        self.tables = np.zeros((8, 256), np.uint64)
        for byte in range(8):
            for j in range(8):
                self.tables[byte, (np.arange(256) >> j & 1) == 1] ^= columns[8 * byte + j]
        masks = [sum(1 << b for b in c) for n in range(half + 1) for c in combinations(range(64), n)]
        self.masks = np.array(masks, np.uint64)

    def hash(self, x: np.ndarray) -> np.ndarray:
        rows = np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8)
        out = np.zeros(len(rows), np.uint64)
        for byte in range(8):
            out ^= self.tables[byte][rows[:, byte]]
        return out.astype(np.int64)

    def by_class(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Masks sorted by the low bits of their hash, and where each class begins."""
        classes = self.hash(self.masks) & ((1 << bits) - 1)
        order = np.argsort(classes, kind="stable")
        return self.masks[order], np.searchsorted(classes[order], np.arange((1 << bits) + 1))


def emit(batches: Iterator[pa.RecordBatch], half: int, bits: int) -> Iterator[pa.RecordBatch]:
    """For each bucket, the fingerprints that have a variant in it, as packed rows."""
    ball = Ball(half, bits)
    classes = np.unique(ball.hash(ball.masks) & ((1 << bits) - 1))

    def rows(fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        own = ball.hash(fps) & ((1 << bits) - 1)
        for i in range(0, len(fps), step := max(1, AT_ONCE // len(classes))):
            part = fps[i : i + step]
            buckets = (own[i : i + step, None] ^ classes).ravel()
            order = np.argsort(buckets, kind="stable")
            buckets, sent = buckets[order], np.repeat(part, len(classes))[order]
            first = np.flatnonzero(np.concatenate([[True], buckets[1:] != buckets[:-1]]))
            for j in range(0, len(first), 1000):
                at = first[j : j + 1000].tolist()
                ends = [*at[1:], int(first[j + 1000]) if j + 1000 < len(first) else len(sent)]
                yield pa.RecordBatch.from_arrays([pa.array(buckets[at], pa.int32()), pa.array([sent[a:b].tobytes() for a, b in zip(at, ends, strict=True)], pa.binary())], ["bucket", "fps"])

    held: list[np.ndarray] = []
    for batch in batches:
        held.append(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
        if sum(map(len, held)) >= 100_000:
            yield from rows(np.concatenate(held))
            held = []
    if held and sum(map(len, held)):
        yield from rows(np.concatenate(held))


def meeting_point(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The one variant at which a linked pair is reported: a, with the lowest half of the differing bits (rounded up) taken from b."""
    diff, out = a ^ b, a.copy()
    steps = (np.bitwise_count(diff).astype(np.int64) + 1) // 2
    for i in range(int(steps.max(initial=0))):
        low = diff & (~diff + np.uint64(1))
        out = np.where(steps > i, out ^ low, out)
        diff = diff ^ low
    return out


def links(fps: np.ndarray, bucket: int, half: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among fingerprints whose variants meet in a bucket.

    All fingerprints with a common variant are within twice the radius of each
    other, and each is linked with the least of them only, and only where the
    variant is the pair's meeting point. That keeps components whole: at a pair's
    meeting point either the smaller one is the least, and the pair is reported, or
    a still smaller fingerprint is linked with both by the same argument.
    """
    fps = np.unique(fps)
    ball = Ball(half, bits)
    expected = len(fps) * len(ball.masks) / (1 << bits)
    more = max(0, int(np.ceil(np.log2(max(1.0, expected / AT_ONCE)))))
    masks, starts = ball.by_class(bits + more)
    classes = ball.hash(fps) & ((1 << (bits + more)) - 1)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for sub in range(1 << more):
        cls = classes ^ (bucket | sub << bits)
        n = starts[cls + 1] - starts[cls]
        owner = np.repeat(np.arange(len(fps)), n)
        if len(owner) < 2:
            continue
        within = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        variants = fps[owner] ^ masks[starts[cls][owner] + within]
        order = np.argsort(variants, kind="stable")
        variants, owner = variants[order], owner[order]
        first = np.concatenate([[True], variants[1:] != variants[:-1]])
        head = owner[np.flatnonzero(first)[np.cumsum(first) - 1]]
        met = np.flatnonzero(~first)
        a, b, v = fps[head[met]], fps[owner[met]], variants[met]
        real = (meeting_point(a, b) == v) & (np.bitwise_count(a ^ b) <= 2 * half)
        found.append((a[real], b[real]))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def linked_pairs(prints: DataFrame, distinct: int, radius: int = RADIUS) -> DataFrame:
    """(a, b): links between the distinct values of fp that connect all within `radius` bits."""
    half = -(-radius // 2)
    if radius != 2 * half:
        raise ValueError("an even radius is needed")
    bits, masks = BUCKET_BITS, sum(1 for n in range(half + 1) for _ in combinations(range(64), n))
    while distinct * min(1, masks / (1 << bits)) > BUCKET_ROWS and bits < 30:
        bits += 1

    def meet(key, table):
        fps = np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in table.column("fps")])
        a, b = links(fps, key[0].as_py(), half, bits)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    sent = prints.select("fp").mapInArrow(lambda it: emit(it, half, bits), "bucket int, fps binary")
    return sent.groupBy("bucket").applyInArrow(meet, "a long, b long")


def text_key():
    """A key that, with doc_id, tells the rows of a table apart unless they are the same row again."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def near_duplicates(docs: DataFrame, k: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (hex), component_id and root for every row of docs.

    A component holds all documents reachable over links; component_id is its
    smallest doc_id (null ids count only where there is no other), root the key of
    the component. Equal texts share a fingerprint and are one node, so a large
    group of copies costs one ball; its rows are only joined with their node at
    the end. Null and empty texts have fingerprint zero, linked like any other;
    repeated rows each give a row; no rows give none.
    """
    rows = checkpointed(fingerprints(docs, k))
    nodes = checkpointed(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = checkpointed(stars(linked_pairs(nodes, nodes.count(), radius)))
    members = checkpointed(roots.union(roots.select("root", "root").distinct()))
    smallest = checkpointed(nodes.join(small_or_shuffled(members, 16), nodes.fp == members.node).groupBy("root").agg(F.min("least").alias("component_id")))
    labelled = members.join(small_or_shuffled(smallest, 16), "root")
    # stored, so that Spark can split the partition of a fingerprint that many rows have
    labels = checkpointed(nodes.join(labelled, nodes.fp == labelled.node, "left").select("fp", F.coalesce("component_id", "least").alias("component_id"), F.coalesce("root", "fp").alias("root")))
    return rows.join(labels, "fp", "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "root", "text_key"
    )


def one_of_each(docs: DataFrame, k: int = SHINGLE, radius: int = RADIUS, near: DataFrame | None = None) -> DataFrame:
    """The documents without near-duplicates: of each component the smallest doc_id stays, with all its columns.

    Null ids come after all others, equal ids are told apart by their texts, and of
    rows that are repeated whole one stays. The rows to drop are a small share and
    are broadcast if counted to be few, so texts stay where they are; else they are joined.
    `near` has doc_id, text_key and root of every row where another search has found them.
    """
    near = checkpointed(near_duplicates(docs, k, radius) if near is None else near)
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_key")
    best = near.groupBy("root").agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    best = small_or_shuffled(checkpointed(best), 48)  # stored, so that Spark can split the partition of a large component
    key = ["doc_id", "text_key"]
    grouped = checkpointed(
        near.join(best, "root").groupBy(*key).agg(F.max(order == F.col("best")).alias("stays"), F.count(F.lit(1)).alias("times"))
    )
    gone, again = grouped.where("not stays").select(*key), grouped.where("stays and times > 1").select(*key)
    # the columns of docs travel in a struct, so that no name of theirs meets a name made here
    left = docs.select("doc_id", text_key().alias("text_key"), F.struct(*map(quoted, docs.columns)).alias("row"))

    def joined(table: DataFrame, how: str) -> DataFrame:
        named = small_or_shuffled(table.toDF("doc_id_2", "text_key_2"), 16)
        return left.join(named, (F.col("text_key") == F.col("text_key_2")) & F.col("doc_id").eqNullSafe(F.col("doc_id_2")), how)

    left = joined(gone, "left_anti")
    if not again.isEmpty():
        repeated = joined(again, "left_semi").dropDuplicates(key)
        left = joined(again, "left_anti").unionByName(repeated)
    return left.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
