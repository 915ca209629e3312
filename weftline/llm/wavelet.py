"""Token ids in wavelet matrices: a compressed file a shard, with access, count and lookup.

A shard holds the ids of a run of documents as one bit-plane for each bit of an
id, the highest first. Below each plane the sequence is reordered stably: zeros,
then ones. Rank over the planes answers access, counting and occurrence lookup in
one step a bit. Planes are cut into blocks that are compressed each by itself, so
a lookup unpacks one block a plane and not the file.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.common import bounded_batches, checkpointed, partitions_for, small_or_shuffled
from weftline.llm.words import BatchEncoder

MAGIC = b"WVMX"
BLOCK = 1 << 15  # bytes of a plane that are compressed together
SHARD_TOKENS = 1 << 22
STRIDE = 1 << 15
_ENCODERS: dict = {}


def encoder(path: str) -> BatchEncoder:
    """One encoder a worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = BatchEncoder(path)
    return _ENCODERS[path]


def build(ids: np.ndarray, meta: dict) -> bytes:
    """The file of one shard. It ends in a zero byte, as the writer of files needs it."""
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=1).compress
    bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    cur = ids.astype(np.uint16 if bits <= 16 else np.uint32)
    planes, zeros, ranks = [], [], []
    for b in range(bits - 1, -1, -1):
        ones = (cur & cur.dtype.type(1 << b)) != 0
        packed = np.packbits(ones, bitorder="little")
        blocks = [packed[i : i + BLOCK] for i in range(0, len(packed), BLOCK)]
        counts = [int(np.bitwise_count(x).sum(dtype=np.int64)) for x in blocks]
        ranks.append(np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]).tolist())
        planes.append([squeeze(x.tobytes()) for x in blocks])
        zeros.append(len(cur) - ranks[-1][-1])
        down, z, o = np.empty_like(cur), 0, zeros[-1]
        for i in range(0, len(cur), STRIDE):  # short index lists stay in cache; masks of random bits are several times slower
            part, mask = cur[i : i + STRIDE], ones[i : i + STRIDE]
            low, high = np.flatnonzero(~mask), np.flatnonzero(mask)
            part.take(low, out=down[z : z + len(low)], mode="clip")
            part.take(high, out=down[o : o + len(high)], mode="clip")
            z, o = z + len(low), o + len(high)
        cur = down
    docs = squeeze(np.asarray(meta.pop("docs"), "<i8").tobytes())
    head = meta | {"n": len(ids), "bits": bits, "zeros": zeros, "ranks": ranks, "sizes": [[len(x) for x in p] for p in planes], "docs": len(docs)}
    packed_head = zlib.compress(json.dumps(head).encode())
    return b"".join([MAGIC, len(packed_head).to_bytes(8, "little"), packed_head, docs, *(x for p in planes for x in p), b"\x00"])


class Shard:
    """Read a shard's file. Blocks are unpacked when a question needs them."""

    def __init__(self, data: bytes):
        import zstandard

        if data[:4] != MAGIC:
            raise ValueError("not a wavelet matrix file")
        self._unpack = zstandard.ZstdDecompressor().decompress
        size = int.from_bytes(data[4:12], "little")
        self.head = json.loads(zlib.decompress(data[12 : 12 + size]))
        self.n, self.bits, self.zeros, self.ranks = (self.head[k] for k in ("n", "bits", "zeros", "ranks"))
        self._data, at = memoryview(data), 12 + size
        self._docs = (at, self.head["docs"])
        at += self.head["docs"]
        self._places = []
        for sizes in self.head["sizes"]:
            ends = np.cumsum([0, *sizes]) + at
            self._places.append(ends.tolist())
            at = int(ends[-1])
        self._held: dict = {}

    def docs(self) -> np.ndarray:
        """Rows of document id, tokens, and 1 for a null id."""
        at, size = self._docs
        return np.frombuffer(self._unpack(self._data[at : at + size]), "<i8").reshape(-1, 3)

    def _block(self, level: int, k: int) -> np.ndarray:
        if (level, k) not in self._held:
            if len(self._held) > 64 * self.bits:
                self._held.clear()
            at, end = self._places[level][k : k + 2]
            self._held[level, k] = np.frombuffer(self._unpack(self._data[at:end]), np.uint8)
        return self._held[level, k]

    def _bit(self, level: int, i: int) -> int:
        k, j = divmod(i, 8 * BLOCK)
        return int(self._block(level, k)[j >> 3]) >> (j & 7) & 1

    def _ones(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        k, j = divmod(i, 8 * BLOCK)
        count = self.ranks[level][k]
        if j:
            block = self._block(level, k)
            count += int(np.bitwise_count(block[: j >> 3]).sum(dtype=np.int64))
            if j & 7:
                count += (int(block[j >> 3]) & ((1 << (j & 7)) - 1)).bit_count()
        return count

    def access(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.bits):
            bit, ones = self._bit(level, i), self._ones(level, i)
            i = self.zeros[level] + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _range(self, token: int, end: int) -> tuple[int, int]:
        lo, hi = 0, end
        if token >> self.bits:
            return 0, 0
        for level in range(self.bits):
            a, b = self._ones(level, lo), self._ones(level, hi)
            one = token >> (self.bits - 1 - level) & 1
            lo, hi = (self.zeros[level] + a, self.zeros[level] + b) if one else (lo - a, hi - b)
        return lo, hi

    def count(self, token: int, end: int | None = None) -> int:
        """Occurrences of a token before place `end`."""
        lo, hi = self._range(token, self.n if end is None else end)
        return hi - lo

    def _select(self, level: int, one: int, k: int) -> int:
        """The place of the k-th (from 0) zero or one of a plane."""
        ranks = np.asarray(self.ranks[level])
        starts = ranks if one else np.minimum(np.arange(len(ranks)) * 8 * BLOCK, self.n) - ranks
        at = int(np.searchsorted(starts, k, "right")) - 1
        bits = np.unpackbits(self._block(level, at), bitorder="little")[: self.n - at * 8 * BLOCK]
        return at * 8 * BLOCK + int(np.flatnonzero(bits == one)[k - int(starts[at])])

    def places(self, token: int) -> list[int]:
        """Where a token occurs, in ascending order, by select from the lowest plane up."""
        lo, hi = self._range(token, self.n)
        found = []
        for i in range(lo, hi):
            for level in range(self.bits - 1, -1, -1):
                one = token >> (self.bits - 1 - level) & 1
                i = self._select(level, one, i - self.zeros[level] if one else i)
            found.append(i)
        return found

    def decode(self) -> np.ndarray:
        """All ids: the stable partitions undone from the lowest plane up."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        cur = np.zeros(self.n, kind)
        for level in range(self.bits - 1, -1, -1):
            packed = [np.frombuffer(self._unpack(self._data[a:b]), np.uint8) for a, b in zip(self._places[level], self._places[level][1:], strict=False)]
            ones = np.unpackbits(np.concatenate(packed), count=self.n, bitorder="little").view(bool) if packed else np.zeros(0, bool)
            up = np.empty(self.n, kind)
            z, o, bit = 0, self.zeros[level], kind(1 << (self.bits - 1 - level))
            for i in range(0, self.n, STRIDE):
                part, mask = up[i : i + STRIDE], ones[i : i + STRIDE]
                low, high = np.flatnonzero(~mask), np.flatnonzero(mask)
                part[low] = cur[z : z + len(low)]
                part[high] = cur[o : o + len(high)] | bit
                z, o = z + len(low), o + len(high)
            cur = up
        return cur


def encode_shards(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int, shard_tokens: int) -> Iterator[pa.RecordBatch]:
    part, seq = TaskContext.get().partitionId(), 0
    ids: list[np.ndarray] = []
    docs: list[tuple[int, int, int]] = []
    held = 0

    def shard() -> pa.RecordBatch:
        data = build(np.concatenate(ids), {"part": part, "seq": seq, "docs": docs})
        return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["value"])

    for batch in batches:
        tokens, counts = encoder(tokenizer).encode(batch.column(1).to_pylist(), end_id)
        at = 0
        for doc_id, n in zip(batch.column(0).to_pylist(), counts.tolist(), strict=True):
            ids.append(tokens[at : at + n])
            docs.append((doc_id or 0, n, int(doc_id is None)))
            at += n
            held += n
            if held >= shard_tokens:
                yield shard()
                ids, docs, held, seq = [], [], 0, seq + 1
    if docs:
        yield shard()


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int, shard_tokens: int = SHARD_TOKENS) -> None:
    """Write the ids of (doc_id, text) in ascending doc_id order, a file a shard.

    Texts move once, dealt by ranges of doc_id; a partition writes one or more
    shards of about `shard_tokens` ids. A null or empty text gives the end id
    alone; a null doc_id comes first; rows with equal doc_id, or none, are in the order of
    a hash of their texts and may go on over several partitions; no rows write no shards.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    n = partitions_for(spark, docs.count(), 4096)
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"))
    ordered = keyed.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")
    shards = ordered.mapInArrow(lambda it: encode_shards(it, tokenizer, end_id, shard_tokens), "value binary")
    body = F.expr("substring(value, 1, length(value) - 1)").cast("string")
    shards.select(body.alias("value")).write.option("lineSep", "\u0000").option("maxRecordsPerFile", 1).text(path)


def shard_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 0")


def documents_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data in batch.column(0):
            shard = Shard(data.as_py())
            ids, docs = shard.decode().astype("<u4"), shard.docs()
            ends = np.cumsum(docs[:, 1])
            starts = ends - docs[:, 1]
            crcs = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            n = len(docs)
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard.head["part"]] * n, pa.int64()), pa.array([shard.head["seq"]] * n, pa.int64()), pa.array(docs[:, 0], mask=docs[:, 2] == 1),
                 pa.array(starts, pa.int64()), pa.array(docs[:, 1]), pa.array(crcs, pa.int64())],
                ["part", "seq", "doc_id", "local_start", "n_tokens", "ids_crc32"],
            )


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the shards' files.

    `start` is the place in a shard plus the ids of all shards before it; only
    the shards' totals are summed in order.
    """
    bounded_batches(spark)
    rows = checkpointed(
        shard_files(spark, path).select("content").mapInArrow(
            documents_of, "part long, seq long, doc_id long, local_start long, n_tokens long, ids_crc32 long")
    )
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("part", "seq").agg(F.sum("n_tokens").alias("n"))
    bases = totals.select("part", "seq", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return rows.join(small_or_shuffled(bases, 24), ["part", "seq"]).select(
        "doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32"
    )


def lookup(spark: SparkSession, path: str, token: int) -> DataFrame:
    """Occurrences of a token: part, seq, count, and its places within the shard."""

    def search(batches):
        for batch in batches:
            for data in batch.column(0):
                s = Shard(data.as_py())
                places = s.places(token)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s.head["part"]], pa.int64()), pa.array([s.head["seq"]], pa.int64()), pa.array([s.count(token)], pa.int64()), pa.array([places], pa.list_(pa.int64()))],
                    ["part", "seq", "count", "places"])

    return shard_files(spark, path).select("content").mapInArrow(search, "part long, seq long, count long, places array<long>")
