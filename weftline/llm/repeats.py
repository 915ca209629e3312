"""Removal of byte strings that repeat anywhere in a corpus, by distributed suffix sorting.

Suffixes that share their first `length` bytes must meet in one task. A window of
`length` bytes is known by its minimizer, the least hash among its grams: equal
windows have equal minimizers. Runs of window starts with one minimizer are a
segment; segments are grouped by minimizer, and each task sorts the suffixes of
its groups. Only minimizers that occur in two texts, or twice in one, are followed
up, so most bytes are hashed once and never moved.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import bounded_batches, checkpointed, give_back, quoted, shared_folder, small_or_shuffled
from weftline.llm.lyndon import repeated_starts

LENGTH = 400
BLOCK = 1 << 19  # bytes hashed at once; places in a block take the low bits of a key
PLACE = np.uint64((1 << 21) - 1)
SORT_BYTES = 1 << 18  # bytes whose suffixes are sorted together, unless one group has more
GROUP_BYTES = 1 << 19  # bytes of a group that one task sorts; the windows of larger groups are counted in buckets
SEGMENT_STARTS = 4096  # window starts of a segment, about
HASHED_AT_ONCE = 500_000

_rng = np.random.default_rng(400)
_BYTE = _rng.integers(0, 2**64, 256, np.uint64)
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """At least n powers of a base, modulo 2**64; the tables of a worker grow with what it meets."""
    if len(_POWERS.get(base, ())) < n:
        _POWERS[base] = np.cumprod(np.full(max(n, 2 * BLOCK), base, np.uint64))
    return _POWERS[base]


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A mixed 64-bit hash of every k bytes in a row; none for fewer bytes."""
    if len(data) < k:
        return np.zeros(0, np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * powers(pow(_BASE, -1, 2**64), len(data))[: len(data)])])
    h = (sums[k:] - sums[:-k]) * powers(_BASE, len(data))[: len(data) - k + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    n = len(x) - w + 1
    rows = -(-len(x) // w)
    full = np.full(rows * w, np.iinfo(np.uint64).max, np.uint64)
    full[: len(x)] = x
    full = full.reshape(rows, w)
    left = np.minimum.accumulate(full, axis=1).ravel()
    right = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1 : w - 1 + n])


def window_spots(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For every window of `length` bytes the place of its minimizer, the leftmost of equal ones; and the hashes of all grams."""
    k = max(1, length // 4)
    h = gram_hashes(data, k)
    spots = (sliding_min((h & ~PLACE) | np.arange(len(h), dtype=np.uint64), length - k + 1) & PLACE).astype(np.int64)
    return spots, h


def segments(texts: list[bytes], length: int) -> dict[str, np.ndarray]:
    """Segments of all texts: text index, first start, number of starts, hash, and
    whether the hash is the minimizer at two places of the text.

    Neighbours with one hash are one segment, as in a run of one byte, where every
    window has a place of its own; segments are cut at about SEGMENT_STARTS starts.
    """
    pieces = [
        (i, at, t[at : at + BLOCK]) for i, t in enumerate(texts) if len(t) >= length
        for at in range(0, len(t) - length + 1, BLOCK - length + 1)
    ]
    found: list[list[np.ndarray]] = []
    held: list[tuple[int, int, bytes]] = []

    def flush() -> None:
        data = np.frombuffer(b"".join(p[2] for p in held), np.uint8)
        sizes = np.array([len(p[2]) for p in held])
        firsts = np.cumsum(sizes) - sizes
        spots, h = window_spots(data, length)
        n = sizes - length + 1
        owner = np.repeat(np.arange(len(held)), n)
        local = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        at = firsts[owner] + local
        spot = spots[at]
        new = np.flatnonzero(np.concatenate([[True], (spot[1:] != spot[:-1]) | (owner[1:] != owner[:-1])]))
        offset = np.array([p[1] for p in held])[owner[new]]
        found.append([
            np.array([p[0] for p in held])[owner[new]], local[new] + offset, np.diff(np.append(new, len(owner))),
            h[spot[new]].view(np.int64), spot[new] - firsts[owner[new]] + offset,
        ])

    room = 0
    for p in pieces:
        if held and room + len(p[2]) > BLOCK:
            flush()
            held, room = [], 0
        held.append(p)
        room += len(p[2])
    if held:
        flush()
    if not found:
        return {c: np.zeros(0, np.int64) for c in ("text", "start", "n", "hash", "twice")}
    text, start, n, hashes, spot = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((spot, hashes, text))
    same = (text[order][1:] == text[order][:-1]) & (hashes[order][1:] == hashes[order][:-1])
    again = np.flatnonzero(same & (spot[order][1:] != spot[order][:-1]))
    twice = np.zeros(len(text), np.int64)
    twice[order[again]] = twice[order[again + 1]] = 1
    apart = (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1]) | (start[1:] != start[:-1] + n[:-1])
    run = np.flatnonzero(np.concatenate([[True], apart]))
    within = (start - np.repeat(start[run], np.diff(np.append(run, len(start))))) // SEGMENT_STARTS
    first = np.flatnonzero(np.concatenate([[True], apart | (within[1:] != within[:-1])]))
    return {"text": text[first], "start": start[first], "n": np.add.reduceat(n, first), "hash": hashes[first], "twice": np.maximum.reduceat(twice, first)}


def raw(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def scan(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = segments(raw(batch.column(2)), length)
        keys = [batch.column(i).to_numpy(zero_copy_only=False)[found["text"]] for i in (0, 1)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c) for c in (*keys, found["hash"], found["start"], found["n"], found["twice"])],
            ["k1", "k2", "hash", "start", "n", "twice"])
        del found, keys
        give_back()


def content_id(data: bytes) -> tuple[int, int]:
    d = hashlib.blake2b(data, digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def cut_segments(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The bytes of the segments of each text, with an id of the content."""
    names = ["k1", "k2", "start", "n", "hash", "c1", "c2", "content"]

    def flush(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if x == "content" else pa.int64()) for c, x in zip(zip(*rows, strict=True), names, strict=True)], names)

    for batch in batches:
        rows, held = [], 0
        for k1, k2, text, segs in zip(*(batch.column(i).to_pylist() for i in (0, 1)), raw(batch.column(2)), batch.column(3).to_pylist(), strict=True):
            for s in segs:
                content = text[s["start"] : s["start"] + s["n"] + length - 1]
                rows.append((k1, k2, s["start"], s["n"], s["hash"], *content_id(content), content))
                held += len(content)
                if held > 4 << 20:
                    yield flush(rows)
                    rows, held = [], 0
        if rows:
            yield flush(rows)
        del rows
        give_back()


def runs(hit: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


MARKS = "c1 long, c2 long, lo long, hi long"


def marks_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [()] * 4)], ["c1", "c2", "lo", "hi"])


def narrowed(texts: list[bytes], length: int) -> list[tuple[int, int]]:
    """The part of each text that its windows with an equal hash in these texts span; (0, 0) for none.

    Equal windows have equal hashes, so all that can repeat lies in these parts,
    and suffixes are sorted for them only.
    """
    sizes = np.array([len(t) for t in texts])
    firsts = np.cumsum(sizes) - sizes
    h = gram_hashes(np.frombuffer(b"".join(texts), np.uint8), length)
    n = np.maximum(sizes - length + 1, 0)
    owner = np.repeat(np.arange(len(texts)), n)
    local = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    _, at, times = np.unique(h[firsts[owner] + local], return_inverse=True, return_counts=True)
    hit = np.flatnonzero(times[at] > 1)
    parts = [(0, 0)] * len(texts)
    own, first = np.unique(owner[hit], return_index=True)
    last = np.append(first[1:], len(hit)) - 1
    for i, a, b in zip(own.tolist(), local[hit[first]].tolist() if len(hit) else [], local[hit[last]].tolist() if len(hit) else [], strict=True):
        parts[i] = (a, b + length)
    return parts


def sort_groups(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Sort the suffixes of whole groups and mark the window starts that repeat."""
    ids: list[tuple[int, int]] = []
    texts: list[bytes] = []
    held = 0

    def flush() -> pa.RecordBatch:
        kept = [(i, lo, t[lo:hi]) for i, t, (lo, hi) in zip(ids, texts, narrowed(texts, length), strict=True) if hi]
        if not kept:
            return marks_batch([])
        hits = repeated_starts([t for _, _, t in kept], length)
        return marks_batch([(*i, lo + a, lo + b) for (i, lo, _), hit in zip(kept, hits, strict=True) for a, b in runs(hit)])

    for batch in batches:
        for group in batch.column(0).to_pylist():
            size = sum(len(x["content"]) for x in group)
            if texts and held + size > SORT_BYTES:
                yield flush()
                ids, texts, held = [], [], 0
            ids += [(x["c1"], x["c2"]) for x in group]
            texts += [x["content"] for x in group]
            held += size
        give_back()
    if texts:
        yield flush()
    give_back()


WINDOW = np.dtype([("w1", "<u8"), ("w2", "<u8"), ("c1", "<i8"), ("c2", "<i8"), ("at", "<i8")])


def repeated(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows sorted by hash, and which of them have an equal one."""
    windows = windows[np.lexsort((windows["w2"], windows["w1"]))]
    same = (windows["w1"][1:] == windows["w1"][:-1]) & (windows["w2"][1:] == windows["w2"][:-1])
    return windows, np.concatenate([same, [False]]) | np.concatenate([[False], same])


def window_marks(windows: np.ndarray) -> list[tuple]:
    windows = windows[np.lexsort((windows["at"], windows["c2"], windows["c1"]))]
    if not len(windows):
        return []
    new = (windows["c1"][1:] != windows["c1"][:-1]) | (windows["c2"][1:] != windows["c2"][:-1]) | (windows["at"][1:] != windows["at"][:-1] + 1)
    first = np.concatenate([[0], np.flatnonzero(new) + 1])
    last = np.append(first[1:], len(windows)) - 1
    return list(zip(windows["c1"][first].tolist(), windows["c2"][first].tolist(), windows["at"][first].tolist(), (windows["at"][last] + 1).tolist(), strict=True))


def count_windows(batches: Iterator[pa.RecordBatch], length: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """For groups too large to sort in one task: hash every window. Equal windows
    within the task are marked here, and one of each kind is sent on to its bucket."""
    names = ["bucket", "windows", "c1", "c2", "lo", "hi"]

    def flush(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        windows, twice = repeated(np.array(rows, WINDOW))
        marks = window_marks(windows[twice])
        none = [None] * len(marks)
        columns = list(zip(*marks, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(none, pa.int64()), pa.array(none, pa.binary()), *(pa.array(c, pa.int64()) for c in columns)], names)
        first = np.concatenate([[True], (windows["w1"][1:] != windows["w1"][:-1]) | (windows["w2"][1:] != windows["w2"][:-1])])
        sent = windows[first]
        where = (sent["w1"] % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(where, kind="stable")
        sent, where = sent[order], where[order]
        own, at = np.unique(where, return_index=True)
        packed = [sent[a:b].tobytes() for a, b in zip(at.tolist(), [*at[1:].tolist(), len(sent)], strict=True)]
        none = [None] * len(own)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(packed, pa.binary()), *(pa.array(none, pa.int64()) for _ in range(4))], names)

    rows: list[tuple] = []
    for batch in batches:
        for c1, c2, n, content in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            for i in range(n):
                d = hashlib.blake2b(content[i : i + length], digest_size=16).digest()
                rows.append((int.from_bytes(d[:8], "little"), int.from_bytes(d[8:], "little"), c1, c2, i))
            if len(rows) >= HASHED_AT_ONCE:
                yield from flush(rows)
                rows = []
                give_back()
    if rows:
        yield from flush(rows)
    del rows
    give_back()


def large_group_marks(contents: DataFrame, length: int) -> DataFrame:
    windows = contents.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = max(16, windows // 1_000_000)
    found = checkpointed(
        contents.select("c1", "c2", "n", "content").mapInArrow(
            lambda it: count_windows(it, length, buckets), "bucket long, windows binary, c1 long, c2 long, lo long, hi long")
    )

    def meet(key, table):
        _, windows = key, np.concatenate([np.frombuffer(x.as_py(), WINDOW) for x in table.column("windows")])
        windows, twice = repeated(windows)
        marks = pa.Table.from_batches([marks_batch(window_marks(windows[twice]))])
        del windows, twice
        give_back()
        return marks

    here = found.where("bucket is null").select("c1", "c2", "lo", "hi")
    return here.union(found.where("bucket is not null").groupBy("bucket").applyInArrow(meet, MARKS))


SEGMENTS = "k1 long, k2 long, start long, n long, hash long, c1 long, c2 long, content binary"


def distinct_contents(segs: DataFrame) -> DataFrame:
    """hash, c1, c2, n, times and content of the distinct segments of each group."""
    return _stored(segs.groupBy("hash", "c1", "c2").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("times"), F.max("content").alias("content")), "distinct")


def group_marks(contents: DataFrame, length: int) -> DataFrame:
    """Ranges of window starts (c1, c2, lo, hi) of the segments that repeat, for all groups.

    Segments that occur more than once repeat as a whole. The suffixes of a group of
    up to GROUP_BYTES are sorted in one task. The windows of larger groups are dealt
    out by their hashes and counted, so that no task holds such a group.
    """
    again = contents.where("times > 1").select("c1", "c2", F.lit(0).cast("bigint").alias("lo"), F.col("n").alias("hi"))
    sizes = contents.groupBy("hash").agg(F.count(F.lit(1)).alias("m"), F.sum(F.octet_length("content")).alias("bytes")).where("m > 1")
    large = checkpointed(sizes.where(F.col("bytes") > GROUP_BYTES).select("hash"))
    held = small_or_shuffled(large, 16)
    groups = (
        contents.join(held, "hash", "left_anti").groupBy("hash")
        .agg(F.collect_list(F.struct("c1", "c2", "content")).alias("group"), F.sum("times").alias("times"))
        .where((F.size("group") > 1) | (F.col("times") == 1)).select("group")  # a segment alone may repeat within itself
    )
    marks = again.union(groups.mapInArrow(lambda it: sort_groups(it, length), MARKS))
    return marks if large.isEmpty() else marks.union(large_group_marks(contents.join(held, "hash", "left_semi"), length))


def keep(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, spans in zip(raw(batch.column(2)), batch.column(3).to_pylist(), strict=True):
            hit = np.zeros(len(text) + 1, np.int32)
            for s in spans:  # starts lo..hi-1 cover the bytes lo..hi+length-2
                hit[s["lo"]] += 1
                hit[min(len(text), s["hi"] + length - 1)] -= 1
            gone = np.cumsum(hit[:-1]) > 0
            rows.append((int(gone.sum()), len(runs(gone)), np.frombuffer(text, np.uint8)[~gone].tobytes()))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True))],
            ["k1", "k2", "n_removed", "n_spans", "kept"])
        del rows
        give_back()


def text_keys(text: Column) -> tuple[Column, Column, Column]:
    """SHA-256 of a text in hex, and 120 bits of it as two numbers, by which distinct texts are known."""
    digest = F.sha2(F.coalesce(text, F.lit("")), 256)
    number = lambda at: F.conv(F.substring(digest, at, 15), 16, 10).cast("bigint")
    return digest, number(1), number(16)


def _stored(df: DataFrame, kind: str) -> DataFrame:
    """Written to the shared folder in a compressed columnar form, and read back."""
    path = shared_folder(df.sparkSession, kind)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def repeats(docs: DataFrame, length: int = LENGTH) -> tuple[DataFrame, DataFrame]:
    """What to remove so that no byte lies in a string of `length` bytes that starts twice.

    Returns (rows, cleaned). rows has doc_id, k1, k2, digest and n_bytes for every
    document; cleaned has, for each distinct text (k1, k2) that loses bytes, n_removed,
    n_spans and the kept bytes. Strings are judged on the input; all copies go.
    Matches never cross texts. Copies of a whole text are one text that repeats: from
    `length` bytes on it goes as a whole. Null and empty texts and those below
    `length` bytes lose nothing; repeated rows are copies; no rows give no rows.
    Of docs only doc_id and text are read, so further columns may have any names.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    digest, k1, k2 = text_keys(F.col("text"))
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), digest.alias("digest"), k1.alias("k1"), k2.alias("k2"))
    rows = checkpointed(keyed.select("doc_id", "k1", "k2", "digest", F.octet_length("text").cast("bigint").alias("n_bytes")))
    texts = rows.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.max("n_bytes").alias("n_bytes"))

    marked = _stored(
        keyed.select("k1", "k2", "text").mapInArrow(lambda it: scan(it, length), "k1 long, k2 long, hash long, start long, n long, twice long"),
        "segments")
    # stored, not aggregated in the plan of the join: Spark can then split the partition of a frequent hash
    shared = _stored(
        marked.groupBy("hash").agg(F.min("k1").alias("a"), F.max("k1").alias("b"), F.max("twice").alias("twice")).where("a <> b or twice = 1").select("hash"),
        "shared")
    found = marked.join(shared, "hash").groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "n", "hash")).alias("segs"))
    wanted = checkpointed(found.join(texts, ["k1", "k2"]).select("k1", "k2", "rep", "copies", "n_bytes", "segs"))

    reps = wanted.select(F.col("k1").alias("r1"), F.col("k2").alias("r2"), "rep")
    same = (F.col("k1") == F.col("r1")) & (F.col("k2") == F.col("r2")) & F.col("doc_id").eqNullSafe(F.col("rep"))
    bodies = keyed.join(small_or_shuffled(reps, 40), same).groupBy("k1", "k2").agg(F.max("text").alias("text"))
    work = _stored(wanted.join(bodies, ["k1", "k2"]), "texts")
    segs = _stored(work.select("k1", "k2", "text", "segs").mapInArrow(lambda it: cut_segments(it, length), SEGMENTS), "contents")
    marks = checkpointed(group_marks(distinct_contents(segs), length))
    spans = (
        segs.select("k1", "k2", "start", "c1", "c2").join(marks, ["c1", "c2"])
        .groupBy("k1", "k2").agg(F.collect_set(F.struct((F.col("start") + F.col("lo")).alias("lo"), (F.col("start") + F.col("hi")).alias("hi"))).alias("spans"))
    )
    whole = texts.where((F.col("copies") > 1) & (F.col("n_bytes") >= length)).select(
        "k1", "k2", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("bigint").alias("n_spans"), F.lit(b"").alias("kept"))
    single = work.where((F.col("copies") == 1) | (F.col("n_bytes") < length))
    parts = single.join(spans, ["k1", "k2"]).select("k1", "k2", "text", "spans").mapInArrow(
        lambda it: keep(it, length), "k1 long, k2 long, n_removed long, n_spans long, kept binary")
    return rows, whole.union(parts)


def readable(kept: Column) -> Column:
    """Kept bytes as text, without the characters that lost some of their bytes."""

    @F.pandas_udf("string")
    def run(column):
        return column.map(lambda b: None if b is None else bytes(b).decode("utf-8", "ignore"))

    return run(kept)


def removed(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the kept text for every document.

    Null and empty texts have no bytes and an empty kept text; characters that lose
    some of their bytes aren't in `text`, while kept_sha256 is of all kept bytes.
    """
    rows, cleaned = repeats(docs, length)
    lost = checkpointed(cleaned.select("k1", "k2", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), readable(F.col("kept")).alias("kept")))
    digest, k1, k2 = text_keys(F.col("text"))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), digest.alias("digest"), k1.alias("k1"), k2.alias("k2"))
    return texts.join(lost, ["k1", "k2"], "left").select(
        "doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("kept_sha256", "digest").alias("kept_sha256"), F.coalesce("kept", "text").alias("text"),
    )


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The documents with the repeats taken out of column text, and n_chars set anew.

    A character that loses some of its bytes is dropped; a document that loses all
    stays, with an empty text; texts that lose nothing, null ones too, stay as they are.
    All other columns are kept, whatever their names; no rows give none.
    """
    _, cleaned = repeats(docs, length)
    lost = checkpointed(cleaned.select("k1", "k2", "kept")).select("k1", "k2", readable(F.col("kept")).alias("kept"))
    _, k1, k2 = text_keys(F.col("text"))
    out = docs.select(k1.alias("k1"), k2.alias("k2"), F.struct(*map(quoted, docs.columns)).alias("row")).join(lost, ["k1", "k2"], "left")
    columns = {c: F.col("row").getField(c) for c in docs.columns}
    columns |= {"text": F.coalesce("kept", columns["text"])}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.col("kept").isNull(), columns["n_chars"]).otherwise(F.length("kept")).cast("bigint")
    return out.select(*[c.alias(name) for name, c in columns.items()])
