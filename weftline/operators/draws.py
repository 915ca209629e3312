"""Draws with replacement that come out alike in every run: multinomial resampling and the bootstrap.

Draws are seeded by what is drawn from, never by the order of rows or the number of tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import sin

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.batch import with_row_index
from weftline.operators.sampling import uniform
from weftline.session import checkpointed

#: Rows of a block, and children of a node, about.
BLOCK_ROWS, FAN = 1000, 256
#: Rows that a task deals with at most, about.
ROWS_OF_TASK = 250_000
#: Fixed value: added to every weight.
LEAST_WEIGHT = 1e-8
#: Samples up to which a group is drawn from as an array; a larger one is joined with its draws.
ARRAY_SAMPLES = 1_000_000
#: Draws of a part of a group's resamples, about; draws whose MD5 sums are taken at once; samples of the parts of a task, about.
PART_DRAWS, PLACES, TASK_SAMPLES = 8_000_000, 8192, 1_000_000
#: MD5: first state, numbers added and bits turned by step.
MD5_START = tuple(map(np.uint32, (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)))
MD5_ADD = [np.uint32(int(abs(sin(i + 1)) * 2**32)) for i in range(64)]
MD5_TURN = [[np.uint32(x) for x in row] for row in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))]


def counts_of(seed: int, level: int, node: int, n: int, weights: np.ndarray) -> np.ndarray:
    """How often each of the weights is drawn in n draws; the same for the same arguments."""
    if n == 0:
        return np.zeros(len(weights), np.int64)
    name = hashlib.blake2b(f"{seed}:{level}:{node}".encode(), digest_size=16).digest()
    shares = np.asarray(weights, np.float64)
    return np.random.Generator(np.random.Philox(key=int.from_bytes(name, "little"))).multinomial(n, shares / shares.sum())


def multinomial(df: DataFrame, weight: str, key: list[str], seed: int, draws: int | None = None) -> DataFrame:
    """The rows drawn, with `copies`: a multinomial sample with replacement, `draws` in all (as many as rows by default).

    Rows are dealt to blocks by a hash of their key. Block weights are added up a tree of FAN children a
    node; counts are then split down it, each node's among its children by their weights, and last
    among the rows of a block. Multinomial counts split so are multinomial. Each node is one row for a task, so nothing is
    gathered beyond a block or a node's children, and sums run in the order of keys, so reruns agree to the last bit. Rows are
    shuffled once, to the task of their block, where their counts meet them.

    A null or negative weight counts as zero, and LEAST_WEIGHT is added to each. Rows of equal keys share a block and
    are told apart by their weights, and by nothing if these are equal too. No rows give none.
    """
    session = df.sparkSession
    total = df.count()
    draws = total if draws is None else draws
    blocks = max(1, -(-total // BLOCK_ROWS))
    w = F.greatest(F.coalesce(F.col(weight).cast("double"), F.lit(0.0)), F.lit(0.0)) + F.lit(LEAST_WEIGHT)
    name = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(key)])
    tasks = max(int(session.conf.get("spark.sql.shuffle.partitions")), -(-total // ROWS_OF_TASK))
    rows = df.select(F.struct(*df.columns).alias("row"), name.alias("name"), w.alias("w"), F.pmod(F.xxhash64(*key), F.lit(blocks)).alias("node")).repartition(tasks, "node")
    # rows stay where their block is; a block's weights are in the order of its keys
    rows = checkpointed(rows.withColumn("place", F.row_number().over(Window.partitionBy("node").orderBy("name", "w")) - 1).drop("name"))
    weights = F.sort_array(F.collect_list(F.struct("place", "w")))
    level = checkpointed(rows.groupBy("node").agg(weights.alias("c")).select("node", F.transform("c", lambda c: c["w"]).alias("weights")))
    leaves, tree, now = level, [], level.select("node", F.aggregate("weights", F.lit(0.0), lambda a, x: a + x).alias("w"))
    size = blocks
    while size > 1:
        size = -(-size // FAN)
        grouped = now.groupBy(F.expr(f"node div {FAN}").alias("node")).agg(F.array_sort(F.collect_list(F.struct("node", "w"))).alias("c"))
        grouped = checkpointed(grouped.select("node", F.transform("c", lambda c: c["w"]).alias("weights"), F.transform("c", lambda c: c["node"]).alias("names")))
        tree.append(grouped)
        now = grouped.select("node", F.aggregate("weights", F.lit(0.0), lambda a, x: a + x).alias("w"))

    def split(depth: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lists = batch.column(2)
                ends, values = lists.offsets.to_numpy(), lists.values.to_numpy()
                found = [counts_of(seed, depth, node, n, values[a:b]) for node, n, a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), ends[:-1], ends[1:], strict=True)]
                counts = pa.ListArray.from_arrays(pa.array(ends - ends[0], pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *found]), pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0), counts], ["node", "counts"])
        return run

    counts = session.createDataFrame([(0, draws)], "node long, n long")
    for depth, nodes in [*reversed(list(enumerate(tree, 1))), (0, leaves)]:
        given = nodes.join(counts, "node").select("node", "n", "weights").mapInArrow(split(depth), "node long, counts array<long>")
        given = checkpointed(given)
        if depth:
            each = nodes.join(given, "node").select(F.explode(F.arrays_zip("names", "counts")).alias("z"))
            counts = each.where("z.counts > 0").select(F.col("z.names").alias("node"), F.col("z.counts").alias("n"))
    return rows.join(given, "node").select("row", F.get("counts", F.col("place")).alias("copies")).where("copies > 0").select("row.*", "copies")


def draw_sizes(n: Column) -> Column:
    """2, 4, 8, ... below n, and n; none for a single sample."""
    powers = F.filter(F.transform(F.sequence(F.lit(1), F.lit(40)), lambda p: F.expr("1L").cast("bigint") * F.pow(F.lit(2.0), p).cast("bigint")), lambda x: x < n)
    return F.when(n > 1, F.concat(powers, F.array(n)))


def drawn_index(key: Column, size: Column, resample: Column, i: Column, n: Column, seed: int) -> Column:
    """The place, from 0, of the i-th draw of a resample: a function of its names alone."""
    return F.floor(uniform(F.concat_ws(":", key.cast("string"), size.cast("string"), resample.cast("string"), i.cast("string")), seed) * n).cast("int")


def drawn_places(name: str, size: int, resamples: range, n: int, seed: int) -> np.ndarray:
    """The places of `drawn_index` for all draws of some resamples, a row each: MD5 sums of many short texts at once."""
    out = np.empty((len(resamples), size), np.int64)
    prefix = f"{seed}:{name}:{size}:".encode()
    for rows in _by_digits(resamples.start, resamples.stop):
        for places in _by_digits(0, size):
            some = np.empty(len(rows) * len(places), np.int64)
            for begin in range(0, len(some), PLACES):
                r, i = np.divmod(np.arange(begin, min(len(some), begin + PLACES)), len(places))
                numbers = md5_numbers(prefix, r + rows.start, len(str(rows.start)), i + places.start, len(str(places.start)))
                some[begin:begin + PLACES] = numbers / float(2**52) * n
            out[rows.start - resamples.start:rows.stop - resamples.start, places.start:places.stop] = some.reshape(len(rows), len(places))
    return out


def _by_digits(start: int, stop: int) -> list[range]:
    """The numbers from start to before stop, in parts of equally many decimal digits."""
    edges = [start, *(10**k for k in range(1, 20) if start < 10**k < stop), stop]
    return [range(a, b) for a, b in zip(edges, edges[1:], strict=False) if a < b]


def md5_numbers(prefix: bytes, first: np.ndarray, first_digits: int, second: np.ndarray, second_digits: int) -> np.ndarray:
    """The first 13 hex digits of the MD5 of a prefix followed by a number, a colon and a number, for many pairs of numbers of so many decimal digits."""
    colon = len(prefix) + first_digits
    length = colon + 1 + second_digits
    if length > 55:
        # more than one block
        return np.array([int(hashlib.md5(prefix + f"{r}:{i}".encode()).hexdigest()[:13], 16) for r, i in zip(first.tolist(), second.tolist(), strict=True)], np.int64)
    block = np.zeros(64, np.uint8)
    block[:len(prefix)] = np.frombuffer(prefix, np.uint8)
    block[colon], block[length] = ord(":"), 0x80
    block[56:] = np.frombuffer((length * 8).to_bytes(8, "little"), np.uint8)
    words: list = [np.uint32(w) for w in block.view("<u4")]
    for numbers, begin, end in ((first, len(prefix), colon), (second, colon + 1, length)):
        left = numbers.astype(np.uint32)
        for at in range(end - 1, begin - 1, -1):
            left, digit = np.divmod(left, np.uint32(10))
            words[at // 4] = words[at // 4] | ((digit + np.uint32(48)) << np.uint32(8 * (at % 4)))
    with np.errstate(over="ignore"):
        a, b, c, d = (np.full(len(first), s, np.uint32) for s in MD5_START)
        for step in range(64):
            if step < 16:
                mixed, word = d ^ (b & (c ^ d)), step
            elif step < 32:
                mixed, word = c ^ (d & (b ^ c)), (5 * step + 1) % 16
            elif step < 48:
                mixed, word = b ^ c ^ d, (3 * step + 5) % 16
            else:
                mixed, word = c ^ (b | ~d), 7 * step % 16
            mixed += a
            mixed += words[word] + MD5_ADD[step]
            turn = MD5_TURN[step // 16][step % 4]
            turned = mixed << turn
            mixed >>= np.uint32(32) - turn
            turned |= mixed
            turned += b
            a, d, c, b = d, c, b, turned
        high, low = ((x + s).byteswap().astype(np.int64) for x, s in zip((a, b), MD5_START, strict=False))
    return (high << 20) | (low >> 12)


def resample_outcomes(name: str, values: np.ndarray, kinds: np.ndarray, size: int, resamples: range, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best, worst and majority of each of some resamples of a group, whose predictions are told by numbers from 0."""
    at = drawn_places(name, size, resamples, len(values), seed)
    drawn, n_kinds, rows = values[at], int(kinds.max()) + 1, len(resamples)
    if n_kinds <= size:
        slot = kinds[at] + np.arange(rows)[:, None] * n_kinds
        votes = np.bincount(slot.ravel(), minlength=rows * n_kinds).reshape(rows, n_kinds)
        first = np.full(rows * n_kinds, size, np.int64)
        # the last write to a place holds, so draws are written from the last to the first
        first[slot[:, ::-1].ravel()] = np.broadcast_to(np.arange(size)[::-1], (rows, size)).ravel()
        first = first.reshape(rows, n_kinds)
        early = np.where(votes == votes.max(axis=1, keepdims=True), first, size).min(axis=1)
    else:
        early = np.empty(rows, np.int64)
        for row in range(rows):
            _, begins, votes = np.unique(kinds[at[row]], return_index=True, return_counts=True)
            early[row] = begins[votes == votes.max()].min()
    # as in Spark, a NaN is above all numbers
    worst = np.where(np.isnan(drawn).all(axis=1), np.nan, np.where(np.isnan(drawn), np.inf, drawn).min(axis=1))
    return drawn.max(axis=1), worst, drawn[np.arange(rows), early]


def _outcomes(seed: int):
    """Batches of (u, name, values, predictions, begin, end) of groups as a row a size and resample."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name, xs, ps, begin, end = (batch.column(k)[i] for k in range(1, 6))
                values = np.asarray(xs.values.to_numpy(zero_copy_only=False), np.float64)
                kinds = ps.values.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
                total = len(values)
                for size in [*(2**p for p in range(1, 40) if 2**p < total), total]:
                    step = max(1, 16 * PLACES // size)
                    for low in range(begin.as_py(), end.as_py(), step):
                        some = range(low, min(end.as_py(), low + step))
                        found = resample_outcomes(name.as_py(), values, kinds, size, some, seed)
                        same = batch.column(0).take(pa.array([i] * len(some)))
                        yield pa.RecordBatch.from_arrays([same, pa.array([size] * len(some), pa.int64()), *map(pa.array, found)], ["u", "n", "best", "worst", "maj"])

    return run


def bootstrap(df: DataFrame, uid: str, value: str, pred: str, order: str, resamples: int = 1000, seed: int = 42) -> DataFrame:
    """uid, n and mean and population deviation of best, worst and majority over resamples with replacement, for n = 2, 4, ... below N and N.

    The majority's value is the first drawn with the most frequent prediction, of ties the one drawn first. Draws are counter-based: a hash of
    uid, n, resample and place. Groups of up to ARRAY_SAMPLES samples are drawn from as arrays, many draws at once; larger ones are spread by joining every draw
    with its sample, with the same result. Groups of one sample, and null uids, give no rows; nulls among values are skipped, null predictions are a prediction.
    """
    rows = df.where(F.col(uid).isNotNull()).select(F.col(uid).alias("u"), F.col(value).cast("double").alias("x"), F.coalesce(F.concat(F.lit("p"), F.col(pred).cast("string")), F.lit("")).alias("p"), F.col(order).alias("o")).where("x is not null")
    sizes = checkpointed(rows.groupBy("u").agg(F.count(F.lit(1)).alias("all")).where("all > 1"))
    tries = F.explode(F.sequence(F.lit(1), F.lit(resamples)))
    # a group's resamples are dealt out in parts of about PART_DRAWS draws
    parts = F.greatest(F.lit(1), F.least(F.lit(resamples), F.ceil(F.col("all") * 3 * resamples / PART_DRAWS))).cast("int")
    small = checkpointed(rows.join(sizes.where(F.col("all") <= ARRAY_SAMPLES), "u").groupBy("u", "all").agg(F.array_sort(F.collect_list(F.struct("o", "x", "p"))).alias("s")))
    each = small.withColumn("parts", parts).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    edge = lambda k: F.floor(k * resamples / F.col("parts")).cast("int") + 1
    each = each.select("u", F.col("u").cast("string").alias("name"), F.transform("s", lambda x: x["x"]).alias("xs"), F.transform("s", lambda x: x["p"]).alias("ps"), edge(F.col("part")).alias("begin"), edge(F.col("part") + 1).alias("end"))
    # tasks of bounded arrays: a part is dealt to one of as many tasks as the samples of all parts need
    samples = small.agg(F.sum(F.col("all") * parts)).first()[0] or 0
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-samples // TASK_SAMPLES))
    outcomes = each.repartition(tasks).mapInArrow(_outcomes(seed), f"u {rows.schema['u'].dataType.simpleString()}, n long, best double, worst double, maj double")
    large = sizes.where(F.col("all") > ARRAY_SAMPLES)
    if not large.isEmpty():
        ordered = with_row_index(rows.join(large, "u"), "u", "o", "x", "p")
        begins = ordered.groupBy("u").agg(F.min("row_idx").alias("b"))
        placed = checkpointed(ordered.join(begins, "u").select("u", (F.col("row_idx") - F.col("b")).cast("int").alias("k"), "x", "p"))
        draws = large.withColumn("n", F.explode(draw_sizes(F.col("all")))).withColumn("r", tries).withColumn("i", F.explode(F.expr("sequence(0L, n - 1)")))
        draws = draws.withColumn("k", drawn_index(F.col("u"), F.col("n"), F.col("r"), F.col("i"), F.col("all"), seed))
        got = draws.join(placed, ["u", "k"])
        by_kind = got.groupBy("u", "n", "r", "p").agg(F.count(F.lit(1)).alias("votes"), F.min(F.struct("i", "x")).alias("first"), F.max("x").alias("hi"), F.min("x").alias("lo"))
        most = F.max(F.struct("votes", (-F.col("first.i")).alias("early"), F.col("first.x").alias("x"))).alias("m")
        outcomes = outcomes.unionByName(by_kind.groupBy("u", "n", "r").agg(F.max("hi").alias("best"), F.min("lo").alias("worst"), most).select("u", "n", "best", "worst", F.col("m.x").alias("maj")))
    both = [f(c).alias(f"{c}{s}") for c in ("best", "worst", "maj") for f, s in ((F.avg, ""), (F.stddev_pop, "_std"))]
    return outcomes.groupBy(F.col("u").alias(uid), "n").agg(*both)
