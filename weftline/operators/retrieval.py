"""Exact nearest neighbours of a stated set of queries, in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import formatted_passages

#: Vectors of a block, on either side; those of a block of queries that meet a block of rows at once.
BLOCK, TOGETHER = 2048, 256
#: Bytes of an Arrow batch, as a pair of blocks is a wide row; numbers of an array that is made of some rows at once.
BATCH_BYTES, NUMBERS = 16 << 20, 1 << 21


def bounded_bytes(df: DataFrame) -> None:
    """Let Arrow batches hold few bytes, as blocks of vectors are wide; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = df.sparkSession.conf.get(key)
    if not (now.isdigit() and 0 < int(now) <= BATCH_BYTES):
        df.sparkSession.conf.set(key, str(BATCH_BYTES))


def _matrix(vectors: pa.Array, kind=np.float64) -> np.ndarray:
    """Vectors of one length as a matrix, without Python's own numbers."""
    sizes = pc.unique(pc.list_value_length(vectors))
    if len(sizes) > 1:
        raise ValueError("vectors of different lengths")
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(vectors), -1)


def _best(q: pa.Scalar, v: pa.Scalar, key: str, k: int, digits: int, unit: bool) -> Iterator[pa.RecordBatch]:
    """The k rows of a block (id, e) that are nearest to each of a block of queries, some queries at a time; `unit` for vectors that are not of length 1 yet."""
    qi, vi = (np.array(x.values.field("id").to_pylist()) for x in (q, v))
    qe, ve = (_matrix(x.values.field("e")) for x in (q, v))
    if unit:
        qe, ve = (e / np.where((norms := np.sqrt((e**2).sum(1, keepdims=True))) == 0, 1, norms) for e in (qe, ve))
    for at in range(0, len(qi), TOGETHER):
        own = qi[at : at + TOGETHER]
        cos = np.where(own[:, None] == vi[None, :], -np.inf, qe[at : at + TOGETHER] @ ve.T)
        order = np.lexsort((np.broadcast_to(vi, cos.shape), -np.round(cos, digits)), axis=1)[:, :k]
        best = np.take_along_axis(cos, order, 1)
        some = np.isfinite(best)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, order.shape[1])[some.ravel()]), pa.array(vi[order][some]), pa.array(best[some])], ["query_id", key, "cosine"])


def blocks(vectors: DataFrame, key: str, embedding: str, rows: int = BLOCK) -> DataFrame:
    """Vectors packed about `rows` a row: ids and their embeddings, dealt by a hash of the key."""
    n = max(1, -(-vectors.count() // rows))
    return vectors.where(F.col(embedding).isNotNull()).groupBy(F.pmod(F.xxhash64(key), F.lit(n)).alias("_b")).agg(F.collect_list(F.struct(F.col(key).alias("id"), F.col(embedding).alias("e"))).alias("v")).select("v")


def nearest(vectors: DataFrame, queries: DataFrame, key: str, embedding: str, k: int, rows: int = BLOCK) -> DataFrame:
    """(query_id, key, cosine, rank): the k rows of largest cosine for each query, itself left out; of equal ones the smaller key.

    Every block of queries meets every block of rows once; a pair of blocks is one
    matrix product and gives k rows a query, so what is shuffled is k times the
    queries for each block of rows. Null and zero vectors are like nothing.
    """
    kind = vectors.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q, v in zip(batch.column(0), batch.column(1), strict=True):
                yield from _best(q, v, key, k, 12, unit=True)

    bounded_bytes(vectors)
    pairs = blocks(queries, key, embedding, rows).withColumnRenamed("v", "q").crossJoin(blocks(vectors, key, embedding, rows))
    found = pairs.mapInArrow(run, f"query_id {kind}, {key} {kind}, cosine double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("cosine", 12)), key))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def passages(hits: DataFrame, texts: DataFrame, key: str, text: str, out: str = "passages") -> DataFrame:
    """query_id and the formatted passages of its hits (query_id, key, rank), in the order of rank; hits without a text are left out. A query has few hits."""
    joined = hits.join(texts.select(key, F.col(text).alias("_text")), key).where(F.col("_text").isNotNull())
    ranked = joined.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "_text"))).alias("_r"))
    return ranked.select("query_id", formatted_passages(F.transform("_r", lambda x: x["_text"])).alias(out))


#: Vectors of the sample that centroids are fitted on, at most; every row is assigned, whatever the sample.
SAMPLE = 20_000
#: Rounds of the fit, and the least number of a list's vectors in the sample.
ROUNDS, PER_LIST = 8, 8
#: Queries of the sample that tell how many lists to look up, the neighbours of each, and the share of these to be found.
TRIED, NEIGHBOURS, RECALL = 500, 5, 0.95


def _sample(vectors: DataFrame, key: str, embedding: str, sample: int, seed: int) -> np.ndarray:
    """Unit vectors of the rows of the `sample` smallest key hashes."""
    good = vectors.where(F.col(embedding).isNotNull())
    rows = good.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(sample).select(embedding).toArrow().column(0).to_pylist()
    x = np.array(rows, np.float64).reshape(len(rows), -1) if rows else np.zeros((0, 1))
    norms = np.sqrt((x**2).sum(1))
    return x[norms > 0] / norms[norms > 0, None]


def fitted_centroids(vectors: DataFrame, key: str, embedding: str, lists: int | None = None, sample: int = SAMPLE, seed: int = 1) -> np.ndarray:
    """Unit centroids of an inverted file: spherical k-means on the vectors of the `sample` smallest key hashes, so of a bounded size on the driver.

    About the square root of all rows are made (`lists`), but no more than the sample has vectors for.
    """
    x = _sample(vectors, key, embedding, sample, seed)
    if not len(x):
        return np.zeros((0, 0), np.float32)
    wanted = int(np.sqrt(vectors.where(F.col(embedding).isNotNull()).count())) if lists is None else lists
    n = max(1, min(wanted, len(x) // PER_LIST))
    rng = np.random.default_rng(seed)
    centroids = x[rng.choice(len(x), n, replace=False)]
    for _ in range(ROUNDS):
        own = np.argmax(x @ centroids.T, 1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, x)
        size = np.sqrt((sums**2).sum(1, keepdims=True))
        centroids = np.where(size > 0, sums / np.where(size > 0, size, 1), centroids)
    return centroids.astype(np.float32)


def probes_for(vectors: DataFrame, key: str, embedding: str, centroids: np.ndarray, recall: float = RECALL, sample: int = SAMPLE, seed: int = 1) -> int:
    """How many lists a query must look up so that `recall` of the nearest neighbours of the sample's first TRIED vectors, among the sample, lie in them.

    Neighbours among all rows are nearer than those among a sample, so the number is rather too large.
    """
    x = _sample(vectors, key, embedding, sample, seed)
    if len(x) < 2:
        return max(1, len(centroids))
    q = x[:TRIED]
    cos = q @ x.T
    cos[np.arange(len(q)), np.arange(len(q))] = -np.inf
    near = np.argsort(-cos, axis=1)[:, : min(NEIGHBOURS, len(x) - 1)]
    own = np.argmax(x @ centroids.T, 1)
    place = np.argsort(np.argsort(-(q @ centroids.T), axis=1), axis=1)
    ranks = np.sort(np.take_along_axis(place, own[near], 1).ravel())
    return int(ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))) - 1)]) + 1


def inverted_file(vectors: DataFrame, key: str, embedding: str, centroids: np.ndarray) -> DataFrame:
    """list, id and e (unit vector) of every row with a vector that isn't zero: each lies in the list of its nearest centroid. No shuffle.

    The centroids go out with the tasks: they are as many as fitted_centroids makes, from a sample of a bounded size.
    """
    return _to_lists(vectors, key, embedding, centroids, 1)


def _to_lists(vectors: DataFrame, key: str, embedding: str, centroids: np.ndarray, probes: int) -> DataFrame:
    kind = vectors.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            e = _matrix(batch.column(1), np.float32)
            norms = np.sqrt((e.astype(np.float64) ** 2).sum(1))
            good = np.flatnonzero(norms > 0)
            # as many rows at once as give arrays of about NUMBERS numbers
            step = max(1, NUMBERS // max(1, len(centroids), min(probes, len(centroids)) * e.shape[1]))
            for at in range(0, len(good) if len(centroids) else 0, step):
                some = good[at : at + step]
                unit = (e[some] / norms[some, None]).astype(np.float32)
                near = np.argsort(-(unit @ centroids.T), axis=1, kind="stable")[:, :probes]
                each = np.repeat(np.arange(len(some)), near.shape[1])
                ends = np.arange(len(each) + 1, dtype=np.int32) * e.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(near.ravel().astype(np.int32)), batch.column(0).take(pa.array(some[each])), pa.ListArray.from_arrays(pa.array(ends), pa.array(unit[each].ravel()))], ["list", "id", "e"])

    return vectors.where(F.col(embedding).isNotNull()).select(key, embedding).mapInArrow(run, f"list int, id {kind}, e array<float>")


def _packed(rows: DataFrame, name: str, size: int) -> DataFrame:
    """The rows of each list in blocks of about `size`: ids and vectors. A large list has many blocks."""
    counts = rows.groupBy("list").agg(F.count(F.lit(1)).alias("n"))
    part = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / size).cast("bigint"))
    return rows.join(counts, "list").groupBy("list", part.alias("part")).agg(F.collect_list(F.struct("id", "e")).alias(name)).drop("part")


def nearest_indexed(index: DataFrame, centroids: np.ndarray, queries: DataFrame, key: str, embedding: str, k: int, probes: int, rows: int = BLOCK) -> DataFrame:
    """(query_id, key, cosine, rank): of the vectors in the `probes` lists nearest to a query the k of largest cosine, itself left out.

    A query meets the blocks of its lists only, so work grows with the queries and the length of lists, not with all rows a query.
    What lies in other lists is missed; probes_for tells how many lists to look up, and `nearest` is exact.
    """
    kind = queries.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q, v in zip(batch.column(0), batch.column(1), strict=True):
                yield from _best(q, v, key, k, 6, unit=False)

    bounded_bytes(queries)
    asked = _packed(_to_lists(queries, key, embedding, centroids, probes), "q", rows)
    found = asked.join(_packed(index, "v", rows), "list").select("q", "v").mapInArrow(run, f"query_id {kind}, {key} {kind}, cosine double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("cosine", 6)), key))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)
