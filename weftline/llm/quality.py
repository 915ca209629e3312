"""A quality classifier: a factorisation machine over hashed words, structure and size.

The score of a text is a logistic function of a bias, a weight a feature and the
interaction of every pair of features, the inner product of their low-rank
factors. By the identity of the sum of squares, all pairs cost one pass over the
features: half of (sum of factors)^2 less the sum of (factors)^2.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import bounded_batches

BUCKETS = 1 << 14
RANK = 8
#: Labelled rows that the fit uses at most, those of the least hashes: the one bound of the method.
TRAIN_ROWS = 6000
EPOCHS = 12
RATE = 0.1
DECAY = 1e-5
SEED = 8

_SIGNS = re.compile(r"[^\w\s]+")
_DIGITS = re.compile(r"\d+")
_UPPER = re.compile(r"[^\W\d_]{2,}")

#: Structure statistics and metadata of a text, each scaled to about 0 to 1.
DENSE = (
    "chars", "words", "lines", "word_length", "distinct_words", "distinct_lines", "signs", "sign_runs", "digits", "spaces",
    "upper_words", "no_letter_words", "ended_lines", "line_length", "common_word", "long_words", "line_ends_varied", "first_upper",
)


def statistics(text: str, words: list[str], counts: Counter) -> list[float]:
    n, chars = len(words), max(1, len(text))
    lines = [line for line in text.split("\n") if line.strip()] or [""]
    letters = [w for w in counts if any(map(str.isalpha, w))]
    signs = _SIGNS.findall(text)
    upper = sum(c for w, c in counts.items() if len(w) > 1 and w.isupper())
    total = max(1, n)
    return [
        np.log1p(len(text)) / 12, np.log1p(n) / 10, np.log1p(len(lines)) / 6, min(1.0, (len(text) - text.count(" ")) / total / 15),
        len(counts) / total, len(set(lines)) / len(lines), min(1.0, 4 * sum(map(len, signs)) / chars), min(1.0, sum(len(s) > 1 for s in signs) / total),
        min(1.0, 4 * sum(map(len, _DIGITS.findall(text))) / chars), text.count(" ") / chars, upper / total,
        1 - sum(counts[w] for w in letters) / total, sum(line.rstrip()[-1:] in ".!?" for line in lines) / len(lines), min(1.0, len(text) / len(lines) / 500),
        max(counts.values(), default=0) / total, sum(c for w, c in counts.items() if len(w) > 15) / total,
        len({line.rstrip()[-1:] for line in lines}) / len(lines), sum(line.lstrip()[:1].isupper() for line in lines) / len(lines),
    ]


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values: statistics first, then hashed words by the logarithm of their counts, to unit length.

    Words are also known by their shape (signs at the end, capitals), which junk texts repeat.
    """
    words = (text or "").split()
    counts = Counter(words)
    hashed: dict[int, float] = {}
    for w, c in counts.items():
        for key in (w.lower(), "\x01" + w[-2:] if not w[-1:].isalnum() else None, "\x02" + "A" * min(3, len(w)) if w.isupper() else None):
            if key is not None:
                h = zlib.crc32(key.encode("utf-8", "surrogatepass")) % BUCKETS
                hashed[h] = hashed.get(h, 0) + c
    index = np.fromiter(hashed, np.int64, len(hashed))
    value = np.log1p(np.fromiter(hashed.values(), np.float64, len(hashed)))
    norm = np.sqrt((value**2).sum()) or 1.0
    dense = np.array(statistics(text or "", words, counts))
    return np.concatenate([np.arange(len(DENSE)), index + len(DENSE)]), np.concatenate([dense, value / norm])


@dataclass
class Model:
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def score(self, rows: list[tuple[np.ndarray, np.ndarray]], at_once: int = 100) -> np.ndarray:
        """Probabilities, in time linear in the features and in the memory of `at_once` rows."""
        return np.concatenate([self._score(rows[i : i + at_once]) for i in range(0, len(rows), at_once)] or [np.zeros(0)])

    def _score(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        sizes = np.array([len(i) for i, _ in rows])
        index, value = np.concatenate([i for i, _ in rows]), np.concatenate([v for _, v in rows])
        starts = np.cumsum(sizes) - sizes
        linear = np.add.reduceat(self.weights[index] * value, starts)
        parts = self.factors[index] * value[:, None]
        sums, squares = np.add.reduceat(parts, starts, axis=0), np.add.reduceat(parts**2, starts, axis=0)
        z = self.bias + linear + 0.5 * (sums**2 - squares).sum(1)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """Adaptive gradient steps on the logistic loss, over small batches in a seeded order.

    Both classes weigh alike in the loss up to a factor of four, and the bias is then
    set so that a half is the threshold with the fewest errors on the fitted rows.
    With no rows every score is one half; with one class all rows follow it.
    """
    rng = np.random.default_rng(seed)
    size = len(DENSE) + BUCKETS
    model = Model(0.0, np.zeros(size), rng.normal(0, 0.02, (size, RANK)))
    n = len(rows)
    if not n:
        model.factors[:] = 0
        return model
    labels = labels.astype(np.float64)
    share = labels.mean()
    if share in (0.0, 1.0):
        model.bias, model.factors[:] = (6.0 if share else -6.0), 0
        return model
    weight = np.where(labels == 1, min(4.0, max(1.0, (1 - share) / share)), min(4.0, max(1.0, share / (1 - share))))
    model.bias = float(np.log(share / (1 - share)))
    gb, gw, gf = 1e-8, np.full(size, 1e-8), np.full((size, RANK), 1e-8)
    for _ in range(epochs):
        order = rng.permutation(n)
        for k in range(0, n, 32):
            part = order[k : k + 32]
            sizes = np.array([len(rows[i][0]) for i in part])
            index, value = np.concatenate([rows[i][0] for i in part]), np.concatenate([rows[i][1] for i in part])
            owner = np.repeat(np.arange(len(part)), sizes)
            factors = model.factors[index] * value[:, None]
            sums = np.add.reduceat(factors, np.cumsum(sizes) - sizes, axis=0)
            z = model.bias + np.bincount(owner, model.weights[index] * value) + 0.5 * ((sums**2).sum(1) - np.bincount(owner, (factors**2).sum(1)))
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[part]) * weight[part] / len(part)
            e = error[owner]
            seen, at = np.unique(index, return_inverse=True)
            dw = np.bincount(at, e * value) + DECAY * model.weights[seen]
            df = np.zeros((len(seen), RANK))
            np.add.at(df, at, (e * value)[:, None] * (sums[owner] - factors))
            df += DECAY * model.factors[seen]
            db = error.sum()
            gb, gw[seen], gf[seen] = gb + db**2, gw[seen] + dw**2, gf[seen] + df**2
            model.bias -= RATE * db / np.sqrt(gb)
            model.weights[seen] -= RATE * dw / np.sqrt(gw[seen])
            model.factors[seen] -= RATE * 0.5 * df / np.sqrt(gf[seen])
    p = np.clip(model.score(rows), 1e-9, 1 - 1e-9)
    z = np.sort(np.log(p / (1 - p)))
    cuts = (z[1:] + z[:-1]) / 2
    order = np.argsort(p)
    wrong = np.cumsum(labels[order])[:-1] + (1 - labels[order])[::-1].cumsum()[::-1][1:]
    best = np.flatnonzero(wrong == wrong.min())
    model.bias -= float(cuts[best[len(best) // 2]]) if len(cuts) else 0.0
    return model


def held_out_column(remainder: int, modulus: int):
    """Whether a document is held out: crc32 of its id as text, null as 'null'."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))) % modulus == remainder


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Fit on at most `rows` labelled documents that aren't held out.

    The sample is those of the least hashes, a top-k that Spark takes without a full
    sort; features are made on the executors and only they come to the driver.
    Rows with a null label are left out; a document with several labels counts once for each.
    """
    wanted = labels.where("quality is not null").select("doc_id", F.col("quality").cast("int").alias("_label")).where(~held_out_column(1, 3))
    picked = F.broadcast(wanted.orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id", "_label").limit(rows))
    sample = docs.select("doc_id", "text").join(picked, "doc_id").select("doc_id", "_label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), batch.column(1), pa.array([i.astype("<i4").tobytes() for i, _ in found], pa.binary()), pa.array([v.astype("<f4").tobytes() for _, v in found], pa.binary())],
                ["doc_id", "label", "index", "value"])

    bounded_batches(docs.sparkSession)
    got = sorted(sample.mapInArrow(run, "doc_id long, label int, index binary, value binary").toLocalIterator(), key=lambda r: (r[0], r[1], bytes(r[2])))
    found, classes = [(np.frombuffer(r[2], "<i4").astype(np.int64), np.frombuffer(r[3], "<f4").astype(np.float64)) for r in got[:rows]], np.array([r[1] for r in got[:rows]])
    del got
    return fit(found, classes)


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted for every row. Only texts are inputs.

    Empty and null texts have a score like others; rows stay where they are.
    """
    packed = docs.sparkSession.sparkContext.broadcast((model.bias, model.weights, model.factors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*packed.value)
        for batch in batches:
            texts = batch.column(2).to_pylist()
            p = np.concatenate([m.score([features(t) for t in texts[i : i + 100]]) for i in range(0, len(texts), 100)] or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), batch.column(1), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32), pa.int32())],
                ["doc_id", "held_out", "score", "predicted"])

    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", held_out_column(1, 3).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows whose score is at least `least`, with all their columns."""
    packed = docs.sparkSession.sparkContext.broadcast((model.bias, model.weights, model.factors))

    @F.pandas_udf("boolean")
    def good(texts):
        import pandas as pd

        m = Model(*packed.value)
        rows = [features(t if isinstance(t, str) else None) for t in texts]
        return pd.Series(np.concatenate([m.score(rows[i : i + 100]) for i in range(0, len(rows), 100)] or [np.zeros(0)]) >= least)

    bounded_batches(docs.sparkSession)
    return docs.where(good("text"))
