"""Language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1 of its own, made when it is first met from a
generator that its code point seeds, so all workers have the same. The vector of an n-gram binds the
vectors of its letters, each rotated by its place, into their product; a text
bundles the vectors of its n-grams into their sum. Prototypes bundle the texts of
a language, and a text has the language whose prototype has the largest cosine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import bounded_batches
from weftline.llm.quality import held_out_column

DIM = 1024
GRAM = 3
SEED = 9
#: Bits of a letter in the code of an n-gram; code point 0 stands for the gap between words.
BITS = 21
#: Vectors of letters that a worker keeps; alphabets are smaller, and a letter's vector can be made again.
KEPT = 20_000
#: Labelled rows that the prototypes bundle at most, those of the least hashes.
TRAIN_ROWS = 20_000
AT_ONCE = 1 << 20  # characters worked on together
GRAMS_AT_ONCE = 4096

_LETTERS: dict = {}
_VECTORS: dict[int, np.ndarray] = {}


def letters_of(codes: np.ndarray) -> np.ndarray:
    """Code points of letters in lower case; 0 for all that aren't letters."""
    table = _LETTERS.setdefault("table", np.full(0x110000, -1, np.int32))
    known = table[codes]
    for c in np.unique(codes[known < 0]):
        low = chr(int(c)).lower()[:1]
        table[c] = ord(low) if low.isalpha() else 0
    return table[codes] if (known < 0).any() else known


def letter_vector(code: int) -> np.ndarray:
    """The vector of a letter, or of the gap."""
    if code not in _VECTORS:
        if len(_VECTORS) >= KEPT:
            _VECTORS.clear()
        _VECTORS[code] = np.random.default_rng([SEED, code]).choice(np.array([-1, 1], np.int8), DIM)
    return _VECTORS[code]


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Row and n-gram code of every n-gram of the texts; runs of other signs are one gap."""
    found_rows, found_codes = [], []
    part: list[str] = []
    rows: list[int] = []

    def flush() -> None:
        data = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), "<u4")
        owner = np.repeat(np.array(rows), [len(p) for p in part])
        slot = letters_of(data)
        keep = np.concatenate([[True], (slot[1:] != 0) | (slot[:-1] != 0) | (owner[1:] != owner[:-1])])
        slot, owner = slot[keep].astype(np.int64), owner[keep]
        code = np.zeros(max(0, len(slot) - GRAM + 1), np.int64)
        for i in range(GRAM):
            code = code << BITS | slot[i : len(slot) - GRAM + 1 + i]
        same = owner[: len(code)] == owner[GRAM - 1 :]
        some = same & (code != 0)
        found_rows.append(owner[: len(code)][some])
        found_codes.append(code[some])

    held = 0
    for i, text in enumerate(texts):
        # gaps around each text, so that a single letter makes an n-gram as well; long texts go in overlapping parts
        body = f" {text or ''} "
        for at in range(0, max(1, len(body) - GRAM + 1), AT_ONCE):
            piece = body[at : at + AT_ONCE + GRAM - 1]
            if part and (held + len(piece) > AT_ONCE or rows[-1] == i):
                flush()
                part, rows, held = [], [], 0
            part.append(piece)
            rows.append(i)
            held += len(piece)
    if part:
        flush()
    if not found_rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_rows), np.concatenate(found_codes)


def vectors_of(codes: np.ndarray) -> np.ndarray:
    """The bound vectors of n-grams."""
    out = np.ones((len(codes), DIM), np.float32)
    for i in range(GRAM):
        own, at = np.unique(codes >> BITS * (GRAM - 1 - i) & (1 << BITS) - 1, return_inverse=True)
        placed = np.roll(np.stack([letter_vector(int(c)) for c in own]), i, axis=1).astype(np.float32)
        out *= placed[at]
    return out


def bundle(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of texts, and whether they have a letter."""
    rows, codes = grams(texts)
    out = np.zeros((len(texts), DIM), np.float32)
    has = np.zeros(len(texts), bool)
    has[rows] = True
    known, at = np.unique(codes, return_inverse=True)
    for k in range(0, len(known), GRAMS_AT_ONCE):
        n = min(GRAMS_AT_ONCE, len(known) - k)
        some = (at >= k) & (at < k + n)
        for r in range(0, len(texts), 256):
            own = some & (rows >= r) & (rows < r + 256)
            if own.any():
                m = min(256, len(texts) - r)
                counts = np.bincount((rows[own] - r) * n + at[own] - k, minlength=m * n).reshape(m, n).astype(np.float32)
                out[r : r + m] += counts @ vectors_of(known[k : k + n])
    return out, has


def prototypes(docs: DataFrame, rows: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages and their unit prototypes, from at most `rows` labelled documents.

    Documents with crc32(doc_id) mod 4 = 2 or a null lang take no part. Executors add
    up their texts' unit vectors by language; only these sums come together.
    """
    base = docs.where(F.col("lang").isNotNull() & ~held_out_column(2, 4)).select("doc_id", "lang", "text")
    edge = base.select(F.xxhash64("doc_id", F.lit(SEED)).alias("h")).orderBy("h").limit(rows).agg(F.max("h")).first()[0]
    if edge is None:
        return [], np.zeros((0, DIM), np.float32)
    sample = base.where(F.xxhash64("doc_id", F.lit(SEED)) <= edge).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            vectors, has = bundle(texts)
            norms = np.sqrt((vectors**2).sum(1, keepdims=True))
            vectors = vectors / np.where(norms == 0, 1, norms)
            for lang in set(langs):
                own = np.array([x == lang for x in langs]) & has
                sums[lang] = sums.get(lang, np.zeros(DIM)) + vectors[own].sum(0, dtype=np.float64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], ["lang", "v"])

    bounded_batches(docs.sparkSession, 500)
    parts = sample.mapInArrow(run, "lang string, v array<double>").select("lang", F.posexplode("v"))
    total = parts.groupBy("lang", "pos").agg(F.sum("col").alias("x")).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("v"))
    got = sorted((r["lang"], [x["x"] for x in r["v"]]) for r in total.collect())
    matrix = np.array([v for _, v in got], np.float32).reshape(len(got), DIM)
    norms = np.sqrt((matrix**2).sum(1, keepdims=True))
    return [name for name, _ in got], matrix / np.where(norms == 0, 1, norms)


def predict(docs: DataFrame, langs: list[str], matrix: np.ndarray) -> DataFrame:
    """doc_id, held_out, lang_pred and score, the cosine moved to 0..1, for every row.

    `und` with score 0 if a text is null or has no letter, or nothing was learned. Of equal cosines the first language counts;
    repeated rows have equal results, texts are taken whole, and no rows give none.
    """
    packed = docs.sparkSession.sparkContext.broadcast((langs, matrix))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, protos = packed.value
        for batch in batches:
            preds: list[str] = []
            scores: list[float] = []
            texts = batch.column(2).to_pylist()
            for i in range(0, len(texts), 256):
                vectors, has = bundle(texts[i : i + 256])
                if not names:
                    has[:] = False
                norms = np.sqrt((vectors**2).sum(1))
                cos = vectors @ protos.T / np.where(norms == 0, 1, norms)[:, None] if names else np.zeros((len(has), 1))
                best = cos.argmax(1)
                preds += [names[b] if h else "und" for b, h in zip(best.tolist(), has.tolist(), strict=True)]
                scores += np.where(has, np.clip((1 + cos[np.arange(len(best)), best]) / 2, 0, 1), 0.0).tolist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), batch.column(1), pa.array(preds, pa.string()), pa.array(scores, pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"])

    bounded_batches(docs.sparkSession, 500)
    return docs.select("doc_id", held_out_column(2, 4).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row, by prototypes of the labelled rows among them.

    Null texts and texts without a letter are `und`; long texts are taken whole; repeated rows are predicted alike, and each takes part in
    the prototypes that may; an empty table gives no rows. Only doc_id, lang and text are read, lang for the prototypes only.
    """
    return predict(docs, *prototypes(docs, rows))
