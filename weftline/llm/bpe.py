"""Byte-level BPE by rank tables, over padded matrices of many pre-tokens at once.

Distinct pre-tokens are dealt into matrices by length. In each round every row
merges its leftmost pair of minimum rank: pair ranks come from a hash table looked
up for whole matrices, and rows are compacted to the left. A row leaves the matrix
when no pair of it has a rank. Ranks and merging are those of the public
tiktoken-style vocabularies, where a pair's rank is the id of its joined bytes.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from weftline.llm.common import bounded_batches, give_back
from weftline.llm.pieces import Memo
from weftline.llm.words import PieceEncoder

NONE = np.int32(2**31 - 1)
#: Cells of a matrix at most; longer rows come alone.
CELLS = 1 << 20
_CODECS: dict = {}


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PairTable:
    """(left id, right id) -> id of the joined bytes, in open addressing over numpy arrays."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, values = [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    values.append(rank)
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        left, put = np.array(keys, np.int64), np.array(values, np.int32)
        slot = self._slot(left)
        self.steps = 0
        while len(left):
            self.steps += 1
            free = self.keys[slot] == -1
            self.keys[slot[free]] = left[free]  # of several keys for a slot, the last one gets it
            won = self.keys[slot] == left
            self.values[slot[won]] = put[won]
            left, put, slot = left[~won], put[~won], (slot[~won] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the pairs; NONE where a pair has none, or an id is negative (padding)."""
        out = np.full(a.shape, NONE, np.int32)
        at = np.flatnonzero((a >= 0) & (b >= 0))
        keys = a.ravel()[at].astype(np.int64) << 32 | b.ravel()[at]
        slot = self._slot(keys)
        flat = out.ravel()
        for _ in range(self.steps):
            held = self.keys[slot]
            hit = held == keys
            flat[at[hit]] = self.values[slot[hit]]
            more = ~hit & (held != -1)
            if not more.any():
                break
            at, keys, slot = at[more], keys[more], (slot[more] + 1) & ((1 << self.bits) - 1)
        return flat.reshape(a.shape)


class Codec(PieceEncoder):
    """Encode and decode by a rank file and a pre-token pattern.

    Texts are cut into pieces where the public byte-level pattern always begins a match;
    with another pattern every text is matched whole.
    """

    def __init__(self, ranks_path: str, pattern: str, most: int = 600_000):
        import regex

        super().__init__(most, pattern, together=50_000)  # large matrices take few rounds

        ranks = load_ranks(ranks_path)
        self.ranks = ranks
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.pairs = PairTable(ranks)
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.pattern = regex.compile(pattern)
        self.words = Memo(self.encode_words, 50_000)

    def merge(self, rows: list[bytes]) -> list[np.ndarray]:
        """Ids of rows of similar length, by rounds over one padded matrix."""
        out: list = [None] * len(rows)
        width = max(map(len, rows))
        ids = np.full((len(rows), width), -1, np.int32)
        for i, row in enumerate(rows):
            ids[i, : len(row)] = self.byte_ids[np.frombuffer(row, np.uint8)]
        size = np.array([len(r) for r in rows])
        owner = np.arange(len(rows))
        ranks = self.pairs.find(ids[:, :-1], ids[:, 1:])
        while len(owner):
            if ranks.shape[1]:
                where = ranks.argmin(1)  # the leftmost of equal ranks
                best = ranks[np.arange(len(owner)), where]
            else:
                where, best = np.zeros(len(owner), np.int64), np.full(len(owner), NONE)
            done = best == NONE
            if done.any():
                for i in np.flatnonzero(done):
                    out[owner[i]] = ids[i, : size[i]].copy()
                going = ~done
                ids, ranks, size, owner, where, best = ids[going], ranks[going], size[going], owner[going], where[going], best[going]
                if not len(owner):
                    break
            if len(owner) == 1 and ids.shape[1] > 256:
                ids, ranks, size = self._merge_runs(ids[0, : size[0]], ranks[0, : size[0] - 1], int(best[0]))
                continue
            width = int(size.max()) - 1
            column = np.arange(width)
            source = column + (column > where[:, None])  # cells right of the merge move one to the left
            ids = np.take_along_axis(ids, source, 1)
            n = np.arange(len(owner))
            ids[n, where] = best
            size = size - 1
            if width > 1:
                source = np.minimum(column[:-1] + (column[:-1] > where[:, None]), ranks.shape[1] - 1)
                ranks = np.take_along_axis(ranks, source, 1)
                right = n[where < width - 1]
                ranks[right, where[right]] = self.pairs.find(best[right], ids[right, where[right] + 1])
                left = n[where > 0]
                ranks[left, where[left] - 1] = self.pairs.find(ids[left, where[left] - 1], best[left])
                ranks[column[:-1] >= size[:, None] - 1] = NONE
            else:
                ranks = np.full((len(owner), 0), NONE, np.int32)
        return out

    def _merge_runs(self, ids: np.ndarray, ranks: np.ndarray, best: int):
        """Several rounds of one long row at once.

        The occurrences of the minimum rank are merged from the left, up to and
        including the first whose merge makes a pair of the same or a lower rank:
        until there, the next leftmost minimum is always the next occurrence.
        """
        spots = np.flatnonzero(ranks == best)
        keep, last = [], -2
        for s in spots.tolist():
            if s > last + 1:
                keep.append(s)
                last = s
        at = np.array(keep)
        before = np.where(at > 0, ids[at - 1], -1)
        joined = np.concatenate([[False], at[1:] == at[:-1] + 2])  # the neighbour is a merged pair by then
        before = np.where(joined, best, before).astype(np.int32)
        after = np.where(at + 2 < len(ids), ids[np.minimum(at + 2, len(ids) - 1)], -1).astype(np.int32)
        new = np.full(len(at), best, np.int32)
        bad = (self.pairs.find(before, new) <= best) | (self.pairs.find(new, after) <= best)
        if bad.any():
            at = at[: int(bad.argmax()) + 1]
        ids = ids.copy()
        ids[at] = best
        ids = np.delete(ids, at + 1)
        return ids[None, :], self.pairs.find(ids[:-1], ids[1:])[None, :], np.array([len(ids)])

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of pre-tokens as little-endian 32-bit bytes. Whole tokens need no merging."""
        out: list = [None] * len(words)
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            rank = self.ranks.get(w)
            if rank is not None:
                out[i] = rank.to_bytes(4, "little")
            elif len(w) > 1:
                n = len(w)
                by_length.setdefault(n if n <= 16 else -(-n // 8) * 8 if n <= 64 else 1 << n.bit_length(), []).append(i)
            else:
                out[i] = b""
        for length, all_rows in by_length.items():
            step = max(1, CELLS // length)
            for k in range(0, len(all_rows), step):
                rows = all_rows[k : k + step]
                for i, ids in zip(rows, self.merge([words[i] for i in rows]), strict=True):
                    out[i] = ids.astype("<u4").tobytes()
        return out

    def _matched(self, texts: list[str]) -> list[bytes]:
        found = [[w.encode("utf-8", "surrogatepass") for w in self.pattern.findall(t)] for t in texts]
        known = self.words.learn({w for row in found for w in row})
        return [b"".join(map(known.__getitem__, row)) for row in found]

    def whole(self, text: str) -> np.ndarray:
        return np.frombuffer(self._matched([text])[0], "<u4")

    def listed(self, pieces: list[bytes], lead: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        parts = self._matched([p.decode() for p in pieces])
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts))) // 4
        return np.frombuffer(b"".join(parts), "<u4"), np.concatenate([[0], ends[:-1]]), ends

    def encode_texts(self, texts: list[str | None]) -> list[np.ndarray]:
        ids, counts = self.encode(texts)
        return np.split(ids, np.cumsum(counts)[:-1]) if len(texts) else []

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids; an id without a token is an error."""
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


#: Texts of a batch where whole ids go on with the rows.
ROWS = 200


def codec(ranks_path: str, pattern: str) -> Codec:
    """One codec a worker process, as its tables take a second to make."""
    key = (ranks_path, pattern)
    if key not in _CODECS:
        _CODECS[key] = Codec(*key)
    return _CODECS[key]


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """The rows with their ids in an array column `out` (an older column of that name is replaced).

    A null or empty text has no ids. No shuffle: rows stay where they are.
    """
    from pyspark.sql import functions as F

    bounded_batches(docs.sparkSession, ROWS)

    @F.pandas_udf("array<int>")
    def run(texts):
        import pandas as pd

        found = pd.Series([x.astype(np.int32) for x in codec(ranks_path, pattern).encode_texts([t if isinstance(t, str) else None for t in texts])])
        give_back()
        return found

    return docs.withColumn(out, run(F.col(text)))


def decode(encoded: DataFrame, ranks_path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """The rows with the bytes of their ids in a binary column; null ids give null."""
    from pyspark.sql import functions as F

    @F.pandas_udf("binary")
    def run(column):
        import pandas as pd

        found = pd.Series([None if x is None else codec(ranks_path, pattern).decode(np.asarray(x)) for x in column])
        give_back()
        return found

    return encoded.withColumn(out, run(F.col(ids)))


def digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the decimal ids and of the bytes decoded from them.

    Null and empty texts have no ids and the digests of nothing; repeated rows give
    equal rows; texts of any length are encoded whole; no rows give none. Only doc_id
    and text are read.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches):
        c = codec(ranks_path, pattern)
        names = [str(i) for i in range(len(c.tokens))]
        for batch in batches:
            rows = []
            for ids in c.encode_texts(batch.column(1).to_pylist()):
                decimal = " ".join(map(names.__getitem__, ids.tolist())).encode()
                rows.append((len(ids), hashlib.sha256(decimal).hexdigest(), hashlib.sha256(c.decode(ids)).hexdigest()))
            columns = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), *(pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.string(), pa.string()), strict=True))],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, schema)
