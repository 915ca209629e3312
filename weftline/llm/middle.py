"""Fill-in-middle transformation on big integers whose bits stand for the bytes of a text.

bytes.translate turns the UTF-8 bytes of a text into digits 0 and 1 for a class (word
bytes; bytes that begin a character), and int() reads them as one integer, the first byte
as the highest bit. A token ends at a word byte that isn't followed by one, and at the
text's last byte: a shift, a complement and an AND mark all ends at once, bit_count counts
them, and halving the integer again and again finds the end of the k-th token. All
steps are linear in the text. Tokens part at ASCII white space only, so bytes do as well as
characters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import bounded_batches

SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
WORDS = bytes(48 + (b not in SPACE) for b in range(256))
BEGINS = bytes(48 + (b & 0xC0 != 0x80) for b in range(256))
#: Marks of prefix, suffix and middle; a text that has one stays plain.
P, S, M = b"<P>", b"<S>", b"<M>"
SEED = "42"
#: Texts of which h3 % 100 is below RATE are cut; of those, with h4 % 100 below SPM the suffix comes first.
RATE, SPM = 50, 80


def bits(text: bytes, classes: bytes) -> int:
    """The bytes of a class as an integer, first byte highest."""
    return int(text.translate(classes), 2) if text else 0


def token_ends(text: bytes) -> int:
    """A bit for each byte that ends a token: white space and the word behind it, or white space at the end."""
    words = bits(text, WORDS)
    return words & ~(words << 1) | (1 if text and not words & 1 else 0)


def nth_end(ends: int, length: int, k: int) -> int:
    """How many of `length` bytes the first k marked ones take, the last of them included; 0 for k = 0."""
    begin = 0
    if not k:
        return 0
    while length > 1:
        low = length // 2
        high = ends >> low
        if (seen := high.bit_count()) >= k:
            ends, length = high, length - low
        else:
            ends, k, begin, length = ends & ((1 << low) - 1), k - seen, begin + length - low, low
    return begin + 1


def transformed_text(text: bytes, h: tuple[int, int, int, int]) -> tuple[int, str, int | None, int | None, bytes]:
    """n, form, characters of prefix and middle, and the output of one text."""
    ends, size = token_ends(text), len(text)
    n = ends.bit_count()
    if not text or P in text or S in text or M in text or h[2] % 100 >= RATE:
        return n, "plain", None, None, text
    first, second = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b = nth_end(ends, size, first), nth_end(ends, size, second)
    begins = bits(text, BEGINS)
    before = lambda cut: (begins >> (size - cut)).bit_count()
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    form, out = ("spm", S + suffix + P + prefix + M + middle) if h[3] % 100 < SPM else ("psm", P + prefix + S + suffix + M + middle)
    return n, form, before(a), before(b) - before(a), out


def draws(doc_id, seed: str = SEED) -> tuple[int, int, int, int]:
    """Four numbers of 32 bits from the seed and a document's id; a null id draws like an empty string."""
    whole = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(whole[i : i + 8], 16) for i in (0, 8, 16, 24))


def transformed(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output of every row; no shuffle, other columns aren't read.

    n counts tokens. Null texts are empty, and empty ones plain; null ids draw alike; repeated rows
    have equal results; texts of any length are taken whole; no rows give none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            made = [transformed_text(t or b"", draws(i, seed)) for i, t in zip(ids.to_pylist(), batch.column(1).to_pylist(), strict=True)]
            columns = [list(c) for c in zip(*made, strict=True)] or [[]] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    bounded_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output binary")
    return out.withColumn("output", F.col("output").cast("string"))


def restored(output: str = "output", form: str = "form") -> Column:
    """The text again, from an output and its form (columns). A text that is cut has no mark, so the first of each kind is the one set."""
    o = output
    at = {m: f"instr({o}, '{m.decode()}')" for m in (P, S, M)}
    last = f"substring({o}, {at[M]} + 3)"
    psm = f"concat(substring({o}, 4, {at[S]} - 4), {last}, substring({o}, {at[S]} + 3, {at[M]} - {at[S]} - 3))"
    spm = f"concat(substring({o}, {at[P]} + 3, {at[M]} - {at[P]} - 3), {last}, substring({o}, 4, {at[P]} - 4))"
    return F.expr(f"CASE {form} WHEN 'psm' THEN {psm} WHEN 'spm' THEN {spm} ELSE {o} END")


def digests(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """What transformed() tells, with digests of the output and of the text restored from it."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return transformed(docs, seed).select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored()).alias("restored_sha256"))


_TOKEN = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
ORACLE = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
t AS (
  SELECT *, regexp_extract_all(text, '{_TOKEN}') AS tokens, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
         ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4
  FROM d),
k AS (
  SELECT *, len(tokens) AS n, least(h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)) AS a, greatest(h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= {RATE} THEN 'plain'
              WHEN h4 % 100 < {SPM} THEN 'spm' ELSE 'psm' END AS form
  FROM t),
c AS (
  SELECT *, array_to_string(tokens[1:a], '') AS prefix, array_to_string(tokens[a + 1:b], '') AS middle, array_to_string(tokens[b + 1:], '') AS suffix FROM k)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM c
"""
