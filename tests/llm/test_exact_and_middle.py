"""Exact dedup and the fill-in-middle transformation against plain Python."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from weftline.llm import exact, middle

SCHEMA = "doc_id long, text string"
LOWER = str.maketrans(exact.UPPER, exact.LOWER)
CLASHING = ("sha", "row", "keep", "n", "big", "best", "whole", "kept", "a.b", "way", "one")


def clashing(df):
    return df.select("*", *[F.concat_ws("/", F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in CLASHING])


def decided(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(LOWER), []).append(i)
    best = lambda ids: max((i for i in ids if i is not None), default=None)
    return sorted(((i, best(g), len(g), hashlib.sha256(k.encode()).hexdigest()) for k, g in groups.items() for i in g), key=str), len(groups)


def held(spark, rows):
    df = clashing(spark.createDataFrame(rows, SCHEMA))
    got = exact.decisions(df).collect()
    expected, groups = decided(rows)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == expected
    kept = [r for r in got if r.kept]
    assert len(kept) == groups and all(r.doc_id == r.keep_id for r in kept)
    left = exact.without_copies(df)
    assert left.columns == df.columns
    rest = left.collect()
    assert sorted(((r.doc_id, (r.text or "").translate(LOWER)) for r in rest), key=str) == sorted(((r.doc_id, t) for r in kept for t in {(t or "").translate(LOWER) for i, t in rows if i == r.doc_id and hashlib.sha256((t or "").translate(LOWER).encode()).hexdigest() == r.text_sha256}), key=str)
    return got


def test_copies_large_and_small(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["Hot Text", "hot text", "HOT TEXT"])) for i in range(900)]
    rows += [(1000 + i, f"Ä {i // 2} straße İ") for i in range(600)] + [(2000, None), (2001, ""), (None, ""), (None, "alone"), (None, "ALONE"), (7, "x" * 300_000), (8, "X" * 300_000)]
    rows += [(1000, "Ä 0 straße İ"), (1000, "ä 0 straße İ"), (899, "hot text"), (899, "hot text")]
    held(spark, rows)


def test_all_rows_equal_and_empty_table(spark):
    held(spark, [(3, "a")] * 500)
    held(spark, [(None, None)] * 3)
    assert held(spark, []) == []


def test_frequent_digests_are_found(spark):
    """More different digests than counters, and one of a few in a hundred: it's among the candidates, and its count is exact."""
    df = spark.range(60_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 40 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("text")).repartition(16)
    found = exact.winners(exact.digests(df)).collect()
    assert [(r.n, r.keep.doc_id) for r in found] == [(1500, 59_960)]


def test_decisions_use_no_python_worker(spark):
    plan = exact.decisions(spark.createDataFrame([(1, "a")], SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plainly(doc_id, text):
    tokens = TOKEN.findall(text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(tokens)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
    if h4 % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts():
    rng = random.Random(11)
    alphabet = ["a", "b", " ", "\n", "\t", " ", "é", "漢", "😀", "<", "P", ">", "S", "\x0b", "\x1c", "M"]
    yield from ("", " ", "a", " a", "a ", "\n\n", "<P>", "x <S", "<P", "<S <M", "é" * 5)
    for _ in range(400):
        yield "".join(rng.choices(alphabet, k=rng.randint(1, 60)))
    yield " ".join("wörd" + "x" * rng.randint(0, 9) for _ in range(60_000))


def test_middle_against_tokens(spark):
    rows = [(i, t) for k, t in enumerate(texts()) for i in (k, k + 1_000_000_007)] + [(None, "a b c d"), (5, None), (5, None), (-3, "q w e r t y")]
    df = clashing(spark.createDataFrame(rows, SCHEMA).repartition(4))
    made = middle.transformed(df)
    got = made.select("*", middle.restored().alias("again")).collect()
    expected = sorted(((i, *plainly(i, t or "")) for i, t in rows), key=repr)
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got), key=repr) == expected
    assert sorted((r.again for r in got)) == sorted(t or "" for _, t in rows)
    assert {r.form for r in got} == {"plain", "spm", "psm"}
    assert middle.transformed(df.limit(0)).count() == 0


@pytest.mark.parametrize("length", [1, 2, 3, 64, 1000])
def test_nth_end(length):
    rng = random.Random(length)
    marks = [rng.random() < 0.3 for _ in range(length)]
    ends = int("".join("01"[m] for m in marks), 2)
    places = [i + 1 for i, m in enumerate(marks) if m]
    assert [middle.nth_end(ends, length, k) for k in range(len(places) + 1)] == [0, *places]
