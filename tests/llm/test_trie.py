"""The prefix trie against a trie built by brute force."""

import hashlib
import random
import re
import zlib

import pytest

from weftline.llm import trie

FIELDS = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
SCHEMA = "conv_id long, turn long, role string, text string"


def digest(role, text):
    return hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, digest(role or "", text or ""), (role or "", text or "")))
    own = {c: [x[-1] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(c - 20 * int(c / 20)) if c < 0 else c - c % 20
        built[c] = own.get(base, [])[:h] + turns[h:]
    nodes = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    words = lambda p: len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
    children = {p: [q for q in nodes if len(q) == len(p) + 1 and q[: len(p)] == p] for p in nodes}

    def below(p):
        return [p, *[x for q in children[p] for x in below(q)]]

    out = []
    for p, members in nodes.items():
        under = below(p)
        ends = ",".join(map(str, sorted(c for c in members if len(built[c]) == len(p))))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(children[p]), sum(not children[q] for q in under), sum((len(nodes[q]) - 1) * words(q) for q in under), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: __import__("pyspark").sql.functions.lit("x") for c in ("pos", "part", "depth", "owner", "first", "words")})
    return sorted(map(tuple, trie.nodes(df).select(*FIELDS).collect()), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed, monkeypatch):
    """Few different turns make deep, bushy tries; tiny partitions and blocks make every carry and search step happen."""
    if seed:
        monkeypatch.setattr(trie, "BLOCK", 3)
        monkeypatch.setattr(trie, "ROWS", 40)
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-30, 400), 60):
        for t in range(rng.choice([0, 1, 2, 3, 5, 9, 23])):
            rows.append((c, t if rng.random() < 0.9 else None, rng.choice(["user", "assistant", None]), rng.choice(["a b", "", None, "c"] if seed < 2 else ["same words"])))
    rows += rows[:7]
    assert found(spark, rows) == brute(rows)


def test_chains_on_chains(spark):
    """Each conversation leaves the one before it a turn later, so the chains hang on each other 40 levels deep."""
    rows = [(c * 20, t, "user", f"t{t}" if t <= 40 - c else f"own {c}") for c in range(40, -1, -1) for t in range(42)]
    assert found(spark, rows) == brute(rows)


def test_nulls_repeats_and_empty_tables(spark):
    assert found(spark, []) == []
    assert found(spark, [(None, 1, "user", "x")]) == []
    rows = [(7, 1, None, None), (7, 1, "", ""), (None, 0, "user", "lost"), (27, None, "user", "x"), (27, 0, "user", "y")]
    assert found(spark, rows) == brute(rows)
    # a conversation with no more turns than it leaves to an absent first one is a member of the root only
    short = next(c for c in range(21, 400) if zlib.crc32(str(c).encode()) % 4 == 3 and c % 20)
    rows = [(short, 1, "user", "x")]
    assert found(spark, rows) == brute(rows) and len(brute(rows)) == 1


def test_a_very_long_conversation_and_a_hot_node(spark, monkeypatch):
    monkeypatch.setattr(trie, "ROWS", 300)
    rows = [(0, t, "user", f"t {t}") for t in range(1500)] + [(20, t, "user", f"t {t}") for t in range(1400)] + [(40 + 20 * c, 0, "user", "t 0") for c in range(700)]
    got = {(r[0], r[1]): r for r in found(spark, rows)}
    assert len(got) == 1501
    ends = ",".join(str(40 + 20 * c) for c in range(700))
    assert got[0, 1][7] == hashlib.sha256(ends.encode()).hexdigest() and got[0, 1][3] == 702
    assert got[0, 1400][7] == hashlib.sha256(b"20").hexdigest()
    assert got[0, 0][5] == 1 and got[0, 0][6] == 2 * 701 + 2 * 1399
