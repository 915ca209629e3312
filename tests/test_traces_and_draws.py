"""Call traces against the sequential scan; draws with replacement against their distribution and against themselves."""

import hashlib
import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from weftline.operators import draws, traces

TASKS = "k long, domain string, query string, scenario string, calls array<struct<action:string,tool_name:string,arguments:string>>, original array<struct<action:string,tool_name:string,arguments:string>>"


def made_tasks():
    rng = random.Random(12)
    args = lambda: rng.choice(['{"a": 1}', '{"a": "1", "b": [1, {"c": "x y, z: \\"q\\""}]}', '{"b": null, "a": true}', "{}", None, "broken", '{"é": "ü"}'])
    rows = []
    for k in range(300):
        calls = [(rng.choice(["tool_call", None, "tool_call", "tool_call", "final_answer"]), rng.choice(["get", "set", None]), args()) for _ in range(rng.choice([0, 1, 1, 2, 3, 6]))]
        if k and rng.random() < 0.5 and rows[-1][4]:
            calls = rows[rng.randrange(len(rows))][4] or calls
            if calls and rng.random() < 0.5:
                calls = [*calls[:-1], ("tool_call", "get", args())]
        rows.append((k, rng.choice(["x", "y", None]), " Do  It\n now ", "normal", None if rng.random() < 0.05 else calls, rng.choice([None, [("tool_call", "old", '{"z": 2}')]])))
    rows += [(1000 + i, "x", "q", "s", [("tool_call", "hot", '{"id": 7}')] * 4, None) for i in range(200)]
    return rows


def signature(calls, original):
    used = [c for c in calls or [] if (c[0] or "tool_call") == "tool_call"] or [c for c in original or [] if (c[0] or "tool_call") == "tool_call"]
    out = []
    for i, (_, tool, a) in enumerate(used):
        try:
            a = json.loads(a or "null")
        except ValueError:
            a = None
        pairs = {f"{k}={v if isinstance(v, str) else json.dumps(v, sort_keys=True, ensure_ascii=False, separators=(',', ':'))}" for k, v in (a or {}).items()}
        out.append((i, tool or "", frozenset(pairs)))
    return set(out)


def test_greedy_scan(spark):
    rows = made_tasks()
    kept = []
    for k, domain, _, _, calls, original in rows:
        own = signature(calls, original)
        if not any(d == domain and own and len(own & s) >= 0.7 * len(own | s) for _, d, s in kept):
            kept.append((k, domain, own))
    df = spark.createDataFrame(rows, TASKS).withColumn("signature", traces.signatures(F.col("calls"), F.col("original")))
    got = traces.without_similar(df, "k", "domain", "signature")
    assert got.columns == df.columns and sorted(r.k for r in got.collect()) == sorted(k for k, _, _ in kept)
    assert traces.without_similar(df.limit(0), "k", "domain", "signature").count() == 0


def test_fingerprints_are_those_of_json(spark):
    rows = [r for r in made_tasks() if all(c[2] != "broken" and c[2] for c in r[4] or [])]

    def due(r):
        calls = [{"tool_name": c[1] or "", "arguments": json.loads(c[2])} for c in r[4] or [] if (c[0] or "tool_call") == "tool_call"]
        payload = {"domain": r[1] or "", "scenario": r[3], "query": " ".join(r[2].lower().split()), "calls": calls}
        return hashlib.sha256(json.dumps(payload, sort_keys=True, ensure_ascii=False).encode()).hexdigest()

    df = spark.createDataFrame(rows, TASKS).withColumn("identity", traces.fingerprint(F.col("domain"), F.col("scenario"), F.col("query"), F.col("calls")))
    assert {r.k: r.identity for r in df.collect()} == {r[0]: due(r) for r in rows}
    counted = Counter(due(r) for r in rows)
    assert {r.identity: r.tasks for r in traces.audited(df, "k", "identity").collect()} == counted


def test_drawn_rows_stay_with_their_block(spark):
    """the counts of a block meet its rows where these lie: no join by keys, nor a sort of all rows by them."""
    df = spark.range(5000).select(F.col("id").alias("i"), (F.col("id") % 7).cast("double").alias("w"), F.lit("x").alias("s"))
    got = draws.multinomial(df, "w", ["i", "s"], 5)
    assert got.columns == ["i", "w", "s", "copies"] and sum(r.copies for r in got.collect()) == 5000
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("Join") == 1 and "_name" not in plan


def test_multinomial(spark, monkeypatch):
    monkeypatch.setattr(draws, "BLOCK_ROWS", 20)
    monkeypatch.setattr(draws, "FAN", 4)
    rows = [(i, "a" if i % 2 else "b", float([0, 1, 2, 5][i % 4])) for i in range(800)] + [(900, None, None), (901, None, -3.0)]
    df = spark.createDataFrame(rows, "i long, s string, w double")
    one = draws.multinomial(df.repartition(7), "w", ["i"], 5, 40_000)
    got = {r.i: r.copies for r in one.collect()}
    again = {r.i: r.copies for r in draws.multinomial(df.orderBy(F.desc("s"), "w").repartition(2), "w", ["i"], 5, 40_000).collect()}
    other = {r.i: r.copies for r in draws.multinomial(df, "w", ["i"], 6, 40_000).collect()}
    assert sum(got.values()) == 40_000 == sum(other.values()) and got == again != other
    total = sum(max(r[2] or 0, 0) for r in rows)
    chi = sum((got.get(r[0], 0) - 40_000 * r[2] / total) ** 2 / (40_000 * r[2] / total) for r in rows if (r[2] or 0) > 0)
    assert 460 < chi < 760  # 599 degrees of freedom
    assert not {900, 901} & set(got) and sum(draws.multinomial(df, "w", ["i"], 1).select("copies").toPandas()["copies"]) == 802
    assert draws.multinomial(df.limit(0), "w", ["i"], 1).count() == 0
    repeated = draws.multinomial(df.unionByName(df), "w", ["s"], 3, 5000)
    assert repeated.agg(F.sum("copies")).first()[0] == 5000 and repeated.columns == [*df.columns, "copies"]


def by_hand(rows, resamples, seed=42):
    groups = {}
    for u, x, p, o in rows:
        if u is not None and x is not None:
            groups.setdefault(u, []).append((o, x, "" if p is None else f"p{p}"))
    out = {}
    for u, s in groups.items():
        s.sort()
        sizes, n = [], 2
        while n < len(s):
            sizes.append(n)
            n *= 2
        for n in [*sizes, len(s)] if len(s) > 1 else []:
            found = []
            for r in range(1, resamples + 1):
                drawn = [s[int(int(hashlib.md5(f"{seed}:{u}:{n}:{r}:{i}".encode()).hexdigest()[:13], 16) / 2**52 * len(s))] for i in range(n)]
                votes = Counter(d[2] for d in drawn)
                top = max(votes, key=votes.get)
                found.append((max(d[1] for d in drawn), min(d[1] for d in drawn), next(d[1] for d in drawn if d[2] == top)))
            mean = [sum(f[c] for f in found) / resamples for c in range(3)]
            std = [(sum((f[c] - mean[c]) ** 2 for f in found) / resamples) ** 0.5 for c in range(3)]
            out[u, n] = (mean[0], std[0], mean[1], std[1], mean[2], std[2])
    return out


@pytest.mark.parametrize("most", [4096, 3])
def test_bootstrap(spark, monkeypatch, most):
    """From arrays and from joined draws the same."""
    monkeypatch.setattr(draws, "ARRAY_SAMPLES", most)
    rng = random.Random(3)
    rows = [(u, rng.choice([rng.random(), None]), rng.choice(["a", "b", None]), i) for u in range(6) for i in range([1, 2, 3, 5, 9, 12][u])] + [(None, 1.0, "a", 0)]
    df = spark.createDataFrame(rows, "u long, x double, p string, o long").repartition(3)
    got = {(r.u, r.n): tuple(r)[2:] for r in draws.bootstrap(df, "u", "x", "p", "o", resamples=40).collect()}
    due = by_hand(rows, 40)
    assert set(got) == set(due) and all(got[k] == pytest.approx(due[k]) for k in due)
    assert draws.bootstrap(df.limit(0), "u", "x", "p", "o").count() == 0
