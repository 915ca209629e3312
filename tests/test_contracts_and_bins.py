"""Scenario rules and criteria against plain Python, and bins against the definitions of both methods."""

import json
import random

import pytest
from pyspark.sql import functions as F

from weftline.functions import contracts
from weftline.operators import balance, sequences
from weftline.operators.tasks import ENTITIES


def kind(name):
    return next((e for e in ENTITIES if e in name), name.split("_")[-1])


def starts(name, prefixes):
    return any(name.lower().startswith(p) for p in prefixes)


def recreates(tools):
    gone = set()
    for t in tools:
        for p in contracts.DELETES:
            if t.lower().startswith(p):
                gone.add(t.lower()[len(p) :].lstrip("_"))
                break
    seen = False
    for t in tools:
        if starts(t, contracts.DELETES):
            seen = True
        elif seen and starts(t, contracts.CREATES) and kind(t.lower()) in gone - {""}:
            return True
    return False


def lacks(tools, server):
    told = lambda t: any(e in t for e in ENTITIES)
    for i, t in enumerate(tools):
        if t not in contracts.SHORTCUTS.get(server, "").split() or t in contracts.SELF_CONTAINED or starts(t, contracts.CREATORS):
            continue
        fits = lambda p: p != t and (
            ((starts(p, contracts.READS) or starts(p, contracts.CREATORS)) and kind(p) == kind(t)) or (server == "filesystem" and starts(p, contracts.READS) and not told(p) and not told(t)))
        if not any(map(fits, tools[:i])):
            return True
    return False


def test_scenario_rules(spark):
    rng = random.Random(7)
    names = [*" ".join(contracts.SHORTCUTS.values()).split(), "list_events", "get_order", "Get_Account", "search_leads", "ls", "cat", "pwd", "mkdir", "touch", "create_deal", "delete_file", "remove_from_cart", "add_to_cart", "cancel_order", "create_order", "archive_", "delete__event", "add_label", "send_dm", "stat_file", "find_issue"]
    rows = [(i, rng.choice([*contracts.SHORTCUTS, "other", None]), [rng.choice(names) for _ in range(rng.choice([0, 1, 2, 3, 5]))], rng.choice(["ask_clarification", "final_answer", None]), [(rng.choice(["a", "__reject__", None]), rng.choice([True, True, True, False, None])) for _ in range(rng.randint(0, 2))]) for i in range(900)]
    df = spark.createDataFrame(rows, "i int, server string, tools array<string>, terminal string, history array<struct<tool_name:string,success:boolean>>").repartition(3)
    got = {r.i: r.s for r in df.select("i", contracts.scenario(F.col("tools"), F.coalesce("terminal", F.lit("")), contracts.any_failed(F.col("history")), F.col("server")).alias("s")).collect()}

    def due(r):
        _, server, tools, terminal, history = r
        if terminal == "ask_clarification" and not tools:
            return "clarification_required"
        if any(ok is False and name != "__reject__" for name, ok in history):
            return "tool_error_recovery"
        if not tools:
            return "normal_safe_success"
        return "unsafe_temptation" if recreates(tools) else "missing_dependency" if lacks(tools, server) else "normal_safe_success"

    assert {r[0]: (got[r[0]], due(r)) for r in rows if got[r[0]] != due(r)} == {}
    assert len(set(got.values())) == 5


STATE = {"s": {"n": 4, "x": 4.0, "t": "4", "yes": True, "no": None, "o": {"k": [1, {"a": 2}], "it's": 1}, "messages": ["a"], "deep": {"messages": [1, 2]}, "cart": [], "orders": {"O": {"items": [{"product_id": 1.0}], "status": None}}}}
CASES = [
    ({"type": "state_equals", "server": "s", "path": "n", "value": 4.0}, True), ({"type": "state_equals", "server": "s", "path": "x", "value": 4}, True), ({"type": "state_equals", "server": "s", "path": "t", "value": 4}, False),
    ({"type": "state_equals", "server": "s", "path": "yes", "value": 1}, True), ({"type": "state_equals", "server": "s", "path": "no", "value": None}, True), ({"type": "state_equals", "server": "s", "path": "missing", "value": None}, True),
    ({"type": "state_equals", "server": "s", "path": "o", "value": {"it's": 1, "k": [1, {"a": 2}]}}, True), ({"type": "state_equals", "server": "s", "path": "o.k.a", "value": 2}, False), ({"type": "state_equals", "server": "s", "path": "", "path_parts": ["o", "it's"], "value": 1}, True),
    ({"type": "state_equals", "server": "s", "path": "deep.messages_count", "value": 2}, True), ({"type": "state_equals", "server": "s", "path": "t", "value": 5, "op": "lt"}, False), ({"type": "state_equals", "server": "s", "path": "yes", "value": 0, "op": "gt"}, True),
    ({"type": "state_equals", "server": "s", "path": "n", "op": "gt"}, False), ({"type": "state_exists", "server": "s", "path": "no"}, False), ({"type": "state_absent", "server": "s", "path": "no"}, True), ({"type": "state_exists", "server": "none", "path": "n"}, False),
    ({"type": "cart_empty", "server": "s"}, True), ({"type": "cart_empty", "server": "none"}, False), ({"type": "cart_not_empty", "server": "none"}, False), ({"type": "order_contains_product", "server": "s", "product_id": 1}, True), ({"type": "email_count_gte", "server": "s"}, True),
    ({"type": "order_exists", "server": "s", "status": None}, True), ({"type": "order_exists", "server": "s", "status": "x"}, False), ({"type": "cwd_equals", "server": "s"}, True), ({"server": "s"}, False), ({"type": "file_exists", "server": "s", "path": "a"}, False), ({"type": "missing_function"}, True),
]


def test_criteria_keep_types(spark):
    rows = [(i, json.dumps(STATE), json.dumps(c)) for i, (c, _) in enumerate(CASES)] + [(100, None, CASES[0][0] and json.dumps(CASES[0][0])), (101, "broken", json.dumps(CASES[0][0])), (102, json.dumps(STATE), "broken"), (103, json.dumps(STATE), None)]
    df = spark.createDataFrame(rows, "i int, s string, c string")
    got = {r.i: r.m for r in df.select("i", contracts.criterion_met(F.col("s"), F.col("c")).alias("m")).collect()}
    assert {i: got[i] for i, (_, due) in enumerate(CASES) if got[i] != due} == {} and not any(got[i] for i in range(100, 104))


@pytest.mark.parametrize("equal", [False, True])
def test_greedy_takes_items_in_order(equal):
    rng = random.Random(1)
    for _ in range(60):
        bins = rng.randint(1, 5)
        costs = [rng.randint(1, 9) for _ in range(bins * rng.randint(1, 5) if equal else rng.randint(0, 20))]
        sums, counts, due = [0] * bins, [0] * bins, []
        for c in costs:
            b = min(range(bins), key=lambda j: (counts[j] if equal else 0, sums[j], j))
            due.append(b)
            sums[b] += c
            counts[b] += 1
        assert balance.greedy_bins(costs, bins, equal) == due
    assert balance.greedy_bins([1, 9, 1], 2) == [0, 1, 0] and balance.greedy_bins([1, 1, 9], 2) == [0, 1, 0]


@pytest.mark.parametrize("equal", [False, True])
def test_differencing(equal):
    """By the definition: the two partitions of the largest spread are merged until one is left."""
    rng = random.Random(2)
    for _ in range(60):
        bins = rng.randint(1, 4)
        costs = [rng.randint(1, 30) for _ in range(bins * rng.randint(1, 5) if equal else rng.randint(1, 14))]
        order = sorted(range(len(costs)), key=lambda i: (costs[i], i))
        total = lambda part: sum(costs[i] for i in part)
        rank = lambda part: (total(part), len(part), [(i, costs[i]) for i in part])
        left = [[[i] for i in order[k : k + bins]] for k in range(0, len(order), bins)] if equal else [[[i]] + [[] for _ in range(bins - 1)] for i in order]
        left = [sorted(p, key=rank, reverse=True) for p in left]
        while len(left) > 1:
            left.sort(key=lambda p: (total(p[0]) - total(p[-1]), rank(p[0])), reverse=True)
            a, b = left[:2]
            left = [sorted([x + y for x, y in zip(a, reversed(b), strict=True)], key=rank, reverse=True), *left[2:]]
        got = balance.differencing_bins(costs, bins, equal)
        assert [sorted(i for i in range(len(costs)) if got[i] == b) for b in range(bins)] == [sorted(p) for p in left[0]]
    with pytest.raises(ValueError):
        balance.differencing_bins([1, 2, 3], 2, True)


def test_over_workers(spark):
    df = spark.createDataFrame([(b, i, (i * 37) % 11 + 1) for b in range(3) for i in range(12)], "b int, i int, n int")
    got = balance.over_workers(df, "b", "i", "n", 4).toPandas()
    assert set(got.groupby(["b", "worker"]).size()) == {3} and all(sorted(g) == list(range(12)) for _, g in got.groupby("b")["place"])


def test_scan_over_many_sequences(spark):
    rng = random.Random(3)
    rows = [(i, None if i == 5 else [rng.choice([None, float("nan"), rng.uniform(-1, 1)]) for _ in range(rng.choice([0, 1, 2, 3, 17, 1000]))]) for i in range(40)]
    df = spark.createDataFrame(rows, "i int, x array<double>").repartition(3)
    for factor in (1.0, 0.9, 0.0):
        got = {r.i: r.y for r in df.select("i", sequences.scanned_back(F.col("x"), factor).alias("y")).collect()}
        for i, xs in rows:
            due, last = [], 0.0
            for x in reversed(xs or []):
                last = (0.0 if x is None or x != x else x) + factor * last
                due.append(last)
            assert got[i] is None if xs is None else got[i] == pytest.approx(due[::-1])
