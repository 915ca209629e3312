"""Verdicts, rewards and splits against values worked out by hand from their rules."""

import pytest
from pyspark.sql import functions as F

from weftline.functions import jsons
from weftline.functions import text as tx
from weftline.operators import advantages, balance, entities, retrieval, splits, tasks, verdicts
from weftline.operators.balance import differencing_bins, greedy_bins

EVENT = (
    "session long, step int, event_id long, action_type string, tool_name string, arguments map<string,string>, operation string, target_id string, created_ids array<string>, "
    "deleted_ids array<string>, changed_fields array<string>, duplicate_of string, identity_violation string, forbidden_transition string, observation string, execution_success boolean, schema_valid boolean"
)
TASK = (
    "session long, required array<struct<tool_name:string,arguments:map<string,string>>>, required_names array<string>, target_ids array<string>, protected array<string>, protected_fields array<string>, "
    "protected_by_resource map<string,array<string>>, identity_policy string, allowed_terminals array<string>, user_query string, criteria array<struct<type:string,path:string,value:string>>, final_state map<string,string>"
)


def event(session, step, tool, operation, target="", args=None, made=(), gone=(), changed=(), seen=None, ok=True, fits=True, dup="", ident="", bad=""):
    end = tool in verdicts.TERMINALS
    return (session, step, 100 * session + step, tool if end else "tool_call", "" if end else tool, args or {}, operation, target, list(made), list(gone), list(changed), dup, ident, bad, seen, ok, fits)


def task(session, required=(), targets=(), protected=(), fields=(), by=None, policy="", query="", criteria=(), state=None, ends=("final_answer",)):
    return (session, [(t, a) for t, a in required], [t for t, _ in required], list(targets), list(protected), list(fields), by or {}, policy, list(ends), query, [tuple(c) for c in criteria], state)


@pytest.fixture(scope="module")
def logs(spark):
    required = [("list_events", {"date_range": "today"}), ("get_event", {"event_id": "e1"})]
    events = [
        # 1: the oracle itself
        event(1, 0, "list_events", "query", args={"date_range": "today"}), event(1, 1, "get_event", "query", "e1", {"event_id": "E1 "}), event(1, 2, "final_answer", "terminal"),
        # 2: the wrong resource, in the wrong order
        event(2, 0, "get_event", "query", "e1", {"event_id": "e1"}), event(2, 1, "update_event", "update", "e9", {"event_id": "e9"}), event(2, 2, "list_events", "query", args={"date_range": "today"}), event(2, 3, "final_answer", "terminal"),
        # 3: creates and deletes one thing, repeats an update, loses protected fields, and a secret from nowhere
        event(3, 0, "create_event", "create", "n1", {"title": "x"}, made=["n1"]), event(3, 1, "delete_event", "delete", "n1", {"event_id": "n1"}, gone=["n1"]), event(3, 2, "update_event", "update", "e1", {"b": "2", "a": "1"}, changed=["title"]),
        event(3, 3, "update_event", "update", "e1", {"a": "1", "b": "2"}, changed=["owner"]), event(3, 4, "login", "query", args={"Api_Token": "s3cret"}, seen="key k77"), event(3, 5, "login", "query", args={"api_token": "k77"}),
        # 4: no tools are due
        event(4, 0, "final_answer", "terminal"),
        # 5: no tools are due, but one is called; identity breaks
        event(5, 0, "get_event", "query", ident="owner"), event(5, 1, "final_answer", "terminal"),
        # 6: fails, ends badly
        event(6, 0, "list_events", "query", args={"date_range": "x"}, ok=False, fits=False), event(6, 1, "get_event", "query", "e1", {"event_id": "e1"}, bad="skip"),
    ]
    work = [
        task(1, required, targets=["e1"]), task(2, required, targets=["e1"]), task(3, fields=["owner"], by={"e1": ["title"]}, query="nothing"), task(4), task(5, policy="preserve"),
        task(6, required, policy="preserve", criteria=[("state_exists", "events.e1", None), ("state_absent", "events.e2", None), ("state_equals", "events.e3.status", "done"), ("other", "x", None)], state={"events.e3.status": "done"}),
        task(7, required),
    ]
    return spark.createDataFrame(events, EVENT), spark.createDataFrame(work, TASK)


def test_safety(logs):
    got = {r.session: r for r in verdicts.safety_verdicts(*logs).collect()}
    flags = {s: {v: r[v] for v in verdicts.VIOLATIONS if r[v]} for s, r in got.items()}
    assert flags[1] == {} and got[1].c_safety == 0 and flags[4] == {}
    assert flags[2] == {"wrong_resource": 1, "ordering": 1} and got[2].c_safety == 1
    assert flags[3] == {"forbidden_transition": 1, "duplicate_effect": 1, "protected_loss": 2, "sensitive_provenance": 1}
    assert flags[5] == {"identity_violation": 1} and flags[6] == {"forbidden_transition": 1}  # the order goes by names, failed calls too


def test_task_reward(logs):
    got = {r.session: r for r in verdicts.task_rewards(*logs).collect()}
    assert got[1].r_task == pytest.approx(1.0) and got[1].r_coverage == 1.0 and got[1].r_arg == 1.0
    # get_event comes first, so list_events alone is aligned after it: 1 of 2 calls and the end, of 3; 2 of 3 names
    r = got[2]
    assert (r.r_validity, r.r_coverage, round(r.r_name, 6), r.aligned) == (1.0, pytest.approx(2 / 3), 0.666667, 1)
    assert r.r_task == pytest.approx((0.5 + 0.5 * 2 / 3 + 0.2 * 2 / 3 + 0.1) / 1.3)
    assert got[4].r_task == 1.0 and got[5].r_task == 0.0
    # half of the calls fail and the end isn't allowed: validity (0.6 / 2 + 0.4 / 2) / 2; one aligned call and three criteria of seven
    r = got[6]
    assert r.r_validity == pytest.approx(0.25) and r.r_coverage == pytest.approx(4 / 7) and r.r_name == 1.0 and r.r_arg == 1.0
    scores = {r.session: r for r in verdicts.oval_scores(*logs, lam=2.0, shape=0.5, process=0.3).collect()}
    assert scores[7].score == 0 and scores[2].c_safety == 1 and scores[2].score == pytest.approx(got[2].r_task + 0.5 * scores[2].f_gamma + 0.3 * scores[2].p_process - 2.0)
    steps = {r.session: r for r in verdicts.process_scores(logs[0]).collect()}
    # 6: -0.05 -0.05 for the first call; the second resolves (0.05) but its forbidden transition leaves -0.08 at best
    assert steps[6].p_process == pytest.approx(-0.18) and steps[1].p_process == pytest.approx(0.05) and steps[6].forbidden_steps == 1
    shaped = {r.session: r for r in verdicts.shaping(logs[0], 0.5).collect()}
    assert shaped[1].phi_final == pytest.approx(0.6) and shaped[1].f_gamma == pytest.approx(0.6 * 0.5**3)
    old = {r.session: r for r in verdicts.legacy_rewards(*logs).collect()}
    assert old[1].coverage == 1.0 and old[1].efficiency == 1.0 and old[1].argument == pytest.approx(0.5) and old[6].validity == pytest.approx((0.33 + 1.0) / 2)


def test_stratified_fallback(spark):
    # two rows of different levels fall back to a scenario of two rows: centred, not divided; the group's term is divided
    rows = [("g", "a", "s", 0.0), ("g", "b", "s", 1.0), ("h", "a", "s", 1.0), ("h", "b", "s", 2.0), ("h", "c", "s", 6.0), ("i", "a", "s", 5.0)]
    df = spark.createDataFrame(rows, "uid string, level string, scenario string, score double")
    got = {(r.uid, r.level): r.advantage for r in advantages.stratified(df).collect()}
    assert (got["g", "a"], got["g", "b"]) == (pytest.approx(-0.75), pytest.approx(0.75)) and got["i", "a"] == 0
    z = (1 - 3) / (14 / 3) ** 0.5
    assert got["h", "a"] == pytest.approx(1.25 * z)
    plain = {(r.uid, r.level): r.advantage for r in advantages.stratified(df, by_std=False).collect()}
    assert plain["h", "a"] == pytest.approx(-2 * 1.25)


def test_exact_splits(spark):
    cells = {("d0", "s0"): 6, ("d0", "s1"): 6, ("d1", "s0"): 6, ("d1", "s1"): 6}
    train, val = splits.split_quotas(cells, 16, 8)
    assert sum(train.values()) == 16 and sum(val.values()) == 8 and all(train[k] + val[k] <= n for k, n in cells.items())
    train, val = splits.split_quotas({("d0", "big"): 40, ("d1", "big"): 40, ("d0", "small"): 10, ("d1", "small"): 10}, 80, 20)
    by = {s: sum(n for (_, t), n in val.items() if t == s) for s in ("big", "small")}
    assert by == {"big": 16, "small": 4}
    train, val = splits.split_quotas({("d0", "s"): 9, ("d1", "s"): 9, ("d0", "lone"): 1}, 12, 6)
    assert ("d0", "lone") not in val and sum(val.values()) == 6 and sum(train.values()) == 12
    assert splits.split_quotas(cells, 24, 0) == (cells, dict.fromkeys(cells, 0))
    train, val = splits.split_quotas({("d0", "a"): 1, ("d1", "b"): 1, ("d2", "c"): 4}, 3, 3)
    assert sum(train.values()) == 3 and sum(val.values()) == 3
    with pytest.raises(ValueError):
        splits.split_quotas(cells, 20, 8)
    df = spark.createDataFrame([(i, f"d{i % 3}", f"s{i % 2}") for i in range(60)] + [(99, None, None)] * 1, "k long, d string, s string")
    out = splits.exact_split(df, "d", "s", "k", 40, 12).collect()
    assert sum(r.split == "val" for r in out) == 12 and sum(r.split == "train" for r in out) == 40 and len({r.k for r in out}) == 52
    assert {r.d for r in out if r.split == "val"} == {"d0", "d1", "d2"} and splits.even_targets(["a", "b", "c"], 8) == {"a": 3, "b": 3, "c": 2}
    for total in range(0, 31):
        quotas = splits.apportion({"a": 10, "b": 1, "c": 19}, total)
        assert sum(quotas.values()) == total and all(quotas[k] <= n for k, n in {"a": 10, "b": 1, "c": 19}.items())


def test_balanced_bins(spark):
    costs = [8.0, 7.0, 6.0, 5.0, 4.0]
    sums = lambda bins: sorted(sum(c for c, b in zip(costs, bins, strict=True) if b == k) for k in range(2))
    assert sums(differencing_bins(costs, 2)) == [14.0, 16.0] and sums(greedy_bins(costs, 2)) == [13.0, 17.0]
    df = spark.createDataFrame([(b, i, float(i % 7 + 1)) for b in range(3) for i in range(40)], "batch int, k int, cost double")
    for method in ("differencing", "greedy"):
        got = balance.balanced(df, "batch", "k", "cost", 4, method).groupBy("batch", "bin").agg(F.sum("cost").alias("c")).collect()
        for b in range(3):
            loads = [r.c for r in got if r.batch == b]
            assert len(loads) == 4 and max(loads) - min(loads) <= 7
    micro = balance.micro_batches(df.withColumn("n", F.col("cost").cast("int")), "batch", "k", "n", 40)
    assert micro.count() == 120 and micro.groupBy("batch").agg(F.countDistinct("micro").alias("m")).where("m <> 4").count() == 0


def test_nearest_blocks(spark):
    rows = [(i, [float((i * 7) % 5), float(i % 3), 1.0]) for i in range(40)] + [(90, None), (91, [0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in retrieval.nearest(df, df.where("vec_id % 20 = 0"), "vec_id", "embedding", 3, rows=7).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))

    def cosine(a, b):
        n = lambda x: sum(v * v for v in x) ** 0.5 or 1.0
        return round(sum(x * y for x, y in zip(a, b, strict=True)) / n(a) / n(b), 12)

    vectors = {i: v for i, v in rows if v}
    for q in (0, 20):
        want = sorted((i for i in vectors if i != q), key=lambda i: (-cosine(vectors[q], vectors[i]), i))[:3]
        assert [i for _, i in sorted(got[q])] == want


def test_mutations_by_windows(spark):
    state = spark.createDataFrame([(1, 5.0), (2, 6.0)], "id long, value double")
    log = [(1, 1, "insert", 9.0), (1, 2, "delete", None), (1, 3, "delete", None), (1, 4, "insert", 7.0), (1, 5, "update", 8.0), (3, 1, "update", 1.0), (3, 2, "insert", 2.0), (3, 3, "wipe", 3.0), (3, 4, None, 3.0)]
    got = {r.id: r for r in entities.apply_mutations(state, spark.createDataFrame(log, "id long, seq long, op string, value double")).collect()}
    assert [o.error for o in got[1].outcomes] == ["already_exists", None, "not_found", None, None] and (got[1].value, got[1].alive) == (8.0, True)
    assert [o.error for o in got[3].outcomes] == ["not_found", None, "unknown_op", "unknown_op"] and got[3].value == 2.0 and got[3].alive
    assert (got[2].value, got[2].alive, got[2].outcomes) == (6.0, True, [])


def test_loose_values(spark):
    t = "say {\"a\": [1, 2]} now"
    assert jsons.first_json(t) == '{"a":[1,2]}' and jsons.first_json("a\n\n[1, {\"b\": \"}\"}]\n\nz") == '[1,{"b":"}"}]' and jsons.first_json("no {json") is None and jsons.first_json(None) is None
    assert jsons.repaired('x {"a": [1') == '{"a": [1}]' and jsons.tool_calls('<tool_call>{"name": "f", "arguments": {"q": "a b"</tool_call>!<tool_call>none</tool_call>')[0] == ['{"arguments":{"q":"a b"},"name":"f"}']
    pairs = [("500", "500.0", True), ("true", " TRUE", True), ('{"a":1,"b":[2]}', '{"b": [2], "a": 1}', True), ("[1]", "[2]", False), (" Ab", "aB ", True), (None, "x", None), ("nan", "nan", False)]
    df = spark.createDataFrame([(a, b) for a, b, _ in pairs], "a string, b string")
    assert [r[0] for r in df.select(jsons.args_equal(F.col("a"), F.col("b"))).collect()] == [w for *_, w in pairs]
    import hashlib
    import json

    states = ['{"b": 1.5, "a": {"z": null, "é": [true]}}', None, "{broken"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in states], "s string").select(jsons.state_hash(F.col("s"))).collect()]
    assert got == [hashlib.sha256(json.dumps(json.loads(states[0]), sort_keys=True).encode()).hexdigest()[:16], "", ""]
    messages = spark.createDataFrame([(None,), ("[]",), ('{"role": "user", "content": "x"}',), ("plain",)], "p string").select(F.size(jsons.prompt_messages(F.col("p")))).collect()
    assert [r[0] for r in messages] == [0, 0, 1, 1]


def test_fuzzy_and_passages(spark):
    valid = spark.createDataFrame([("list_events",), ("get_event",), ("send_email_now",)], "tool string")
    names = spark.createDataFrame([("LIST_EVENTS",), ("get_events",), ("event",), ("now_email_please",), ("zzz",)], "raw string")
    got = {r.raw: r.tool for r in tasks.fuzzy_matches(names, valid).collect()}
    assert got == {"LIST_EVENTS": "list_events", "get_events": "get_event", "event": "get_event", "now_email_please": "send_email_now"}
    out = spark.range(1).select(tx.formatted_passages(F.array(F.lit("T1\nbody\nmore"), F.lit("T2"))).alias("p")).first().p
    assert out == "Doc 1 (Title: T1)\nbody\nmore\n\nDoc 2 (Title: T2)"
