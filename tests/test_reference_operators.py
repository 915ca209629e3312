"""The operators against plain Python on small fixtures, invariants, and streams run to their end."""

import json
import math
import random
from statistics import mean, pstdev, stdev

import pytest
from pyspark.sql import functions as F

from weftline.functions import text as tx
from weftline.operators import advantages as adv
from weftline.operators import balance, batch, graph, metrics, relational, trajectories
from weftline.operators import sequences as seq
from weftline.sources import io
from weftline.streaming import queue


@pytest.fixture(scope="module")
def groups():
    rng = random.Random(1)
    rows, uid = [], 0
    for size in [1, 1, 2, 3, 5, 8, 4]:
        rows += [(uid, p, rng.choice([0.0, 1.0, rng.random()]), float(rng.randint(1, 9)), rng.choice("AB"), rng.choice("xy")) for p in range(size)]
        uid += 1
    return rows


@pytest.fixture(scope="module")
def frame(spark, groups):
    return spark.createDataFrame(groups, "uid long, pos int, score double, length double, level string, scenario string")


def by_key(df, *columns):
    return {(r.uid, r.pos): tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()}


def scores(groups, uid):
    return [r[2] for r in groups if r[0] == uid]


def test_estimators_with_single_rows(frame, groups):
    grpo, rloo, zero, floored = (by_key(d, "advantage") for d in (adv.grpo(frame), adv.rloo(frame), adv.rloo(frame, single="zero"), adv.grpo_floored(frame)))
    for uid, pos, s, *_ in groups:
        x = scores(groups, uid)
        if len(x) == 1:
            assert grpo[uid, pos] == pytest.approx(s / (1 + 1e-6)) and rloo[uid, pos] == s and zero[uid, pos] == 0
        else:
            assert grpo[uid, pos] == pytest.approx((s - mean(x)) / (stdev(x) + 1e-6), abs=1e-6)
            others = (sum(x) - s) / (len(x) - 1)
            assert rloo[uid, pos] == pytest.approx(s - others, abs=1e-9)
            assert floored[uid, pos] == pytest.approx((s - mean(x)) / (math.sqrt(max(stdev(x) ** 2, 1e-6)) + 1e-6), abs=1e-6)


def test_pass_at_k_and_opo(frame, groups):
    got, opo = by_key(adv.pass_at_k(frame), "advantage"), by_key(adv.opo(frame), "advantage")
    for uid in {r[0] for r in groups}:
        own = [r for r in groups if r[0] == uid]
        if len(own) > 1:
            best = max(own, key=lambda r: (r[2], -r[1]))
            assert sum(got[r[0], r[1]] != 0 for r in own) <= 1 and got[best[0], best[1]] >= 0
            base = sum(r[2] * r[3] for r in own) / sum(r[3] for r in own)
            assert all(opo[r[0], r[1]] == pytest.approx(r[2] - base) for r in own)
        else:
            assert got[own[0][0], own[0][1]] is None


def test_stratified_rules(frame, groups):
    got = by_key(adv.stratified(frame, beta=0.0), "advantage")
    z = lambda s, x: 0.0 if pstdev(x) < 1e-6 else (s - mean(x)) / pstdev(x)
    for uid, pos, s, _, level, scenario in groups:
        stratum = [r[2] for r in groups if (r[0], r[4], r[5]) == (uid, level, scenario)]
        same = [r[2] for r in groups if (r[0], r[5]) == (uid, scenario)]
        whole = scores(groups, uid)
        level_of = stratum if len(stratum) >= 2 else same if len(same) >= 2 else whole
        want = z(s, level_of) if len(level_of) >= 3 else s - mean(level_of)
        assert got[uid, pos] == pytest.approx(want, abs=1e-6)


def test_registry_refuses_a_second_estimator():
    with pytest.raises(ValueError):
        adv.register("grpo")(lambda df: df)


def test_returns_and_gae(spark, frame, groups):
    got = by_key(seq.reward_to_go(frame, gamma=0.9), "returns")
    for uid in {r[0] for r in groups}:
        x, acc = scores(groups, uid), 0.0
        for p in range(len(x) - 1, -1, -1):
            acc = x[p] + 0.9 * acc
            assert got[uid, p] == pytest.approx(acc)
    out = by_key(seq.gae(frame.select("uid", "pos", F.col("score").alias("reward"), (F.col("length") / 10).alias("value")), gamma=0.9, lam=0.8), "advantage", "returns")
    for uid in {r[0] for r in groups}:
        own, last, after = sorted(r for r in groups if r[0] == uid), 0.0, 0.0
        for r in reversed(own):
            v = r[3] / 10
            last = r[2] + 0.9 * after - v + 0.72 * last
            after = v
            assert out[uid, r[1]] == pytest.approx((last, last + v))


def test_masked_whiten_and_losses(spark, frame):
    df = frame.withColumn("mask", (F.col("pos") < 3).cast("double"))
    rows = seq.masked_whiten(df, "score", "mask").where("mask = 1").collect()
    assert mean(r.whitened for r in rows) == pytest.approx(0, abs=1e-9) and stdev(r.whitened for r in rows) == pytest.approx(1, abs=1e-4)
    with pytest.raises(ValueError):
        seq.aggregate_loss(df, "score", "mask", "no such mode")
    with pytest.raises(ValueError):
        seq.kl(F.lit(0.0), F.lit(0.0), "no such")


def test_batch_algebra_inverses(spark):
    df = batch.with_row_index(spark.range(37).select((F.col("id") * 7 % 37).alias("v")), "v")
    assert sorted((r.row_idx, r.v) for r in df.collect()) == [(i, i) for i in range(37)]
    padded = batch.pad_to_divisor(df, 37, 8)
    assert padded.count() == 40 and batch.same_rows(batch.unpad(padded, 40, 3), df)
    tiny = batch.pad_to_divisor(df.where("row_idx < 3"), 3, 8)
    assert [r.v for r in tiny.orderBy("row_idx").collect()] == [0, 1, 2, 0, 1, 2, 0, 1]
    assert [r.v for r in batch.repeat_rows(df, 2).orderBy("row_idx").collect()] == [i // 2 for i in range(74)]
    assert [r.v for r in batch.repeat_rows(df, 2, interleave=False, total=37).orderBy("row_idx").collect()] == [i % 37 for i in range(74)]
    perm = spark.createDataFrame([(i, (i * 5) % 37) for i in range(37)], "pos long, idx long")
    moved = batch.reorder(df, perm)
    assert batch.same_rows(batch.reorder(moved, batch.inverse(perm)).select("row_idx", "v"), df.select("row_idx", "v"))
    assert batch.concat(df, df).agg(F.max("row_idx")).first()[0] == 73
    with pytest.raises(ValueError):
        batch.chunk_of(37, 5)
    other = df.withColumn("v", F.when(F.col("row_idx") == 5, F.lit(-1).cast("bigint")).otherwise(F.col("v")))
    with pytest.raises(Exception, match="differs"):
        batch.zip_union(df, other).collect()
    assert [r.v for r in batch.take_slice(df, 3, 20, 5).orderBy("v").collect()] == [3, 8, 13, 18]


def test_metrics(spark):
    df = spark.createDataFrame([("a/max", 1.0), ("a/max", 3.0), ("min_b", 1.0), ("min_b", 3.0), ("minmax", 1.0), ("minmax", 3.0), ("c", 1.0), ("c", 2.0)], "key string, value double")
    assert {r.key: r.value for r in metrics.reduce_by_name(df).collect()} == {"a/max": 3, "min_b": 1, "minmax": 3, "c": 1.5}
    votes = spark.createDataFrame([(1, 0, "A", 0.9), (1, 1, "B", 0.8), (1, 2, "A", 0.7), (2, 0, "X", 1.0), (2, 1, "Y", 2.0)], "uid long, pos int, pred string, val double")
    assert {r.uid: r.val for r in metrics.majority(votes, ["uid"], "pred", "val", "pos").collect()} == {1: 0.9, 2: 1.0}
    x = [random.Random(3).randint(0, 50) for _ in range(301)]
    lengths = spark.createDataFrame([(v,) for v in x], "v int")
    got = metrics.index_percentile(lengths, "v", {"p50": 0.5, "p99": 0.99, "p0": 0.0}).first()
    assert tuple(got) == tuple(sorted(x)[max(0, min(300, int(301 * p) - 1))] for p in (0.5, 0.99, 0.0))
    boot = metrics.bootstrap_at_n(spark.createDataFrame([("s", 1, v) for v in (0.0, 1.0, 0.5, 0.2, 0.1)], "source string, uid long, score double")).collect()
    assert [r.n for r in boot] == [2, 4, 5] and all(0 <= r.worst <= r.best <= 1 for r in boot)


def test_greedy_dedup_equals_a_scan(spark):
    rng = random.Random(4)
    rows = [(i, "d" if i % 3 else "e", rng.sample("abcdefgh", rng.randint(0, 6))) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, block string, tokens array<string>")
    jac = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b)) if a and b else 0.0
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and jac(a[2], b[2]) >= 0.6}
    pairs = relational.jaccard_pairs(df, "id", "block", "tokens", 0.6)
    assert {(r.a, r.b) for r in pairs.collect()} == want
    kept: list = []
    for r in rows:
        if not any(k[1] == r[1] and jac(k[2], r[2]) >= 0.6 for k in kept):
            kept.append(r)
    assert sorted(r.id for r in relational.greedy_keep(df, "id", pairs).collect()) == [k[0] for k in kept]


def test_overlaps_and_split(spark):
    rng = random.Random(5)
    spans = [(i, s := rng.randint(0, 500), s + rng.randint(1, 90)) for i in range(80)]
    df = spark.createDataFrame(spans, "k long, s long, e long")
    got = {(r.k_a, r.k_b) for r in relational.overlapping(df, "s", "e", "k", 40.0).collect()}
    assert got == {(a[0], b[0]) for a in spans for b in spans if a[0] != b[0] and a[1] < b[2] and a[2] > b[1]}
    rows = spark.range(200).select("id", (F.col("id") % 7).alias("g")).unionByName(spark.createDataFrame([(999, 50)], "id long, g long"))
    split = relational.quota_split(rows, ["g"], "id", 0.2).collect()
    assert len(split) == 201 and {r.split for r in split if r.g == 50} == {"train"}
    assert all(sum(r.split == "val" for r in split if r.g == g) in (5, 6) for g in range(7))


def test_balance_covers_and_levels():
    rng = random.Random(6)
    costs = [float(rng.randint(1, 1000)) for _ in range(64)]
    loads = lambda items, bins: [sum(c for c, b in zip(items, bins, strict=True) if b == k) for k in range(4)]
    falling = sorted(costs, reverse=True)
    for items, bins in ((falling, balance.greedy_bins(falling, 4)), (costs, balance.differencing_bins(costs, 4))):
        found = loads(items, bins)
        assert len(bins) == 64 and max(found) - min(found) < 0.05 * max(found)
    # items in their own order: no bin is ahead by more than an item
    found = loads(costs, balance.greedy_bins(costs, 4))
    assert max(found) - min(found) <= max(costs)
    assert balance.differencing_bins([], 3) == [] and balance.differencing_bins([5.0], 3) == [0]


def test_text_functions(spark):
    def one(column):
        return spark.range(1).select(column.alias("x")).first().x

    assert one(tx.strip_think(F.lit("a<think>b</think>c<think>d"))) == "ac"
    assert one(tx.marked_answer(F.lit("#### 1 then #### 1,234"))) == "1234" and one(tx.marked_answer(F.lit("none"))) is None
    assert one(tx.marked_answer(F.lit("it is 7 . or 12."), "flexible")) == "12."
    assert one(tx.normal_answer(F.lit("The  Cat, an Apple a day!"))) == "cat apple day"
    assert one(tx.last_boxed(F.lit("\\boxed{1} and \\boxed{\\frac{a}{b}} x"))) == "\\frac{a}{b}" and one(tx.last_boxed(F.lit("\\boxed{1"))) is None and one(tx.last_boxed(F.lit("x"))) is None
    assert one(tx.answer_block(F.lit("<answer>a</answer><answer>\nb </answer>"))) in ("b", "\nb")
    assert one(tx.operation_of(F.lit("create_get"))) == "create" and one(tx.operation_of(F.lit("zap"))) == "query"
    assert one(tx.formatted_passages(F.array(F.lit("T\nbody"), F.lit("U")))) == "Doc 1 (Title: T)\nbody\n\nDoc 2 (Title: U)"
    assert one(tx.overlong_penalty(F.lit(9000), 8000, 2000, 1.0)) == -1.5 and one(tx.overlong_penalty(F.lit(10), 8000, 2000, 1.0)) == 0


def test_trajectories_and_graph(spark):
    names = F.array(*[F.lit(x) for x in ("b", "a", "x", "c")])
    got = spark.range(1).select(trajectories.cursor(names, ["a", "b", "c"]).alias("m"), trajectories.aligned(names, ["a", "b", "c"]).alias("h"), trajectories.order_violated(names, "a", "b").alias("v")).first()
    assert (got.m, got.h, got.v) == (1, 2, 1)
    edges = spark.createDataFrame([(1, 2, "explicit", 0), (2, 3, "explicit", 0), (3, 1, "explicit", 0), (1, 4, "implicit", 0), (1, 5, "implicit", 1), (1, 6, "implicit", 2)], "src long, dst long, relation string, pos int")
    paths = {tuple(r.path) for r in graph.simple_paths(edges).collect()}
    assert (1, 6) not in paths and (2, 3, 1, 5) in paths and all(len(set(p)) == len(p) <= 5 for p in paths)
    daily = spark.createDataFrame([(i, c) for i, c in enumerate([1.0, 0.0, 50.0])], "d int, c double")
    runs = daily.withColumn("run", F.lit("a"))
    assert [round(r.lam, 6) for r in trajectories.dual_ascent(runs, "run", "d", "c", lam=0.0, rate=0.1, budget=0.1).orderBy("d").collect()] == [0.09, 0.08, 3.0]
    # two dear batches freeze lambda at the first, a third doesn't raise it; cheap ones lower it, and it thaws below the streak
    costs = [0.9, 0.9, 0.9, 0.0, 0.2, 0.9]
    steps = spark.createDataFrame([("r", i, c) for i, c in enumerate(costs)], "run string, d int, c double")
    got = trajectories.dual_ascent(steps, "run", "d", "c", lam=1.0, rate=0.1, budget=0.1, stall_after=2).orderBy("d").collect()
    assert [(round(r.lam, 6), r.streak, r.frozen) for r in got] == [(1.08, 1, False), (1.08, 2, True), (1.08, 3, True), (1.07, 2, True), (1.08, 1, False), (1.08, 2, True)]


def test_sources_and_audit(spark, tmp_path):
    rolled = spark.createDataFrame([("i", "o 123", "g", 0.5, 7, "e")], "input string, output string, gts string, score double, step int, extra string")
    io.write_rollouts(rolled, str(tmp_path / "r"), ["extra"])
    assert io.read_rollouts(spark, str(tmp_path / "r" / "*"), mask=r"\d+").first().output == "o *"
    (tmp_path / "t.jsonl").write_text(json.dumps({"task_id": "t", "domain": "d", "scenario_type": "n", "user_query": "q", "oracle_calls": [{"tool_name": "a", "arguments": "{}", "action": "tool_call"}] * 2 + [{"tool_name": "f", "action": "final_answer"}]}) + "\n{broken\n")
    tasks = io.read_tasks(spark, str(tmp_path / "t.jsonl"))
    row = io.export_rows(tasks).first()
    assert row.reward_model.ground_truth.required_tools == ["a"] and json.loads(row.prompt)[0]["content"] == "q"
    errors = tasks.select(io.contract_error(F.col("oracle_calls"), F.col("scenario_type"), F.col("user_query")).alias("a"), io.contract_error(F.col("oracle_calls"), F.lit("irrelevant"), F.col("user_query")).alias("b"), io.contract_error(F.col("oracle_calls"), F.lit("n"), F.lit("in 2024-01")).alias("c")).first()
    assert tuple(errors) == (None, "unexpected_call", "stale_year")
    report = {r.check: (r.passed, r.failures) for r in io.audit(tasks, {"has id": F.col("task_id").isNotNull(), "no": F.lit(None).cast("boolean")}).collect()}
    assert report == {"has id": (True, 0), "no": (False, 1)}
    spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k long, v string").write.parquet(str(tmp_path / "s1"))
    assert [r.v for r in io.merge_shards(spark, str(tmp_path / "s*"), "k", "v", 2).collect()] == ["a", "c"]
    with pytest.raises(ValueError):
        io.merge_shards(spark, str(tmp_path / "s*"), "k", "v", 3)


def run_stream(spark, df, name):
    q = df.writeStream.outputMode("append").format("memory").queryName(name).start()
    try:
        q.processAllAvailable()
        return spark.table(name).collect()
    finally:
        q.stop()


def test_bounded_queue_and_dual_variable(spark, tmp_path):
    for k, rows in enumerate([[("q", 1, "a", 0), ("q", 2, "b", 0), ("q", 3, "c", 1)], [("q", 4, "d", 1)]]):
        spark.createDataFrame(rows, "queue string, seq long, payload string, param_version int").coalesce(1).write.mode("append").json(str(tmp_path / f"in{k}"))
    import shutil

    (tmp_path / "all").mkdir()
    for k in (0, 1):
        for f in (tmp_path / f"in{k}").glob("*.json"):
            shutil.copy(f, tmp_path / "all" / f"{k}.json")
    stream = spark.readStream.schema("queue string, seq long, payload string, param_version int").option("maxFilesPerTrigger", 1).json(str(tmp_path / "all"))
    got = sorted((r.event, r.payload, r.dropped) for r in run_stream(spark, queue.bounded_queue(stream, 2, release=1), "qs"))
    assert ("dropped", "a", 1) in got and ("taken", "b", 1) in got and len([g for g in got if g[0] == "taken"]) == 2
    assert queue.fresh(spark.createDataFrame([(1,), (5,)], "param_version int"), 6, 2).count() == 1
    assert queue.staleness_budget(4, 0.5, 2) == 12
    costs = spark.readStream.schema("queue string, seq long, payload string, param_version int").option("maxFilesPerTrigger", 1).json(str(tmp_path / "all")).select(F.lit("safety").alias("name"), F.lit(1.0).alias("cost"))
    assert [round(r.lam, 2) for r in sorted(run_stream(spark, queue.dual_variable(costs, lam=0.0, rate=0.1, budget=0.1), "duals"), key=lambda r: r.batch)] == [0.09, 0.18]


def test_entry_and_every_query_without_the_corpus_operators(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_answers_arrays_and_contracts(spark):
    from weftline.functions import answers, arrays, contracts

    def one(column):
        return spark.range(1).select(column.alias("x")).first().x

    assert one(answers.normal_final_answer(F.lit("x = \\frac12 inches"))) == "\\frac{1}{2}"
    assert one(answers.normal_final_answer(F.lit("the sum is $1,234$."))) == "1234"
    assert one(answers.normal_final_answer(F.lit("\\text{ab} \\sqrt2"))) == "ab\\sqrt{2}"
    assert tuple(one(answers.answer_score(F.lit("so\nAnswer: 12 km"), F.lit("12")))) == (1.0, True, "12")
    assert tuple(one(answers.answer_score(F.lit("none"), F.lit("12"))))[:2] == (-1.0, False)
    assert tuple(one(answers.answer_score(F.lit("\\boxed{7}"), F.lit("7"), strict_box=True))) == (1.0, True, "7")
    gold = F.array(F.lit("Cat"))
    assert one(answers.question_score(F.lit("<answer>the cat</answer>"), gold)) == 1.0 and one(answers.question_score(F.lit("cat"), gold)) == 0.0
    assert one(answers.question_score(F.lit("<answer>the cat</answer>" * 11), gold)) == 0.25
    assert one(answers.think_and_box(F.lit("<think>a</think> \\boxed{1}"))) == 1.0
    points = F.array(*[F.struct(F.lit(float(i)).alias("x"), F.lit(0.0).alias("y")) for i in range(4)])
    box = [F.lit(v) for v in (1.5, -1.0, 9.0, 1.0)]
    assert one(answers.point_reward(points, *box)) == pytest.approx(1 / math.sqrt(12)) and one(answers.point_reward(points, F.lit(8.0), *box[1:])) == -0.25
    acts = [one(answers.parsed_action(F.lit(x)))["action_type"] for x in ("", "<report_error> x </report_error><final_answer>y</final_answer>", '{"name": "f", "arguments": {}}', "a long enough text", "hm")]
    assert acts == ["unparseable", "report_error", "tool_call", "final_answer", "unparseable"]
    assert len(one(answers.json_lines(F.lit('{"a":1}\nno\n{"a":2}'), "a int"))) == 2
    ids = F.array(*[F.lit(i).cast("bigint") for i in (5, 6, 2, 7)])
    assert one(arrays.fitted(ids, 6, 0)) == [0, 0, 5, 6, 2, 7] and one(arrays.truncated(ids, 3, "middle")) == [5, 2, 7] and one(arrays.truncated(ids, 2, "left")) == [2, 7]
    assert one(arrays.response_mask(ids, 2)) == [1, 1, 1, 0] and one(arrays.response_mask(ids, 9)) == [1, 1, 1, 1]
    mask = F.array(*[F.lit(i) for i in (0, 0, 1, 1)])
    assert one(arrays.positions(mask)) == [0, 0, 0, 1] and one(arrays.without_padding(ids, mask)) == [2, 7]
    assert one(arrays.aligned_logprobs(F.array(F.lit(0.5)), 3)) == [0.5, -1.0, -1.0]
    assert one(arrays.entropy(F.array(F.lit(1.0), F.lit(1.0)))) == pytest.approx(math.log(2))
    kinds = [(k, v) for v, k in (("1", "integer"), ("1.5", "number"), ("1", "number"), ("true", "boolean"), ('"a"', "string"), ("[1]", "array"), ('{"a":1}', "object"), ("null", "null"))]
    assert all(one(contracts.type_matches(F.lit(v), F.lit(k))) for k, v in kinds) and not one(contracts.type_matches(F.lit("true"), F.lit("integer")))
    to_map = lambda d: F.from_json(F.lit(json.dumps(d)), "map<string,string>")
    errors = one(contracts.argument_errors(to_map({"a": "1", "z": "2"}), to_map({"a": "string", "b": "integer"}), F.array(F.lit("b")), F.create_map(F.lit("a"), F.array(F.lit("9")))))
    assert (errors.missing, errors.unexpected, errors.type_errors, errors.enum_errors) == (["b"], ["z"], ["a"], ["a"])
    state = F.lit('{"srv": {"a": {"n": 5, "s": "x"}}}')
    met = lambda kind, path, value=None, op="eq": one(contracts.criterion_met(state, F.lit(json.dumps({"type": kind, "server": "srv", "path": path, "value": value, "op": op}))))
    assert met("state_equals", "a.n", 5) and met("state_equals", "a.n", 4, "gt") and not met("state_equals", "a.s", "y") and met("state_absent", "a.q") and met("state_exists", "a.s")
    assert not met("state_equals", "a.n", "5") and not met("state_equals", "a.s", 4, "gt")
    case = lambda names, end="final_answer", bad=False: one(contracts.scenario(F.array(*[F.lit(n) for n in names]).cast("array<string>"), F.lit(end), F.lit(bad), F.lit("calendar")))
    assert case([], "ask_clarification") == "clarification_required" and case(["get_event"], bad=True) == "tool_error_recovery" and case([]) == "normal_safe_success"
    assert case(["get_event", "delete_event", "create_event"]) == "unsafe_temptation" and case(["update_event"]) == "missing_dependency" and case(["list_events", "update_event"]) == "normal_safe_success"
    assert one(contracts.group_id_parts(F.lit("t___hard"))).scenario == "normal_safe_success"
