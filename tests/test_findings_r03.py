"""Work that grows no faster than the input, and equal results where a step was replaced."""

import random
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Row
from pyspark.sql import functions as F

from weftline.llm import repeats
from weftline.operators import draws, normalise, relational, retrieval, sequences, tasks, verdicts
from weftline.plans import estimator_queries, trajectory_log
from weftline.plans import samples as made
from weftline.sources import generated
from weftline.streaming import audit, queue


def test_targets_meet_only_criteria_that_name_them(spark):
    """no join of all criteria of a task with all its targets, and ids that only some texts can be cast to."""
    state = spark.createDataFrame([(1, "c", str(i), f, "v") for i in range(6) for f in ("status", "owner_id", "5")], "task long, container string, entity string, field string, value string")
    targets = state.select("task", F.col("entity").alias("id")).where("cast(id as bigint) % 2 = 1").distinct()
    criteria = spark.createDataFrame([(1, "c.1.status"), (1, "c.3.x.status"), (1, "c.5.5"), (1, "c.5"), (2, "c.1.5"), (1, None)], "task long, path string")
    got = tasks.protected_fields(state, targets, criteria)
    assert {(r.entity, r.field) for r in got.collect()} == {("5", "status"), ("1", "5"), ("3", "5"), ("5", "5")}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "array_contains" not in plan


def test_pairs_of_sets_of_frequent_tokens(spark, monkeypatch):
    """where every token is frequent, sets of a few tokens meet by all tokens that they must share."""
    rng = random.Random(9)
    rows = [(i, "b", [f"{p}:{rng.randrange(3)}" for p in range(rng.choice([1, 2, 3, 4, 5, 6, 7, 9, 12, 20]))]) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, block string, tokens array<string>")
    sets = [(i, set(t)) for i, _, t in rows]
    want = {(i, j) for (i, a), (j, b) in combinations(sets, 2) if len(a & b) >= 0.7 * len(a | b)}
    assert {(r.a, r.b) for r in relational.jaccard_pairs(df, "id", "block", "tokens", 0.7).collect()} == want
    assert relational.shared_picks(6, 6, 0.7) == relational.least_overlap(6, 6, 0.7) == 5
    monkeypatch.setattr(relational, "KEYS", 12)
    assert {(r.a, r.b) for r in relational.jaccard_pairs(df, "id", "block", "tokens", 0.7).collect()} == want


def test_many_draws_at_once(spark):
    """a group's draws are taken in arrays, whatever its size, with the places of the column expression."""
    cases = [("13", 1500, range(8, 104), 1700), ("x" * 60, 5, range(1, 3), 9), ("-7", 2, range(999, 1002), 3)]
    for name, size, resamples, n in cases:
        got = draws.drawn_places(name, size, resamples, n, 42)
        place = draws.drawn_index(F.lit(name), F.lit(size), F.col("r"), F.col("i"), F.lit(n), 42)
        df = spark.range(resamples.start, resamples.stop).withColumnRenamed("id", "r").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
        assert [r[0] for r in df.orderBy("r", "i").select(place).collect()] == got.ravel().tolist()
    rows = [(k % 2, float(k % 97), "abc"[k % 3], k) for k in range(10_000)]
    df = spark.createDataFrame(rows, "u long, x double, p string, o long")
    got = draws.bootstrap(df, "u", "x", "p", "o", resamples=3)
    assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString() and got.count() == 2 * 13


def test_bootstrap_knows_nan(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1, nan, "a", 0), (1, nan, "a", 1), (2, 1.0, "a", 0), (2, nan, "b", 1), (2, 3.0, "b", 2)], "u long, x double, p string, o long")
    got = {(r.u, r.n): r for r in draws.bootstrap(df, "u", "x", "p", "o", resamples=50).collect()}
    assert set(got) == {(1, 2), (2, 2), (2, 3)} and str(got[1, 2].worst) == "nan" and str(got[2, 3].best) == "nan"


def test_states_are_opened_in_one_pass(spark):
    """the table is read once, however deep the states may be."""
    rows = [(1, '{"a":1,"b":{"c":[1,2,{}],"d":null},"e":[]}', '{"a":2,"b":{"c":[1,3,{"x":1.50}],"d":0},"e":{}}'), (2, None, '{"a":[[],[1]]}'), (3, "broken", "5"), (4, "[1,null]", "{}")]
    out = normalise.state_changes(spark.createDataFrame(rows, "k long, before string, after string"), "k")
    assert {tuple(r) for r in out.select("k", "path", "before", "after").collect()} == {
        (1, "$.a", "1", "2"), (1, "$.b.c[1]", "2", "3"), (1, "$.b.c[2]", "{}", None), (1, "$.b.c[2].x", None, "1.5"), (1, "$.b.d", "null", "0"), (1, "$.e", "[]", "{}"),
        (2, "$.a[0]", None, "[]"), (2, "$.a[1][0]", None, "1"), (3, "$", None, "5"), (4, "$", None, "{}"), (4, "$[0]", "1", None), (4, "$[1]", "null", None)}
    assert out._jdf.queryExecution().executedPlan().toString().count("ExistingRDD") == 1


def test_strata_take_one_sort_of_bounded_parts(spark, tmp_path, monkeypatch):
    """rows are dealt to tasks by their number, once, and one sort serves the windows of all strata."""
    data = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{data}/lineitem.parquet").count()
    monkeypatch.setattr(made, "TASK_ROWS", n // 5)
    parts = made.samples(spark, data).select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(parts) >= 5 and max(r["count"] for r in parts) < n / 2
    plan = estimator_queries.QUERIES["stratified_saturated"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 2


def test_generators_see_slices(spark):
    """a table function sees a bounded slice, however large a batch is."""
    df = spark.range(3000, numPartitions=1)
    got = generated.generated(df, lambda b: pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["id"])).collect()
    assert sum(r.id for r in got) == 3000 and max(r.id for r in got) <= generated.SLICE


def test_workers_give_memory_back(monkeypatch):
    """op7_suffix_repeats: workers live on between stages, so each step gives back what a batch took."""
    calls = []
    monkeypatch.setattr(repeats, "give_back", lambda: calls.append(1))
    text = "".join(map(chr, random.Random(1).choices(range(97, 123), k=900)))
    keys = pa.array([1, 2])
    texts = pa.RecordBatch.from_arrays([keys, keys, pa.array([text, text[100:]])], ["k1", "k2", "text"])
    segs = pa.array([[{"start": 0, "n": 5, "hash": 1}]] * 2)
    steps = {
        "scan": lambda: repeats.scan(iter([texts]), 400),
        "cut": lambda: repeats.cut_segments(iter([pa.RecordBatch.from_arrays([*texts.columns, segs], ["k1", "k2", "text", "segs"])]), 400),
        "sort": lambda: repeats.sort_groups(iter([pa.RecordBatch.from_arrays([pa.array([[{"c1": 1, "c2": 1, "content": text.encode()}]])], ["group"])]), 400),
        "count": lambda: repeats.count_windows(iter([pa.RecordBatch.from_arrays([keys, keys, pa.array([5, 5]), pa.array([text.encode()] * 2)], ["c1", "c2", "n", "content"])]), 400, 16),
        "keep": lambda: repeats.keep(iter([pa.RecordBatch.from_arrays([*texts.columns, pa.array([[{"lo": 0, "hi": 1}]] * 2)], ["k1", "k2", "text", "spans"])]), 400),
    }
    for name, step in steps.items():
        before = len(calls)
        assert list(step()) and len(calls) > before, name


def test_blocks_of_vectors_are_compared_in_parts(spark):
    """blocks stay Arrow arrays, meet some queries at a time, and Arrow batches of them are bounded in bytes."""
    rng = np.random.default_rng(3)
    block = lambda n, first: pa.array([[{"id": first + i, "e": e} for i, e in enumerate(rng.normal(size=(n, 8)).tolist())]])
    q, v = block(600, 0), block(50, 590)
    parts = list(retrieval._best(q[0], v[0], "k", 3, 12, unit=True))
    assert len(parts) == -(-600 // retrieval.TOGETHER) and sum(p.num_rows for p in parts) == 1800
    e, f = (np.array([x["e"] for x in b[0].as_py()]) for b in (q, v))
    cos = (e / np.linalg.norm(e, axis=1, keepdims=True)) @ (f / np.linalg.norm(f, axis=1, keepdims=True)).T
    cos[np.arange(590, 600), np.arange(10)] = -np.inf
    assert [k for p in parts for k in p.column("k").to_pylist()] == (np.argsort(-cos, axis=1)[:, :3] + 590).ravel().tolist()
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "k long, e array<float>")
    spark.conf.unset(key)
    assert retrieval.nearest(df, df, "k", "e", 1).count() == 5 and int(spark.conf.get(key)) == retrieval.BATCH_BYTES


def test_sessions_are_dealt_by_their_number(spark, monkeypatch):
    """tasks hold a bounded number of events, and what they sort is narrow: windows come before the tasks' wide columns."""
    data = "/root/testdata/sf0.001"
    log, goals = trajectory_log.event_log(spark, data), trajectory_log.session_tasks(spark, data)
    whole = {tuple(r) for r in verdicts.safety_verdicts(log, goals).collect()}
    monkeypatch.setattr(verdicts, "TASK_EVENTS", max(1, log.count() // 9))
    got = verdicts.safety_verdicts(log, goals)
    assert {tuple(r) for r in got.collect()} == whole
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [session" in plan
    window = next(line for line in plan.splitlines() if "_effect" in line and "Window [" in line)
    assert plan.index(window) > plan.index("Join LeftOuter, (session")


def test_queues_hand_on_short_frames():
    """a queue hands on what a micro-batch pushes out in frames of a bounded length, in the order of seq, and keeps nothing but what is left."""
    class State:
        value = None

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value

        def put(self, value):
            self.value = value

        update = put

        def clear(self):
            self.value = None

    class Handle:
        def __init__(self):
            self.found = {}

        def getListState(self, name, kind):  # noqa: N802
            return self.found.setdefault(name, State())

        getValueState = getListState  # noqa: N815

    rng = np.random.default_rng(4)
    queues, handle = queue.Queues(5, 2), Handle()
    queues.init(handle)
    seqs = rng.permutation(2 * queue.FRAME_ROWS + 9)
    parts = [pd.DataFrame({"queue": "q", "seq": s, "payload": [None if x % 7 == 0 else f"p{x}" for x in s], "param_version": (s % 3).astype(np.int32)}) for s in np.array_split(seqs, 4)]
    frames = list(queues.handleInputRows(("q",), iter(parts), None))
    assert max(map(len, frames)) <= queue.FRAME_ROWS
    got = pd.concat(frames)
    n = len(seqs)
    assert got["seq"].tolist() == list(range(n - 3)) and got["event"].tolist() == ["dropped"] * (n - 5) + ["taken"] * 2
    assert got["produced"].tolist() == [5 + i for i in range(n - 5)] + [n] * 2 and got["dropped"].tolist() == [*range(1, n - 4), n - 5, n - 5]
    assert [None if p is None else p for p in got["payload"][:9]] == [None, *(f"p{i}" for i in range(1, 7)), None, "p8"]
    assert [m[0] for m in handle.found["items"].get()] == [n - 3, n - 2, n - 1] and handle.found["counts"].get() == (n, n - 5)
    more = pd.concat(queues.handleInputRows(("q",), iter([parts[0][:4].assign(seq=[n + 3, n, n + 2, n + 1])]), None))
    assert more["seq"].tolist() == [n - 3, n - 2, n - 1, n] and more["produced"].tolist() == [n + 2, n + 3, n + 4, n + 4] and more["dropped"].tolist() == [n - 4, n - 3, n - 3, n - 3]


def test_sessions_are_seen_once_a_batch(spark):
    """F16: a session's state is one value, looked at once and written once for all events of a micro-batch."""
    looks = []

    class State:
        value = None

        def get(self):
            looks.append("get")
            return self.value

        def update(self, value):
            looks.append("update")
            self.value = value

    class Handle:
        def getValueState(self, name, kind):  # noqa: N802
            return State()

    sessions = audit.Sessions()
    sessions.init(Handle())
    row = lambda seq, operation, target, title: Row("s", seq, operation, target, title, "", "")
    first = list(sessions.handleInputRows(("s",), iter([row(2, "delete", "b", "y"), row(1, "delete", "a", "x"), row(3, "create", "c", "y")]), None))
    second = list(sessions.handleInputRows(("s",), iter([row(4, "delete", "a", "z"), row(5, "create", "d", "x"), row(6, "create", "d", "z")]), None))
    assert [(r.seq, r.step, bool(r.forbidden_transition)) for r in first + second] == [(1, 1, False), (2, 2, False), (3, 3, True), (4, 4, False), (5, 5, False), (6, 6, True)]
    assert looks == ["get", "update"] * 2


def test_masked_advantages_take_no_join(spark):
    """a sequence's masked recurrence is one pass with a factor for each token, where tokens inside the mask were joined back to all."""
    rng = random.Random(17)
    rows = [(u, p, rng.random(), None if rng.random() < 0.1 else rng.random(), rng.choice([0.0, 1.0, 1.0, None])) for u in range(20) for p in range(rng.randrange(1, 12))]
    df = spark.createDataFrame(rows, "uid long, pos long, r double, v double, m double")
    out = sequences.gae(df, reward="r", value="v", gamma=0.9, lam=0.5, mask="m")
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {(x.uid, x.pos): (x.advantage, x.returns) for x in out.collect()}
    assert len(got) == len(rows)
    for uid in range(20):
        last, after = 0.0, 0.0
        for _, pos, r, v, m in sorted((x for x in rows if x[0] == uid), reverse=True):
            if m:
                last = (0.0 if v is None else r + 0.9 * after - v) + 0.45 * last
                after = v or 0.0
            advantage, returns = got[uid, pos]
            assert abs(advantage - last) < 1e-12 and (returns is None if v is None else abs(returns - last - v) < 1e-12)
