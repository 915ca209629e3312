"""Streams that stop, resume and hand batches over twice; orders and draws of training rows."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.operators import curriculum
from weftline.operators.trajectories import dual_step
from weftline.sources import epochs
from weftline.streaming import audit, queue, sinks

EVENTS = "session string, seq long, operation string, target_id string, title string, start string, forbidden_transition string"


def sessions(rng, n):
    words = [None, "", " Talk ", "TALK", "walk"]
    return [(rng.choice(["a", "b", "c", None]), i, rng.choice(["create", "delete", "query", None]), rng.choice(["r1", "r2", "", None]), rng.choice(words), rng.choice([None, "", "mon", "tue"]), rng.choice(["", "", None, "own"])) for i in range(n)]


def audited(rows):
    gone, steps, out = {}, Counter(), set()
    mark = lambda x: (x or "").strip().lower()
    for session, seq, operation, target, title, start, forbidden in rows:
        if session is None:
            continue
        steps[session] += 1
        own = gone.setdefault(session, {})
        if operation == "delete" and target:
            own[target] = (mark(title), mark(start))
        again = operation == "create" and any((mark(title) and mark(title) == t) or (mark(start) and mark(start) == s) for t, s in own.values())
        out.add((session, seq, steps[session], f"evtlog_{session}_{steps[session]:06d}", operation or "", target or "", forbidden or (audit.RECREATED if again else "")))
    return out


def test_audit_over_restarts_is_the_batch(spark, tmp_path):
    rows = sessions(random.Random(4), 150)
    df = spark.createDataFrame(rows, EVENTS)
    assert {tuple(r) for r in audit.audited_log(df).collect()} == audited(rows)
    for k in range(3):
        df.where((F.col("seq") >= 50 * k) & (F.col("seq") < 50 * k + 50)).repartition(2).write.mode("append").parquet(str(tmp_path / "in"))
        got = queue.drained(audit.audited_stream(spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in"))), str(tmp_path / "out"))
    assert {tuple(r) for r in got.collect()} == audited(rows)
    assert audit.audited_log(df.limit(0)).collect() == []


def test_marks_of_calls(spark):
    rows = [
        ("delete", "E1", '{"calendar":{"events":{"E1":{"title":"T","start_time":"s"}}}}', "{}", None),
        ("create", "E2", None, '{"events":{"E2":{"title":"U"}}}', '{"event":{"event_id":"E2","title":"V"}}'),
        ("create", "E2", None, '{"events":{"E2":{"title":"U"}}}', '{"ok":true}'), ("query", "E2", None, None, None), ("create", "E3", None, "broken", '"text"'),
    ]
    df = spark.createDataFrame(rows, "operation string, target_id string, before string, after string, observation string")
    assert [(r.title, r.start) for r in audit.with_marks(df).collect()] == [("T", "s"), ("V", None), ("U", None), (None, None), (None, None)]


@pytest.mark.parametrize("name", ["c_safety", "C_safety", "is_unsafe", "reward_extra_info", "other"])
def test_multiplier_moves_once_a_batch(spark, tmp_path, name):
    rng = random.Random(1)
    path, state, due = str(tmp_path / "lam"), (1.0, 0, False), []
    sink = sinks.multiplier_sink(path, rate=0.5, stall_after=2)
    for number in range(6):
        costs = [int(rng.random() < (0.9 if number < 4 else 0.1)) for _ in range(20)]
        given = [f'{{"c_safety": {c}}}' for c in costs] if name == "reward_extra_info" else costs
        batch = spark.createDataFrame([(c,) for c in given], f"{name} {'string' if name == 'reward_extra_info' else 'int'}")
        sink(batch, number)
        if number in (2, 4):
            sink(batch, number)  # handed over again
        if name != "other":
            state = dual_step(*state, sum(costs) / 20, 0.5, 0.05, 3.0, 2, 0.5)
        due.append((number, *state))
    got = sorted((r.batch, r.lam, r.streak, r.frozen) for r in sinks.committed(spark, path, sinks.CONTROL).collect())
    assert [g[0] for g in got] == list(range(6)) and all(g[1] == pytest.approx(d[1]) and g[2:] == d[2:] for g, d in zip(got, due, strict=True))


def test_batches_are_assembled_once(spark, tmp_path):
    kind = "seq long, param_version long, version_start long, version_end long, seconds double"
    path = str(tmp_path / "b")
    sink = sinks.batch_sink(path, 10)
    for number, (low, high) in enumerate([(0, 7), (7, 25), (25, 25), (25, 41)]):
        batch = spark.createDataFrame([(i, i % 3, 1, 1 + i % 2, float(i)) for i in range(low, high)], kind)
        sink(batch, number)
        sink(batch, number)
    rows = sinks.committed(spark, f"{path}/samples", kind + ", assembled long").where("assembled is not null").collect()
    assert sorted((r.seq, r.assembled) for r in rows) == [(i, i // 10 + 1) for i in range(40)]
    metrics = {(r.batch, r.key): r.value for r in sinks.committed(spark, f"{path}/metrics", sinks.METRICS).collect()}
    assert {b for b, _ in metrics} == {1, 3} and metrics[1, "samples"] == 20 and metrics[1, "processing_time/tp50"] == 9.5 and metrics[3, "partial/partial_ratio"] == 0.5
    assert sinks.committed(spark, str(tmp_path / "none"), sinks.METRICS).count() == 0


@pytest.mark.parametrize("rows", [1, 2, 3, 100, 1000])
def test_permutation(rows):
    orders = [epochs.permuted(np.arange(rows), rows, 5, e) for e in range(3)]
    assert all(sorted(o.tolist()) == list(range(rows)) for o in orders)
    assert rows < 100 or (orders[0] != orders[1]).any()
    assert rows < 100 or abs(np.corrcoef(np.arange(rows), orders[0])[0, 1]) < 0.3


def test_epochs_stop_and_resume(spark, tmp_path):
    seen = []
    for budget in (3, 3, 11, 19, None, None):
        seen.append(queue.drained(epochs.epochs(spark, 7, 3, seed=2, budget=budget), str(tmp_path)).count())
    assert seen == [3, 3, 11, 19, 22, 22]
    got = spark.read.parquet(str(tmp_path / "rows"))
    assert sorted((r.epoch, r.row) for r in got.where("position is not null").collect()) == [(e, i) for e in range(3) for i in range(7)]
    assert [(r.epoch, r.row) for r in got.where("position is null").collect()] == [(3, None)]
    numbered = spark.createDataFrame([(i, f"t{i}") for i in range(7)], "row_idx long, text string")
    fed = epochs.samples(got, numbered)
    assert fed.where("done").count() == 1 and fed.where("text is null").count() == 1


def test_an_empty_table_has_the_end_marker_only(spark, tmp_path):
    assert [tuple(r) for r in queue.drained(epochs.epochs(spark, 0, 3), str(tmp_path)).collect()] == [(0, None, None)]


def test_drawn_by_priority(spark):
    df = spark.createDataFrame([(i, [4.0, 1.0, 0.0, None, -1.0][i % 5]) for i in range(500)], "k long, p double")
    first = Counter(r.k % 5 for step in range(6) for r in curriculum.drawn(df, "k", "p", 20, 3, step).collect())
    assert set(first) == {0, 1} and 2 < first[0] / first[1] < 9
    whole = curriculum.drawn(df, "k", "p", 10_000, 3).collect()
    assert len(whole) == 200 and sorted(r.position for r in whole) == list(range(200))
    moved = curriculum.reprioritised(df, "k", "p", spark.createDataFrame([(0, 0.5), (1, 1.0), (1, 1.0), (9999, 0.0)], "k long, s double"), "s")
    got = {r.k: r.p for r in moved.collect()}
    assert got[0] == 2.5 and got[1] == 0.505 and got[5] == 4.0 and len(got) == 500 and moved.columns == df.columns
    assert curriculum.drawn(df.limit(0), "k", "p", 5).count() == 0


def test_stall_streaks(spark):
    rng = random.Random(2)
    rows = [(k % 3, i, rng.random() < 0.6, rng.random()) for i in range(200) for k in (i,)]
    due, streak = {}, Counter()
    for key, i, rose, rate in rows:
        streak[key] = streak[key] + 1 if rose and rate > 0.4 else max(0, streak[key] - 1)
        due[i] = (streak[key], streak[key] >= 2)
    got = sinks.stall_streaks(spark.createDataFrame(rows, "k int, i int, rose boolean, rate double"), "k", "i", "rose", "rate", 2, 0.4)
    assert {r.i: (r.streak, r.stalled) for r in got.collect()} == due
