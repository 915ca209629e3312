"""The vector index against the exact search, disturbances and schemas against plain Python, generated rows."""

import json
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftline.functions import contracts, perturb
from weftline.operators import retrieval
from weftline.sources import generated


def test_index_recall(spark):
    """Every row whose id is divisible by 20 against all rows: at least nine of ten of the exact neighbours are found."""
    v = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    centroids = retrieval.fitted_centroids(v, "vec_id", "embedding")
    index = retrieval.inverted_file(v, "vec_id", "embedding", centroids)
    assert index.count() == v.count() and len(centroids) > 30
    queries, probes = v.where("vec_id % 20 = 0"), retrieval.probes_for(v, "vec_id", "embedding", centroids)
    assert probes < len(centroids)
    exact = {(r.query_id, r.vec_id): r.cosine for r in retrieval.nearest(v, queries, "vec_id", "embedding", 5).collect()}
    got = {(r.query_id, r.vec_id): r.cosine for r in retrieval.nearest_indexed(index, centroids, queries, "vec_id", "embedding", 5, probes).collect()}
    recall = len(exact.keys() & got.keys()) / len(exact)
    assert recall >= 0.9 and all(got[k] == pytest.approx(exact[k], abs=1e-5) for k in exact.keys() & got.keys())
    # with all lists looked up it is exact
    whole = {(r.query_id, r.vec_id) for r in retrieval.nearest_indexed(index, centroids, queries, "vec_id", "embedding", 5, probes=len(centroids)).collect()}
    assert len(whole & exact.keys()) >= 0.99 * len(exact)


def test_index_of_odd_rows(spark):
    rows = [(i, [1.0, float(i % 3)]) for i in range(60)] + [(100, None), (101, [0.0, 0.0]), (102, [1.0, 0.0]), (102, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "k long, e array<float>")
    c = retrieval.fitted_centroids(df, "k", "e", lists=4)
    index = retrieval.inverted_file(df, "k", "e", c)
    assert index.count() == 62 and index.where("id in (100, 101)").count() == 0
    got = retrieval.nearest_indexed(index, c, df.where("k % 20 = 0 or k > 99"), "k", "e", 2, probes=9, rows=7).collect()
    assert {r.query_id for r in got} == {0, 20, 40, 102} and all(r.k != r.query_id for r in got)
    none = df.limit(0)
    c = retrieval.fitted_centroids(none, "k", "e")
    assert retrieval.nearest_indexed(retrieval.inverted_file(none, "k", "e", c), c, none, "k", "e", 2, retrieval.probes_for(none, "k", "e", c)).count() == 0


OBSERVATIONS = [None, "text", '"text"', "[1,2]", "{}", '{"items":[1,2,3],"a":"x"}', '{"results":[{"id":1},{"id":2},3,{"id":4}],"total":4,"cursor":"c"}', '{"items":[1]}', '{"items":"no","results":[1,2]}', '{"matches":[1,2,3,4],"count":9}', '{"updated":[{"status":"ok"},{"k":[1]}]}', '{"created":[1,2,3],"results":[1]}', '{"items":null,"results":[1,2]}']


def test_each_disturbance(spark):
    df = spark.createDataFrame(list(enumerate(OBSERVATIONS)), "i int, o string")
    got = df.select("i", perturb.paged(F.col("o")).alias("p"), perturb.snippets(F.col("o"), F.lit(0.5)).alias("s"), perturb.failed_batch(F.col("o"), F.col("i").cast("string")).alias("b")).collect()
    for r in got:
        try:
            o = json.loads(OBSERVATIONS[r.i] or "")
        except ValueError:
            o = None
        fields = o if isinstance(o, dict) else {}
        items = fields.get("items", fields.get("results", []))
        paged = {**fields, "items": items[: len(items) // 2], "next_cursor": "page_2"} if isinstance(items, list) and len(items) > 1 else None
        assert (json.loads(r.p) if r.p else None) == paged, OBSERVATIONS[r.i]
        lists = [fields[k] for k in perturb.LISTS if isinstance(fields.get(k), list)]
        few = lists and len(lists[0]) >= 2
        assert bool(r.s) == bool(few)
        if r.s:
            assert json.loads(r.s) == {"summary": perturb.SUMMARY, "snippet_count": min(len(lists[0]), 2), "requires_detail_fetch": True, **{k: fields[k] for k in perturb.COUNTS if k in fields}}
        name = next((k for k in perturb.BATCHES if isinstance(fields.get(k), list) and len(fields[k]) > 1), None)
        assert bool(r.b) == bool(name)
        if r.b:
            new, n = json.loads(r.b), max(1, len(fields[name]) // 3)
            changed = [(x, y) for x, y in zip(fields[name], new[name], strict=True) if x != y]
            assert new["partial_failure"] is True and new["failed_count"] == n and len(changed) <= n and all(y == {**x, "status": "failed", "error": perturb.FAILURE} for x, y in changed)
            assert {k: v for k, v in new.items() if k not in (name, "partial_failure", "failed_count")} == {k: v for k, v in fields.items() if k != name}


def test_disturbances_are_seeded(spark):
    df = spark.range(4000).select(F.col("id"), F.lit('{"items":[1,2]}').alias("o"), F.when(F.col("id") % 2 == 0, "email").otherwise("banking").alias("d"))
    seen = lambda seed: {r.id: r.s for r in df.repartition(3).select("id", perturb.disturbed(F.col("o"), F.col("d"), F.col("id"), seed).alias("s")).collect()}
    one, two = seen(1), seen(2)
    assert one == seen(1) and one != two
    share = [sum(s != '{"items":[1,2]}' for i, s in one.items() if i % 2 == k) / 2000 for k in (0, 1)]
    assert all(0.07 < x < 0.13 for x in share)


KINDS = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "object": dict, "array": list, "null": type(None)}


def test_schema_errors(spark):
    rng = random.Random(5)
    values = ["a", "1", 1, 2.5, True, None, [], {"x": 1}, [1, {"y": None}]]
    rows = []
    for i in range(300):
        props = {k: {**({"type": rng.choice([*KINDS, ["string", "null"], ["integer", "object"], "odd"])} if rng.random() < 0.8 else {}), **({"enum": rng.sample(values, 3)} if rng.random() < 0.3 else {})} for k in "abc"}
        args = rng.choice([{k: rng.choice(values) for k in rng.sample("abcd", rng.randint(0, 4))}] * 9 + [[1]])
        rows.append((i, args, {rng.choice(["input_schema", "parameters"]): {"properties": props, "required": rng.sample("abcd", 2)}}))

    def same(x, y):
        return type(x) is type(y) and x == y if isinstance(x, (str, list, dict)) or isinstance(y, (str, list, dict)) or x is None or y is None else x == y

    def due(args, schema):
        if not isinstance(args, dict):
            return (False, [], [], ["arguments must be object"], [])
        inner = next(iter(schema.values()))
        props = inner["properties"]
        fits = lambda v, t: any(k in KINDS and isinstance(v, KINDS[k]) and not (k in ("integer", "number") and isinstance(v, bool)) for k in (t if isinstance(t, list) else [t]))
        missing, unexpected = {k for k in inner["required"] if k not in args}, {k for k in args if k not in props}
        typed = {k for k, v in args.items() if k in props and "type" in props[k] and not fits(v, props[k]["type"])}
        enums = {k for k, v in args.items() if k in props and "enum" in props[k] and not any(same(v, e) for e in props[k]["enum"])}
        return (not (missing or unexpected or typed or enums), *map(sorted, (missing, unexpected, typed, enums)))

    df = spark.createDataFrame([(i, json.dumps(a), json.dumps(s)) for i, a, s in rows], "i int, a string, s string")
    got = {r.i: (r.e.valid, *map(sorted, (r.e.missing, r.e.unexpected, r.e.type_errors, r.e.enum_errors))) for r in df.select("i", contracts.schema_errors(F.col("a"), F.col("s")).alias("e")).collect()}
    assert {i: (got[i], due(a, s), a, s) for i, a, s in rows if got[i] != due(a, s)} == {}


def test_rules_are_made_once_for_many_arguments(spark):
    """Rules of one row, met by arguments of every odd form: what doesn't parse, keys with quotes, numbers written otherwise, null among types."""
    schema = '{"parameters":{"required":["a","a",1],"properties":{"a":{"type":["integer",null]},"b\'":{"enum":[1.0,"1",[1],{"y":2,"x":1}]},"c\\"":{"type":"null"},"d":7}}}'
    given = [None, "{bad", "[]", '{"a":1,"a":2}', '{"a":1e2,"d":0}', '{"a":1.5,"b\'":true}', '{"b\'":[1.0]}', '{"b\'":{"x":1,"y":2},"c\\"":null,"1":0}', '{"a":99999999999999999999,"c\\"":"null"}']
    rules = spark.range(1).select(contracts.schema_rules(F.lit(schema)).alias("r"))
    df = spark.createDataFrame(list(enumerate(given)), "i int, a string")
    got = {r.i: (r.e.valid, r.e.missing, r.e.unexpected, r.e.type_errors, r.e.enum_errors) for r in df.crossJoin(rules).select("i", contracts.rule_errors(F.col("a"), F.col("r")).alias("e")).collect()}
    broken = (False, [], [], ["arguments must be object"], [])
    assert got == {
        0: broken, 1: broken, 2: broken, 3: broken, 4: (False, ["1"], [], [], []), 5: (False, ["1"], [], ["a"], []), 6: (False, ["a", "1"], [], [], []),
        7: (False, ["a"], ["1"], [], []), 8: (False, ["1"], [], ['c"'], [])}
    assert got == {r.i: tuple(r.e) for r in df.select("i", contracts.schema_errors(F.col("a"), F.lit(schema)).alias("e")).collect()}


def test_generated_rows(spark):
    df = spark.createDataFrame([(i, "x" * i) for i in range(50)], "i long, t string").repartition(3)

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(np.array(batch.column(0)) % 2 == 0))

    new = generated.generated(df, make)
    assert sorted(r.i for r in new.collect()) == list(range(0, 50, 2)) and new.schema == df.schema
    out = generated.with_generated(df, new, F.length("t"), 10)
    assert out.count() == 50 + 6
    assert generated.first_again(df, "i").where("i = 0").count() == 2 and generated.first_again(df.limit(0), "i").count() == 0
    assert generated.upsampled(df, 3).count() == 150 and generated.upsampled(df, 0).count() == 0
