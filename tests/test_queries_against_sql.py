"""Queries over the smallest tables against their SQL in another engine."""

import glob
import math
import os

import pytest

from weftline.plans import batch_queries, feed_queries, math_queries, normaliser_queries, record_queries, source_queries, stream_queries, task_queries, trace_queries, verdict_queries

DATA = "/root/testdata/sf0.001"
PLANS = (verdict_queries, task_queries, record_queries, stream_queries, normaliser_queries, math_queries, trace_queries, feed_queries, source_queries, batch_queries)


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return float(f"{float(v):.9g}") if hasattr(v, "as_tuple") else v


@pytest.fixture(scope="module")
def engine():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DATA):
        pytest.skip("no test data")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}{'/*.parquet' if os.path.isdir(f) else ''}')")
    return con


@pytest.mark.parametrize("plan", PLANS, ids=lambda m: m.__name__.rsplit(".", 1)[-1])
def test_same_rows(spark, engine, plan):
    for name, sql in plan.ORACLE_SQL.items():
        df = plan.QUERIES[name](spark, DATA)
        columns = sorted(df.columns)
        got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
        found = engine.execute(sql)
        names = [d[0] for d in found.description]
        assert sorted(names) == columns, name
        want = sorted((tuple(plain(dict(zip(names, row, strict=True))[c]) for c in columns) for row in found.fetchall()), key=str)
        assert got == want, name
