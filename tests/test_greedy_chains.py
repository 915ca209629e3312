"""Chains of successive versions are decided to their end."""

from weftline.operators import relational


def test_greedy_keep_decides_long_chains(spark):
    n = 1500
    df = spark.range(2 * n)
    edges = [(i, i + 1) for i in range(n - 1)] + [(3, n + 5), (700, n + 6), (701, n + 6), (701, n + 7)]
    kept = set()
    for i in range(2 * n):
        if not any(b == i and a in kept for a, b in edges):
            kept.add(i)
    got = relational.greedy_keep(df, "id", spark.createDataFrame(edges, "a long, b long"))
    assert {r.id for r in got.collect()} == kept
