"""Paths in small dependency graphs, grown by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def simple_paths(edges: DataFrame, longest: int = 5, few: int | None = 2, src: str = "src", dst: str = "dst", relation: str = "relation", pos: str = "pos") -> DataFrame:
    """Paths of 2 to `longest` nodes without repeats, as arrays.

    Explicit edges all count; of a node's implicit edges only the first `few` by
    position. One join a length: paths grow by the edges of their last node.
    """
    if few is not None:
        w = Window.partitionBy(src, relation).orderBy(pos)
        edges = edges.withColumn("_k", F.row_number().over(w)).where((F.col(relation) != "implicit") | (F.col("_k") <= few))
    edges = edges.select(F.col(src).alias("_s"), F.col(dst).alias("_d")).where("_s <> _d").distinct()
    paths = edges.select(F.array("_s", "_d").alias("path"))
    out = paths
    for _ in range(longest - 2):
        paths = paths.join(edges, F.element_at("path", -1) == F.col("_s")).where(~F.array_contains("path", F.col("_d"))).select(F.concat("path", F.array("_d")).alias("path"))
        out = out.union(paths)
    return out


def merge_edges(*tables: DataFrame) -> DataFrame:
    """The union of edge tables (src, dst, relation) without repeats."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.dropDuplicates(["src", "dst", "relation"])
