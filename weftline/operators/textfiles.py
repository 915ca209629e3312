"""Line tools over a table of files (path, content): a row a file, lines as arrays or exploded rows.

Every tool works on all files at once; lines of one file stay in one row unless a
result is by line, so only results that compare files are joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lines(content: Column) -> Column:
    return F.split(content, "\n")


def head(content: Column, n: int) -> Column:
    return F.array_join(F.slice(lines(content), 1, n), "\n")


def tail(content: Column, n: int) -> Column:
    rows = lines(content)
    return F.array_join(F.slice(rows, F.greatest(F.size(rows) - n + 1, F.lit(1)), n), "\n")


def counts(content: Column) -> Column:
    """Lines, words and characters."""
    return F.struct(F.size(lines(content)).alias("lines"), F.size(F.filter(F.split(content, r"\s+"), lambda w: w != "")).alias("words"), F.length(content).alias("chars"))


def numbered(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, line_no from 1, line)."""
    return files.select(path, F.posexplode(lines(F.col(content))).alias("_n", "line")).select(path, (F.col("_n") + 1).alias("line_no"), "line")


def grep(files: DataFrame, text: str, most: int = 50, path: str = "path", content: str = "content") -> DataFrame:
    """Per file the first `most` lines that contain a text, and how many do in all: a top-k report."""
    hits = F.filter(F.transform(lines(F.col(content)), lambda x, i: F.struct((i + 1).alias("line_no"), x.alias("line"))), lambda s: F.contains(s["line"], F.lit(text)))
    return files.select(path, F.size(hits).alias("count"), F.slice(hits, 1, most).alias("hits")).where("count > 0")


def sorted_lines(content: Column, reverse: bool = False, unique: bool = False) -> Column:
    rows = F.array_distinct(lines(content)) if unique else lines(content)
    return F.array_join(F.reverse(F.array_sort(rows)) if reverse else F.array_sort(rows), "\n")


def field(content: Column, n: int, separator: str = r"\s+") -> Column:
    """The n-th field (from 1) of every line, empty where a line has fewer."""
    return F.array_join(F.transform(lines(content), lambda x: F.coalesce(F.get(F.filter(F.split(x, separator), lambda w: w != ""), F.lit(n - 1)), F.lit(""))), "\n")


def substituted(content: Column, pattern: str, replacement: str) -> Column:
    """A pattern replaced on every line."""
    return F.array_join(F.transform(lines(content), lambda x: F.regexp_replace(x, pattern, replacement)), "\n")


def hex_rows(content: Column, width: int = 16) -> Column:
    """The bytes in hex, `width` a row."""
    return F.regexp_replace(F.lower(F.hex(content.cast("binary"))), f"(.{{{2 * width}}})(?=.)", "$1\n")


def extra_lines(a: DataFrame, b: DataFrame, on: str = "path") -> DataFrame:
    """Lines of b past a file's equal numbering: those whose number a lacks or whose text differs there."""
    x, y = numbered(a).withColumnRenamed("line", "old"), numbered(b)
    return y.join(x, [on, "line_no"], "left").where(~F.col("line").eqNullSafe(F.col("old"))).select(on, "line_no", "line")


def joined(a: DataFrame, b: DataFrame) -> DataFrame:
    """Lines of a with the rest of b's line of the same first word; of b's equal keys the last wins, and lines without one stay."""
    key = lambda c: F.split(F.trim(c), r"\s+")
    left = numbered(a).withColumn("k", F.get(key(F.col("line")), F.lit(0)))
    right = numbered(b).withColumn("k", F.get(key(F.col("line")), F.lit(0)))
    last = F.row_number().over(Window.partitionBy("k").orderBy(F.desc("path"), F.desc("line_no")))
    right = right.withColumn("_r", last).where("_r = 1").select("k", F.array_join(F.slice(key(F.col("line")), F.lit(2), F.size(key(F.col("line")))), " ").alias("rest"))
    return left.join(right, "k", "left").select("path", "line_no", F.when(F.coalesce("rest", F.lit("")) != "", F.concat("line", F.lit(" "), F.col("rest"))).otherwise(F.col("line")).alias("line"))


def usage(files: DataFrame, depth: int = 1, path: str = "path", content: str = "content") -> DataFrame:
    """Characters below each folder, down to a depth."""
    parts = F.split(F.ltrim(F.col(path), F.lit("/")), "/")
    folders = F.transform(F.sequence(F.lit(1), F.greatest(F.least(F.size(parts) - 1, F.lit(depth)), F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return files.select(F.explode(folders).alias("folder"), F.length(content).alias("n")).groupBy("folder").agg(F.sum("n").alias("chars"), F.count(F.lit(1)).alias("files"))
