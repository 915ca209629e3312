"""The driver's tables in the shapes the operators expect.

lineitem rows are samples: an order is a prompt group, the price a score, the
quantity a length, the flags a level and a scenario, discount and tax log-probabilities.
Rows of a group have a total order, so that ties are equal in every column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a task, about, where a table is dealt by a key.
TASK_ROWS = 250_000
ROW_ORDER = (
    "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax",
    "l_returnflag", "l_linestatus", "l_shipdate",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, key: str) -> DataFrame:
    """A table dealt by a key to as many tasks as hold about TASK_ROWS rows each, so that what a task sorts doesn't grow with the table."""
    return df.repartition(max(1, -(-df.count() // TASK_ROWS)), key)


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """uid, pos (from 1), score, length, level, scenario, old_lp, lp, ref_lp."""
    w = Window.partitionBy("l_orderkey").orderBy(*ROW_ORDER)
    return dealt(table(spark, sf_dir, "lineitem"), "l_orderkey").select(
        F.col("l_orderkey").alias("uid"), F.row_number().over(w).alias("pos"), F.col("l_extendedprice").alias("score"),
        F.col("l_quantity").alias("length"), F.col("l_returnflag").alias("level"), F.col("l_linestatus").alias("scenario"),
        (-F.col("l_discount") * 10 - 0.1).alias("old_lp"), (-F.col("l_tax") * 10 - 0.2).alias("lp"),
        (-(F.col("l_discount") + F.col("l_tax")) * 5 - 0.15).alias("ref_lp"),
    )


#: The same in SQL, as the common table `s` of the checking queries.
SAMPLES_SQL = f"""s AS (
  SELECT l_orderkey AS uid, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(ROW_ORDER)})::INT AS pos,
         l_extendedprice AS score, l_quantity AS length, l_returnflag AS level, l_linestatus AS scenario,
         -l_discount * 10 - 0.1::DOUBLE AS old_lp, -l_tax * 10 - 0.2::DOUBLE AS lp,
         -(l_discount + l_tax) * 5 - 0.15::DOUBLE AS ref_lp
  FROM lineitem)"""


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Round so that engines that sum in different orders agree; -0.0 becomes 0.0."""
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in columns})
