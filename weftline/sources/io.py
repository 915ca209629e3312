"""Readers and writers of prompts, rollouts, tasks and metrics.

Readers take explicit schemas, so nothing is scanned to infer them, and return lazy
frames: only the columns and rows that a query uses are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MESSAGES = "array<struct<role:string,content:string>>"
CALL = "struct<tool_name:string,arguments:string,action:string>"
TASK = f"task_id string, domain string, scenario_type string, user_query string, oracle_calls array<{CALL}>, target_servers array<string>, metadata map<string,string>"
ROLLOUT = "input string, output string, gts string, score double, step int"


def sampled(df: DataFrame, most: int | None, key: str, shuffle: bool = False, seed: int = 1) -> DataFrame:
    """At most `most` rows: the first by key, or those of the least hashes, which is a seeded choice. A sampling operator."""
    if most is None:
        return df
    return df.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(most) if shuffle else df.orderBy(key).limit(most)


def read_parquet(spark: SparkSession, *paths: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(*paths)
    return df.select(*columns) if columns else df


def read_preferences(spark: SparkSession, *paths: str, prompt: str = "prompt", chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    return read_parquet(spark, *paths).select(F.col(prompt).alias("prompt"), F.col(chosen).alias("chosen"), F.col(rejected).alias("rejected"))


def nested(df: DataFrame, column: str, keys: list[str]) -> Column:
    """A nested field by its keys."""
    out = F.col(column)
    for k in keys:
        out = out.getField(k)
    return out


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    """One JSON task a line; broken lines become rows of nulls and are dropped by task_id."""
    return spark.read.schema(TASK).json(path).where("task_id is not null")


def read_rollouts(spark: SparkSession, path: str, mask: str | None = None) -> DataFrame:
    """Dumps named <step>.jsonl, with the step from the file's name; texts that match `mask` are starred."""
    df = spark.read.schema(ROLLOUT).json(path)
    step = F.regexp_extract(F.col("_metadata.file_name"), r"(\d+)\.jsonl$", 1)
    df = df.withColumn("step", F.coalesce("step", F.when(step != "", step.cast("int"))))
    if mask:
        df = df.withColumns({c: F.regexp_replace(c, mask, "*") for c in ("input", "output", "gts")})
    return df


def write_rollouts(df: DataFrame, path: str, extra: list[str] | None = None) -> None:
    """input, output, gts, score, step and extra columns as JSON lines, a folder a step."""
    df.select("input", "output", "gts", "score", "step", *(extra or [])).withColumn("_step", F.col("step")).write.partitionBy("_step").mode("append").json(path)


def export_rows(tasks: DataFrame, seed: int = 0) -> DataFrame:
    """Tasks as training rows: prompt, data_source, reward_model, extra_info and ids; free-form parts are JSON texts."""
    calls = F.to_json("oracle_calls")
    tools = F.array_distinct(F.transform(F.filter("oracle_calls", lambda c: c["action"] == "tool_call"), lambda c: c["tool_name"]))
    return tasks.select(
        F.to_json(F.array(F.struct(F.lit("user").alias("role"), F.col("user_query").alias("content")))).alias("prompt"),
        F.col("domain").alias("data_source"),
        F.struct(F.lit("rule").alias("style"), F.struct("task_id", calls.alias("oracle_calls"), tools.alias("required_tools")).alias("ground_truth")).alias("reward_model"),
        F.struct("task_id", "domain", "target_servers", tools.alias("required_tools"), F.lit(seed).cast("bigint").alias("session_seed"), "user_query", "scenario_type").alias("extra_info"),
        F.col("task_id").alias("uid"), F.col("task_id").alias("group_id"), "scenario_type",
    )


def contract_error(calls: Column, scenario: Column, query: Column) -> Column:
    """Why a task may not train, or null: one terminal call; no tool calls where none are due, else 2 to 5; no stale year."""
    tools = F.size(F.filter(calls, lambda c: c["action"] == "tool_call"))
    ends = F.size(F.filter(calls, lambda c: c["action"] != "tool_call"))
    none_due = scenario.isin("missing_function", "irrelevant", "no_tool_or_abstention")
    return (
        F.when(ends != 1, F.lit("terminal_count")).when(none_due & (tools > 0), F.lit("unexpected_call"))
        .when(~none_due & ~tools.between(2, 5), F.lit("call_count")).when(query.rlike(r"\b202[0-5][-/]"), F.lit("stale_year"))
    )


def merge_shards(spark: SparkSession, pattern: str, key: str, order: str, target: int) -> DataFrame:
    """All shards, first row a key, the first `target` rows by order; fails if there are fewer."""
    from pyspark.sql import Window

    rows = spark.read.parquet(pattern)
    kept = rows.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_k = 1").drop("_k").orderBy(order).limit(target)
    if kept.count() < target:
        raise ValueError(f"shards hold fewer than {target} distinct rows")
    return kept


def append_metrics(metrics: DataFrame, path: str) -> None:
    """(step, key, value) rows, appended to a table that trackers read."""
    metrics.select("step", "key", "value").write.mode("append").parquet(path)


def audit(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(check, passed, failures) for named predicates that every row must meet, in one pass; null counts as failed."""
    counts = df.agg(*[F.sum(F.when(F.coalesce(c, F.lit(False)), 0).otherwise(1)).alias(k) for k, c in rules.items()])
    return counts.select(F.explode(F.array(*[
        F.struct(F.lit(k).alias("check"), (F.coalesce(F.col(k), F.lit(0)) == 0).alias("passed"), F.coalesce(F.col(k), F.lit(0)).alias("failures")) for k in rules
    ])).alias("r")).select("r.*")
