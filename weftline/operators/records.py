"""Decoding of event logs and rollouts: defaults, nested columns lifted up, required calls by priority, merges and records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.tasks import ABSTAINING, TARGET_KEYS

EVENT = (
    "event_id string, session_id string, step int, step_index int, action_type string, tool_name string, tool_arguments map<string,string>, operation string, target_id string, "
    "changed_fields array<string>, created_ids array<string>, deleted_ids array<string>, duplicate_of string, identity_violation string, forbidden_transition string, observation string, "
    "execution_success boolean, schema_valid boolean, state_changed boolean, latency_ms int"
)


def decoded_events(rows: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """The events in a column of JSON lists, a row each, with defaults for what they lack. Broken lists and items that are no objects give none."""
    items = F.from_json(F.col(column), "array<string>")
    each = rows.select(*keep, F.posexplode(items).alias("nth", "_raw")).where(F.startswith(F.schema_of_variant(F.try_parse_json("_raw")), F.lit("OBJECT")))
    e = each.select(*keep, "nth", F.from_json("_raw", EVENT).alias("e"))
    text = lambda c: F.coalesce(F.col(f"e.{c}"), F.lit("")).alias(c)
    some = lambda c: F.coalesce(F.col(f"e.{c}"), F.array().cast("array<string>")).alias(c)
    flag = lambda c: F.coalesce(F.col(f"e.{c}"), F.lit(False)).alias(c)
    return e.select(
        *keep, "nth", text("event_id"), F.coalesce("e.step", "e.step_index", F.lit(0)).alias("step"), text("action_type"), text("tool_name"), F.coalesce("e.tool_arguments", F.create_map().cast("map<string,string>")).alias("arguments"),
        text("operation"), text("target_id"), some("changed_fields"), some("created_ids"), some("deleted_ids"), "e.duplicate_of", text("identity_violation"), text("forbidden_transition"), "e.observation",
        flag("execution_success"), flag("schema_valid"), flag("state_changed"), F.coalesce("e.latency_ms", F.lit(0)).alias("latency_ms"))


def promoted(df: DataFrame, info: str, defaults: dict[str, Column]) -> DataFrame:
    """Columns lifted out of a map column where they are missing: its value, else the default; columns that are there stay."""
    lifted = {c: F.coalesce(F.try_element_at(F.col(info), F.lit(c)), d) for c, d in defaults.items() if c not in df.columns}
    return df.withColumns(lifted) if lifted else df


def generic_target(arguments: Column, observation: Column) -> Column:
    """The thing a call is about: its first argument that ends in _id, else a path or account, else the first such key of the observation's
    top level (a map), else an empty text."""
    ends = lambda m: F.get(F.filter(F.map_entries(m), lambda e: F.lower(e["key"]).endswith("_id") & e["value"].isNotNull()), F.lit(0))["value"]
    paths = [F.nullif(F.try_element_at(arguments, F.lit(k)), F.lit("")) for k in TARGET_KEYS]
    return F.coalesce(ends(arguments), *paths, ends(observation), F.lit(""))


def resolved_tasks(tasks: DataFrame) -> DataFrame:
    """`required` and `allowed_terminals` of tasks, by the priority of what they say.

    Input: calls (array of tool_name, arguments, action), required_tools, scenario,
    missing (flag), allowed (array). Abstaining tasks require nothing; else the tool calls
    of the oracle count, nothing for an oracle that only asks back, and the listed tools
    where there is no oracle. Stated last actions come first, then the oracle's last one.
    """
    none = F.col("calls").isNull() | (F.size("calls") == 0)
    real = F.transform(F.filter("calls", lambda c: F.coalesce(c["action"], F.lit("tool_call")) == "tool_call"), lambda c: F.struct(c["tool_name"].alias("tool_name"), c["arguments"].alias("arguments")))
    ends = F.filter("calls", lambda c: c["action"].isin("final_answer", "ask_clarification", "report_error", "clarification"))
    last = F.try_element_at(ends, F.lit(-1))["action"]
    last = F.when(last == "clarification", "ask_clarification").otherwise(last)
    listed = F.transform(F.coalesce("required_tools", F.array().cast("array<string>")), lambda t: F.struct(t.alias("tool_name"), F.create_map().cast("map<string,string>").alias("arguments")))
    abstains = F.coalesce(F.col("missing"), F.lit(False)) | F.coalesce(F.col("scenario").isin(*ABSTAINING), F.lit(False))
    nothing = F.slice(listed, F.lit(1), F.lit(0))
    required = F.when(abstains, nothing).when(~none & (F.size(real) > 0), real).when(F.coalesce(last == "ask_clarification", F.lit(False)), nothing).otherwise(listed)
    allowed = F.when(F.size(F.coalesce("allowed", F.array().cast("array<string>"))) > 0, F.col("allowed")).when(last.isNotNull(), F.array(last)).when(abstains, F.array(F.lit("report_error"))).otherwise(F.array(F.lit("final_answer")))
    return tasks.withColumns({"required": required, "allowed_terminals": allowed})


#: What tools' changes are checked by, as container, field and the tools.
DOMAIN_FIELDS = (
    ("accounts", "balance", ("transfer",)), ("orders", "status", ("create_order",)), ("invoices", "status", ("create_invoice", "pay_invoice")), ("leads", "status", ("update_lead", "convert_lead", "create_deal")),
    ("issues", "state", ("create_issue", "update_issue", "transition_issue")),
)


def domain_criteria(tools: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """(task, type, path, value): criteria by the tools that a task called, for entities whose field changed or that are new.

    Input: tools (task, tool_name), states (task, container, entity, field, value).
    Mail is checked by its count, a cart by not being empty, new files by being there.
    """
    key = ["task", "container", "entity", "field"]
    called = tools.groupBy("task").agg(F.collect_set("tool_name").alias("_t"))
    has = lambda *names: F.arrays_overlap("_t", F.array(*map(F.lit, names)))
    changed = after.join(before.select(*key, F.col("value").alias("_was")), key, "left").where(~F.col("value").eqNullSafe(F.col("_was"))).join(called, "task")
    due = F.lit(False)
    for container, field, names in DOMAIN_FIELDS:
        due = due | ((F.col("container") == container) & (F.col("field") == field) & has(*names))
    equal = changed.where(due).select("task", F.lit("state_equals").alias("type"), F.concat_ws(".", "container", "entity", "field").alias("path"), "value")
    things = after.select("task", "container", "entity").distinct().join(called, "task")
    mail = things.where((F.col("container") == "emails") & has("send_email")).groupBy("task").agg(F.count(F.lit(1)).cast("string").alias("value")).select("task", F.lit("email_count_gte").alias("type"), F.lit("").alias("path"), "value")
    cart = things.where((F.col("container") == "cart") & has("add_to_cart")).select("task", F.lit("cart_not_empty").alias("type"), F.lit("").alias("path"), F.lit(None).cast("string").alias("value")).distinct()
    files = things.where((F.col("container") == "fs") & has("write_file", "create_file", "mkdir")).join(before.select("task", "container", "entity").distinct(), ["task", "container", "entity"], "left_anti")
    return equal.unionByName(mail).unionByName(cart).unionByName(files.select("task", F.lit("file_exists").alias("type"), F.col("entity").alias("path"), F.lit(None).cast("string").alias("value")))


def merged_or_error(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Two key-value tables as one, with `error` "conflict" where both have a key with unequal values."""
    x, y = a.select(key, F.col(value).alias("_a"), F.lit(1).alias("_x")), b.select(key, F.col(value).alias("_b"), F.lit(1).alias("_y"))
    clash = F.col("_x").isNotNull() & F.col("_y").isNotNull() & ~F.col("_a").eqNullSafe(F.col("_b"))
    return x.join(y, key, "full_outer").select(key, F.when(F.col("_x").isNotNull(), F.col("_a")).otherwise(F.col("_b")).alias(value), F.when(clash, "conflict").alias("error"))


def merged_rollouts(samples: DataFrame, stats: DataFrame, key: str, n: int) -> DataFrame:
    """Every prompt n times with its number, and with its rollout's statistics where they are known."""
    return samples.withColumn("rollout", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).join(stats, [key, "rollout"], "left")


def experiment_record(train: DataFrame, val: DataFrame, domain: str, scenario: str, requested: int) -> DataFrame:
    """One row: sizes, the yield of what was requested, and the shares of domains and scenarios as JSON, for a record beside a dataset."""
    both = train.select(domain, scenario).withColumn("_v", F.lit(0)).unionByName(val.select(domain, scenario).withColumn("_v", F.lit(1)))
    size = both.agg(F.coalesce(F.sum(1 - F.col("_v")), F.lit(0)).alias("train"), F.coalesce(F.sum("_v"), F.lit(0)).alias("val"))
    shares = lambda c: both.groupBy(c).agg(F.count(F.lit(1)).alias("_n")).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce(F.col(c), F.lit("unknown")), "_n"))))).alias(f"{c}s"))
    out = size.crossJoin(F.broadcast(shares(domain))).crossJoin(F.broadcast(shares(scenario)))
    return out.withColumn("yield", (F.col("train") + F.col("val")) / requested)


def write_traces(traces: DataFrame, path: str, task: str) -> None:
    """One JSON document a trace, in a folder a task."""
    traces.withColumn("_task", F.col(task)).write.partitionBy("_task").mode("append").json(path)
