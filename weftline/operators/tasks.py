"""Tasks and their oracle calls: criteria from state changes, progress, targets, protection, audits and perturbations.

Calls are rows (task, i, action, tool_name, arguments): i orders them, arguments is a
map of texts. States are rows (task, container, entity, field, value). Rows without a
tool count as end actions. Every operator is a join, window or aggregate by task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the rules, in the order in which they apply.
ENTITIES = (
    "event", "order", "account", "email", "invoice", "issue", "lead", "deal", "product", "restaurant", "channel", "message", "file", "contact",
    "payment", "menu", "cart", "transfer", "transaction",
)
READS = ("list_", "search_", "get_", "find_", "check_", "lookup_", "view_", "browse_", "ls", "cat", "stat", "head", "tail")
CHANGES = (
    "create_", "update_", "delete_", "remove_", "add_", "send_", "transfer", "pay_", "checkout", "transition_", "convert_", "archive_", "mkdir", "touch",
    "mv", "cp", "chmod", "write_", "set_", "apply_",
)
DELETES = ("delete_", "remove_", "cancel_", "clear_", "archive_", "rm")
STATUS_FIELDS = ("status", "stage", "type", "state")
TARGET_KEYS = ("path", "source", "destination", "from_account", "to_account")
ENDS = ("final_answer", "ask_clarification", "report_error")
ABSTAINING = ("missing_function", "irrelevant", "no_tool_or_abstention")
IDENTITY = {
    "calendar": "preserve", "banking": "preserve", "filesystem": "domain_defined", "payments": "preserve", "crm": "preserve", "issue_tracker": "preserve",
    "email": "append_only", "team_chat": "append_only", "shopping": "create_new", "food_delivery": "create_new",
}
READ_WORDS = (
    "list", "check", "view", "get", "find", "search", "look up", "lookup", "confirm", "status", "details", "schedule", "agenda", "calendar", "history",
    "balance", "track", "report", "summary",
)
QUESTION_WORDS = ("what", "what's", "whats", "which", "who", "when", "where", "show")
#: A tool of one of these prefixes is asked for by one of these words.
WRITE_WORDS = (
    (("create_", "mkdir", "touch"), ("create", "make", "new", "book", "draft", "register", "open")),
    (("update_", "edit_", "change_", "set_", "mark_", "transition_", "assign_", "complete_", "time_track"),
     ("update", "edit", "change", "modify", "set", "mark", "move", "reschedule", "rename", "assign", "complete", "transition", "log")),
    (("delete_", "remove_", "rm", "cancel_", "archive_", "clear_"), ("delete", "remove", "cancel", "archive", "clear", "drop")),
    (("add_", "apply_", "react_", "rate_"), ("add", "apply", "attach", "invite", "react", "rate", "review", "label")),
    (("send_", "reply_", "forward_", "pay_", "refund_", "transfer", "wire_", "checkout", "return_", "reorder", "deposit", "withdraw", "freeze_", "unfreeze_", "convert_"),
     ("send", "reply", "forward", "pay", "refund", "transfer", "wire", "checkout", "return", "reorder", "deposit", "withdraw", "freeze", "unfreeze", "convert")),
)


def starts(text: Column, prefixes: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, prefixes)), lambda p: F.lower(text).startswith(p))


def says(text: Column, words: tuple[str, ...]) -> Column:
    """Whether a text holds one of the words, without case, anywhere in it."""
    low = F.lower(text)
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))


def tool_entity(name: Column) -> Column:
    """The kind of thing a tool is about: the first known kind in its name, else its last word."""
    known = F.filter(F.array(*map(F.lit, ENTITIES)), lambda e: F.contains(name, e))
    return F.coalesce(F.get(known, F.lit(0)), F.substring_index(name, "_", -1))


def read_intent(query: Column) -> Column:
    return says(query, READ_WORDS)


def write_intent(query: Column, tool: Column) -> Column:
    """Whether a query asks for a writing tool: by the words of its prefix, else by every longer word of its name."""
    text = F.replace(F.lower(query), F.lit("_"), F.lit(" "))
    words = F.filter(F.split(F.lower(tool), "_| "), lambda w: F.length(w) > 2)
    out = (F.size(words) > 0) & F.forall(words, lambda w: F.contains(text, w))
    for prefixes, marks in reversed(WRITE_WORDS):
        out = F.when(starts(tool, prefixes), says(text, marks)).otherwise(out)
    return out


def needed_tool(query: Column, tool: Column, called: Column, mutating: Column) -> Column:
    """Whether hiding a tool makes a task impossible: it was called, and if it writes the query asks for that."""
    return called & (~mutating | write_intent(query, tool))


def derived_criteria(before: DataFrame, after: DataFrame) -> DataFrame:
    """(task, type, path, value): what a final state must show, by its difference from the first one.

    A new entity must exist, with its status fields; a lost one must be absent; a
    changed field of an entity in both must have its new value. Null values say nothing;
    containers that the first state lacks are left out.
    """
    key, part = ["task", "container", "entity"], ["task", "container", "entity", "field"]
    old = before.groupBy(*key).agg(F.lit(1).alias("_o"))
    new = after.groupBy(*key).agg(F.lit(1).alias("_n"))
    known = before.select("task", "container").distinct().join(after.select("task", "container").distinct(), ["task", "container"])
    path = F.concat_ws(".", "container", "entity")
    there = old.join(new, key, "full_outer").join(known, ["task", "container"], "left_semi")
    whole = there.where("_o is null or _n is null").select("task", F.when(F.col("_o").isNull(), "state_exists").otherwise("state_absent").alias("type"), path.alias("path"), F.lit(None).cast("string").alias("value"))
    fields = after.where("value is not null").join(before.select(*part, F.col("value").alias("_was"), F.lit(1).alias("_had")), part, "left").join(old, key, "left").join(known, ["task", "container"], "left_semi")
    fresh = F.col("_o").isNull() & F.col("field").isin(*STATUS_FIELDS)
    moved = F.col("_had").isNotNull() & ~F.col("_was").eqNullSafe(F.col("value"))
    return whole.unionByName(fields.where(fresh | moved).select("task", F.lit("state_equals").alias("type"), F.concat_ws(".", path, "field").alias("path"), "value"))


def progress_predicates(calls: DataFrame) -> DataFrame:
    """(task, step, type, entity, target): progress that the calls of a task make; steps count its tool calls from 0.

    The first read of each kind of entity resolves it; changes complete a transition
    of their target; a call on the kind of the one before it satisfies a dependency;
    the last end action verifies and answers. Tasks without tool calls make none.
    """
    w = Window.partitionBy("task").orderBy("i")
    real = calls.where("action = 'tool_call'").withColumns({"step": F.row_number().over(w) - 1, "entity": tool_entity(F.col("tool_name"))})
    real = real.withColumns({"_reads": starts(F.col("tool_name"), READS), "_before": F.lag("entity").over(w)})
    nth = F.row_number().over(Window.partitionBy("task", "entity", "_reads").orderBy("i"))
    real = real.withColumn("_nth", nth)
    key = F.get(F.filter(F.map_entries("arguments"), lambda a: (F.contains(F.lower(a["key"]), F.lit("_id")) | F.lower(a["key"]).isin("path", "event_id")) & a["value"].isNotNull()), F.lit(0))
    found = F.filter(F.array(
        F.struct(F.when(F.col("_reads") & (F.col("_nth") == 1), F.lit("resolved_required_entity")).alias("type"), F.lit(None).cast("string").alias("target")),
        F.struct(F.when(starts(F.col("tool_name"), CHANGES), F.lit("completed_required_transition")).alias("type"), F.coalesce(key["value"], F.lit("")).alias("target")),
        F.struct(F.when(F.col("entity") == F.col("_before"), F.lit("satisfied_dependency_edge")).alias("type"), F.lit(None).cast("string").alias("target")),
    ), lambda p: p["type"].isNotNull())
    steps = real.select("task", "step", "entity", F.explode(found).alias("p")).select("task", "step", "p.type", "entity", "p.target")
    ends = calls.groupBy("task").agg(F.sum((F.col("action") == "tool_call").cast("int")).alias("n"), F.max((F.col("action") != "tool_call").cast("int")).alias("ended")).where("n > 0 and ended = 1")
    last = ends.select("task", F.col("n").cast("int").alias("step"), F.explode(F.array(F.lit("verified_postcondition"), F.lit("produced_required_response"))).alias("type"), F.lit(None).cast("string").alias("entity"), F.lit(None).cast("string").alias("target"))
    return steps.unionByName(last)


def target_ids(calls: DataFrame, deleting: bool = False) -> DataFrame:
    """(task, id): what the arguments of a task's calls name, by keys that end in _id or are paths and accounts; with `deleting` those of deleting tools only."""
    tools = calls.where(starts(F.col("tool_name"), DELETES)) if deleting else calls
    key = F.lower("a.key")
    named = tools.select("task", F.explode(F.map_entries("arguments")).alias("a")).where(key.endswith("_id") | key.isin(*TARGET_KEYS))
    return named.where("a.value <> ''").select("task", F.col("a.value").alias("id")).distinct()


def protected_fields(state: DataFrame, targets: DataFrame, criteria: DataFrame) -> DataFrame:
    """(task, entity, field): fields of targeted entities that no criterion intends to change and that are no ids.

    Input: targets (task, id), criteria (task, path).
    """
    # every part of a path may be an id, so targets are met by (task, part) and not by all criteria of their task; the key is a
    # struct, as Spark would carry a filter on the targets' ids, which may fail on other texts, over to the parts of a plain key
    meet = F.struct("task", "id").alias("_k")
    parts = criteria.select("task", F.substring_index("path", ".", -1).alias("field"), F.explode(F.array_distinct(F.split("path", "[.]"))).alias("id")).where(F.col("id") != F.col("field"))
    intended = parts.withColumn("_k", meet).join(targets.select(meet), "_k", "left_semi").select("task", F.col("id").alias("entity"), "field").distinct()
    held = state.join(targets.withColumnRenamed("id", "entity"), ["task", "entity"], "left_semi").where(~F.col("field").endswith("_id"))
    return held.select("task", "entity", "field").distinct().join(intended, ["task", "entity", "field"], "left_anti")


def training_oracle(calls: DataFrame) -> DataFrame:
    """The calls a task trains on: its tool calls and its last end action. Tasks without one have the column `error` set and no other rows."""
    w = Window.partitionBy("task")
    end = F.col("action").isin(*ENDS)
    marked = calls.withColumns({"_last": F.max(F.when(end, F.col("i"))).over(w), "_k": F.row_number().over(w.orderBy("i"))})
    kept = marked.where(F.when(F.col("_last").isNull(), F.col("_k") == 1).otherwise((F.col("action") == "tool_call") | (F.col("i") == F.col("_last"))))
    return kept.withColumn("error", F.when(F.col("_last").isNull(), F.lit("no_terminal"))).drop("_last", "_k")


def task_scenario(scenario: Column, kind: Column) -> Column:
    """The stated scenario, else abstention for tasks made to lack a tool or to be beside the point, else normal."""
    return F.coalesce(F.nullif(scenario, F.lit("")), F.when(kind.isin("missing_function", "irrelevant"), "no_tool_or_abstention").otherwise("normal_safe_success"))


def identity_policy(domain: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in IDENTITY.items() for x in kv]), domain), F.lit("domain_defined"))


def chosen_criteria(program: Column, task: Column) -> Column:
    """The program's criteria unless it has none, else the task's."""
    return F.when(F.coalesce(F.size(program), F.lit(0)) > 0, program).otherwise(F.coalesce(task, F.slice(program, F.lit(1), F.lit(0))))


def task_checks(tasks: DataFrame) -> DataFrame:
    """(task and one flag a check) for tasks with calls, an array of (tool_name, arguments, action), and columns
    scenario, method, missing (flag), hidden (array), query, rounds. True means the check is passed."""
    real = F.filter("calls", lambda c: c["action"] == "tool_call")
    abstains = (F.size(real) == 0) & (F.size("calls") == 1) & (F.get("calls", F.lit(0))["action"] == "report_error")
    keyed = F.transform(real, lambda c: F.concat_ws("|", c["tool_name"], F.to_json(F.array_sort(F.map_entries(c["arguments"])))))
    writes = F.exists("hidden", lambda t: starts(t, tuple(p for prefixes, _ in WRITE_WORDS for p in prefixes)))
    words = tuple(dict.fromkeys(w for _, marks in WRITE_WORDS for w in marks if w != "open"))
    text = F.replace(F.lower("query"), F.lit("_"), F.lit(" "))
    only_reads = says(text, (*READ_WORDS, *QUESTION_WORDS)) & ~says(text, words)
    none_due = F.col("scenario").isin(*ABSTAINING)
    checks = {
        "chain_length": F.size(real) <= 5,
        "abstains": ~none_due | abstains,
        "named": F.forall("calls", lambda c: c["tool_name"].isNotNull() & (c["tool_name"] != "")),
        "distinct_calls": F.size(keyed) == F.size(F.array_distinct(keyed)),
        "missing_flag": F.when(F.col("method") == "irrelevant_template", ~F.col("missing")).otherwise(F.col("scenario").isin("missing_function", "no_tool_or_abstention") == F.col("missing")),
        "semantic": ~(F.col("missing") & F.col("scenario").isin("missing_function", "no_tool_or_abstention") & writes & only_reads),
        "rounds": F.col("rounds").between(1, 5),
    }
    return tasks.select("task", *[F.coalesce(c, F.lit(False)).alias(k) for k, c in checks.items()])


def dataset_checks(tasks: DataFrame, validation: DataFrame, required: tuple[str, ...] = ("normal_safe_success", "no_tool_or_abstention")) -> DataFrame:
    """One row: whether validation covers the required scenarios and has a task of one round, and whether there are domains enough."""
    v = validation.agg(F.count(F.lit(1)).alias("n"), F.collect_set(F.when(F.col("scenario").isin(*required), F.col("scenario"))).alias("s"), F.max((F.col("rounds") == 1).cast("int")).alias("one"))
    d = tasks.agg(F.countDistinct("domain").alias("domains"))
    return v.crossJoin(F.broadcast(d)).select(((F.col("n") == 0) | (F.size("s") == len(required))).alias("scenarios"), ((F.col("n") == 0) | (F.col("one") == 1)).alias("single_round"), (F.col("domains") >= 1).alias("domain_cover"), "domains")


def minimal_arguments(kind: Column, allowed: Column) -> Column:
    """A valid value of a parameter, as text: the first allowed one, else an empty one of its type."""
    return F.coalesce(F.get(allowed, F.lit(0)), F.when(kind.isin("integer", "number"), "0").when(kind == "boolean", "false").when(kind == "array", "[]").when(kind == "object", "{}").otherwise(""))


def schema_edges(tools: DataFrame) -> DataFrame:
    """(src, dst, relation): explicit where an output field of src is a required parameter of dst; implicit within a kind of entity, from tools without explicit edges.

    Input: tool, outputs and required (arrays of names). Tools meet on shared names only.
    """
    made = tools.select(F.col("tool").alias("src"), F.explode("outputs").alias("name"))
    used = tools.select(F.col("tool").alias("dst"), F.explode("required").alias("name"))
    explicit = made.join(used, "name").where("src <> dst").select("src", "dst").distinct()
    kinds = tools.select("tool", tool_entity(F.col("tool")).alias("entity"))
    idle = kinds.join(explicit.select(F.col("src").alias("tool")).distinct(), "tool", "left_anti").withColumnRenamed("tool", "src")
    implicit = idle.join(kinds.withColumnRenamed("tool", "dst"), "entity").where("src <> dst").select("src", "dst")
    return explicit.withColumn("relation", F.lit("explicit")).unionByName(implicit.withColumn("relation", F.lit("implicit")))


#: Tools of a registry at most; it is a catalogue, not data, and is broadcast.
REGISTRY = 10_000


def catalogue(registry: DataFrame) -> DataFrame:
    """A registry to broadcast; an error if it is larger than a catalogue may be."""
    n = registry.count()
    if n > REGISTRY:
        raise ValueError(f"a registry of {n} rows is more than {REGISTRY}")
    return F.broadcast(registry)


def routed(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """Each call (id, tool, domain, keys) with the server of its tool, null for an unknown one.

    Of several servers the one of the call's domain, else the first (by `nth`) whose
    required parameters are all given, else the first. Input of schemas: tool, server, required, nth.
    """
    met = calls.join(catalogue(schemas), "tool", "left")
    fits = F.size(F.array_except("required", "keys")) == 0
    order = Window.partitionBy("id").orderBy(F.when(F.col("server") == F.col("domain"), 0).when(fits, 1).otherwise(2), "nth")
    return met.withColumn("_k", F.row_number().over(order)).where("_k = 1").select("id", "tool", "server")


def fuzzy_matches(names: DataFrame, valid: DataFrame) -> DataFrame:
    """(raw, tool): the closest valid name: equal without case, without a final s, one within the other, or by shared words (all but one).

    `valid` (tool) is a registry; each distinct name meets it once.
    """
    known = catalogue(valid)
    raw, tool = F.lower("raw"), F.lower("tool")
    words = lambda c: F.array_distinct(F.filter(F.split(c, "_| "), lambda w: w != ""))
    shared = F.size(F.array_intersect(words(raw), words(tool)))
    rank = F.when(raw == tool, 0).when(raw == F.concat(tool, F.lit("s")), 1).when(F.contains(tool, raw) | F.contains(raw, tool), 2).when(shared >= F.greatest(F.lit(1), F.size(words(raw)) - 1), 3)
    met = names.select("raw").distinct().crossJoin(known).withColumns({"_r": rank, "_w": shared}).where("_r is not null")
    best = F.row_number().over(Window.partitionBy("raw").orderBy("_r", F.desc("_w"), "tool"))
    return met.withColumn("_k", best).where("_k = 1").select("raw", "tool")


def without_last_tool(tasks: DataFrame) -> DataFrame:
    """Tasks (task, query, calls, required) made impossible: the tool of the last call is hidden and the oracle becomes one report_error.

    A tool that isn't required by the query stays, and so does the task, with hidden null.
    """
    real = F.filter("calls", lambda c: c["action"] == "tool_call")
    last = F.try_element_at(real, F.lit(-1))["tool_name"]
    tool = F.when(F.array_contains("required", last), last).otherwise(F.try_element_at("required", F.lit(-1)))
    hide = (F.size("required") > 0) & needed_tool(F.col("query"), tool, F.exists(real, lambda c: c["tool_name"] == tool), starts(tool, CHANGES))
    out = tasks.withColumn("hidden", F.when(hide, tool))
    end = F.array(F.struct(F.lit("report_error").alias("tool_name"), F.create_map(F.lit("text"), F.concat(F.lit("Required tool '"), F.col("hidden"), F.lit("' is unavailable."))).alias("arguments"), F.lit("report_error").alias("action")))
    return out.withColumns({"calls": F.when(F.col("hidden").isNull(), F.col("calls")).otherwise(end), "scenario": F.when(F.col("hidden").isNotNull(), "no_tool_or_abstention").otherwise("normal_safe_success")})


def with_distractors(tasks: DataFrame, registry: DataFrame, least: int = 3, most: int = 8) -> DataFrame:
    """(task, tool): 3 to 8 tools that a task doesn't know, as many as a hash of its id says, in the order of a hash of id and tool.

    The registry (tool) is a bounded catalogue; it is packed in one row and each task draws within its own row.
    """
    packed = catalogue(registry.select("tool").distinct()).agg(F.array_sort(F.collect_set("tool")).alias("_all"))
    n = least + F.pmod(F.conv(F.substring(F.md5("task"), 1, 8), 16, 10).cast("bigint"), F.lit(most - least + 1)).cast("int")
    drawn = F.array_sort(F.transform(F.array_except("_all", "known"), lambda t: F.struct(F.md5(F.concat("task", F.lit(":"), t)).alias("h"), t.alias("t"))))
    return tasks.crossJoin(F.broadcast(packed)).select("task", F.explode(F.slice(drawn, F.lit(1), n)).alias("x")).select("task", F.col("x.t").alias("tool"))


def deletable(entities: DataFrame, key: str, references: DataFrame, foreign: str) -> DataFrame:
    """Entities with `error` "referenced" where rows of another table name them, else null."""
    used = references.where(F.col(foreign).isNotNull()).select(F.col(foreign).alias(key)).distinct().withColumn("_u", F.lit(1))
    return entities.join(used, key, "left").withColumn("error", F.when(F.col("_u") == 1, "referenced")).drop("_u")


def stats_report(tasks: DataFrame, *axes: str) -> DataFrame:
    """Counts over all axes together, over each alone and in all, in one pass of grouping sets; null stands for all."""
    return tasks.cube(*axes).agg(F.count(F.lit(1)).alias("n"), F.sum((F.coalesce(F.size("criteria"), F.lit(0)) == 0).cast("long")).alias("empty_criteria"))


def trace_summary(traces: DataFrame, session: str, error: str, tool: str) -> DataFrame:
    """One row over traces: sessions, calls, errors, distinct tools, sessions with an error."""
    by = traces.groupBy(session).agg(F.count(F.lit(1)).alias("calls"), F.sum(F.col(error).cast("long")).alias("errors"))
    tools = traces.agg(F.countDistinct(tool).alias("tools"))
    return by.agg(F.count(F.lit(1)).alias("sessions"), F.sum("calls").alias("calls"), F.sum("errors").alias("errors"), F.sum((F.col("errors") > 0).cast("long")).alias("failed_sessions")).crossJoin(F.broadcast(tools))


def chain_progress(names: Column, chain: Column) -> Column:
    """How many tools of a chain are met in order, with others between."""
    return F.aggregate(names, F.lit(0), lambda at, x: F.when(F.get(chain, at) == x, at + 1).otherwise(at))


def batch_diagnosis(df: DataFrame, uid: str) -> DataFrame:
    """One row: groups, the most frequent group size (of equal ones the smaller) and how many groups have another."""
    sizes = df.groupBy(uid).agg(F.count(F.lit(1)).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("g"))
    best = sizes.agg(F.max_by("n", F.struct("g", -F.col("n"))).alias("modal"), F.sum("g").alias("groups"))
    return sizes.crossJoin(F.broadcast(best)).groupBy("modal", "groups").agg(F.sum(F.when(F.col("n") != F.col("modal"), F.col("g")).otherwise(0)).alias("incomplete"))


def tree_listing(files: DataFrame, depth: int, path: str = "path") -> DataFrame:
    """(folder, depth, files): every folder down to a depth, with the files below it."""
    parts = F.split(F.ltrim(F.col(path), F.lit("/")), "/")
    ups = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(depth))), lambda i: F.struct(F.array_join(F.slice(parts, F.lit(1), i), "/").alias("folder"), i.alias("depth")))
    return files.select(F.explode(ups).alias("f")).groupBy("f.folder", "f.depth").agg(F.count(F.lit(1)).alias("files"))
