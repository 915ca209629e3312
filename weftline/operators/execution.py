"""What the execution of a logged tool call comes to: a ladder of checks as columns, over calls, a catalogue of tools and a log of responses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.contracts import member, members, rule_errors, schema_rules
from weftline.operators.tasks import catalogue, routed

# Types of errors and the messages of the checks.
UNKNOWN, INVALID, UNAVAILABLE, FAILED, PRECONDITION = "unknown_tool", "schema_invalid", "server_unavailable", "execution_error", "precondition_failed"
BLOCKED_TEXT, UNKNOWN_TEXT, INVALID_TEXT, NO_SERVER_TEXT = "tool blocked (missing function)", "unknown tool", "schema validation failed", "tool has no server"


def executed(calls: DataFrame, tools: DataFrame, responses: DataFrame) -> DataFrame:
    """id, tool, server, success, observation, error_type, error_message, schema_valid and state_changed of each call.

    The first that holds decides: the tool is blocked for the task; it is unknown; its arguments don't fit its schema; no server has
    it; the transport failed; the server lacks the tool; the handler raised (a missing key means that a
    precondition failed, all else an execution error); else the handler's response.

    calls: id, tool, domain, arguments (JSON text), blocked (array). tools: tool, server (null: none), schema (JSON text), nth, a catalogue of
    a bounded size; of several servers a call goes to that of its domain, else to the first whose required arguments are there.
    responses: id, success, observation, error_type, error_message, state_changed, and transport, handled and raised (kind of exception), at most
    one a call; calls without one have failed in the transport. Errors are columns: nothing raises.
    """
    parsed = F.try_parse_json("arguments")
    keys = F.map_keys(F.coalesce(F.try_variant_get(parsed, F.lit("$"), "map<string,variant>"), F.expr("cast(map() as map<string,variant>)")))
    text = lambda v: F.try_variant_get(v, F.lit("$"), "string")
    schema = F.try_parse_json("schema")
    required = F.transform(members(member(F.coalesce(member(schema, F.lit("input_schema")), member(schema, F.lit("parameters"))), F.lit("required"))), text)
    named = tools.select("tool", F.coalesce("server", F.lit("")).alias("server"), "schema", required.alias("required"), "nth")
    routes = routed(calls.select("id", "tool", "domain", keys.alias("keys")), named).select("id", "server")
    known = calls.join(routes, "id").join(catalogue(named.select("tool", "server", schema_rules(F.col("schema")).alias("rules"))), ["tool", "server"], "left")
    known = known.withColumn("_e", rule_errors(F.coalesce("arguments", F.lit("{}")), F.col("rules")))
    there = responses.select(F.col("id"), *[F.col(c).alias(f"_{c}") for c in ("success", "observation", "error_type", "error_message", "state_changed", "transport", "handled", "raised")], F.lit(True).alias("_answered"))
    r = known.join(there, "id", "left")
    blocked, unknown = F.coalesce(F.array_contains("blocked", F.col("tool")), F.lit(False)), F.col("server").isNull()
    invalid, nowhere = ~F.col("_e.valid"), F.col("server") == ""
    cut = F.col("_answered").isNull() | F.col("_transport").isNotNull()
    lacking, raised = ~F.coalesce("_handled", F.lit(True)), F.col("_raised").isNotNull()
    ok = F.coalesce("_success", F.lit(False))
    ladder = lambda *values: F.when(blocked, values[0]).when(unknown, values[1]).when(invalid, values[2]).when(nowhere, values[3]).when(cut, values[4]).when(lacking, values[5]).when(raised, values[6]).otherwise(values[7])
    no, none, yes = F.lit(False), F.lit(None).cast("string"), F.lit(True)
    details = F.to_json(F.struct(F.col("_e.missing").alias("missing_required"), F.col("_e.unexpected").alias("unexpected_keys"), F.col("_e.type_errors").alias("type_errors"), F.col("_e.enum_errors").alias("enum_errors")))
    unavailable = F.to_json(F.struct(F.concat(F.lit("Tool '"), F.col("tool"), F.lit("' is not available for this task")).alias("error")))
    message = F.coalesce("_error_message", F.lit(""))
    return r.select(
        "id", "tool", F.nullif("server", F.lit("")).alias("server"), ladder(no, no, no, no, no, no, no, ok).alias("success"),
        ladder(unavailable, none, details, none, none, none, none, F.col("_observation")).alias("observation"),
        ladder(F.lit(UNKNOWN), F.lit(UNKNOWN), F.lit(INVALID), F.lit(UNAVAILABLE), F.coalesce("_transport", F.lit(UNAVAILABLE)), F.lit(UNKNOWN), F.when(F.col("_raised") == "KeyError", PRECONDITION).otherwise(FAILED), F.when(~ok, F.coalesce(F.nullif("_error_type", F.lit("")), F.lit(FAILED)))).alias("error_type"),
        ladder(F.lit(BLOCKED_TEXT), F.lit(UNKNOWN_TEXT), F.lit(INVALID_TEXT), F.lit(NO_SERVER_TEXT), message, F.concat(F.lit("unknown tool: "), F.col("tool")), message, message).alias("error_message"),
        ladder(no, no, no, yes, yes, yes, yes, yes).alias("schema_valid"), ladder(no, no, no, no, no, no, no, F.coalesce("_state_changed", no)).alias("state_changed"),
    )


def sizes(df: DataFrame) -> DataFrame:
    """(column, rows, bytes): what each column holds: the bytes of texts and binaries, eight a number, nested values as JSON."""
    def width(name: str, kind: str):
        c = F.col(f"`{name}`")
        fixed = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "float": 4, "date": 4, "bigint": 8, "double": 8, "timestamp": 8, "timestamp_ntz": 8}
        if kind in fixed:
            return F.when(c.isNotNull(), fixed[kind]).otherwise(0)
        plain = c if kind in ("string", "binary") else F.to_json(F.struct(c.alias("v")))
        return F.coalesce(F.octet_length(plain) - (0 if kind in ("string", "binary") else 6), F.lit(0))

    one = df.agg(F.count(F.lit(1)).alias("rows"), *[F.sum(width(n, k)).cast("bigint").alias(f"b{i}") for i, (n, k) in enumerate(df.dtypes)])
    return one.select("rows", F.explode(F.array(*[F.struct(F.lit(n).alias("column"), F.coalesce(f"b{i}", F.lit(0)).alias("bytes")) for i, n in enumerate(df.columns)])).alias("c")).select("c.column", "rows", "c.bytes")


def overridden_edges(edges: DataFrame, cached: DataFrame) -> DataFrame:
    """Edges (server, source, target, relation) with those of a cached graph in place of a server's own.

    cached: server and graph, a JSON text of tools with lists `explicit` and `implicit`; a graph that isn't of this shape, or empty, counts as none.
    """
    v = F.try_parse_json("graph")
    tools = F.try_variant_get(v, F.lit("$"), "map<string,variant>")
    shaped = F.coalesce((F.size(tools) > 0) & F.forall(F.map_values(tools), lambda t: member(t, F.lit("explicit")).isNotNull() & member(t, F.lit("implicit")).isNotNull()), F.lit(False))
    good = cached.where(shaped).select("server", F.explode(tools).alias("source", "t"))
    listed = lambda relation: F.transform(members(member(F.col("t"), F.lit(relation))), lambda x: F.struct(F.try_variant_get(x, F.lit("$"), "string").alias("target"), F.lit(relation).alias("relation")))
    ours = good.select("server", "source", F.explode(F.concat(listed("explicit"), listed("implicit"))).alias("e")).select("server", "source", "e.target", "e.relation")
    return edges.join(cached.where(shaped).select("server").distinct(), "server", "left_anti").select("server", "source", "target", "relation").unionByName(ours)
