"""Tasks by their traces of calls: signatures, identities, and the greedy scan for near duplicates.

A trace is an array of calls (action, tool_name, arguments as JSON text). Its signature names place, tool and
arguments of each call, so order and repetition count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.relational import greedy_keep, jaccard_pairs
from weftline.session import checkpointed

#: Fixed value: from this similarity on a task counts as a duplicate of an earlier one.
LEAST = 0.70


def tool_calls(calls: Column) -> Column:
    """The calls of tools; a missing action is one."""
    return F.filter(F.coalesce(calls, F.array().cast("array<struct<action:string,tool_name:string,arguments:string>>")), lambda c: F.coalesce(c["action"], F.lit("tool_call")) == "tool_call")


def signatures(calls: Column, original: Column | None = None) -> Column:
    """One text a tool call: its place from 0, tool, and sorted key=value pairs, parted by control characters.

    Where there is no tool call, the original calls of the task count. Values are texts, nested ones canonical JSON; arguments
    that are no JSON object count as none.
    """
    used = tool_calls(calls) if original is None else F.when(F.size(tool_calls(calls)) > 0, tool_calls(calls)).otherwise(tool_calls(original))

    def pairs(arguments: Column) -> Column:
        values = F.try_variant_get(F.try_parse_json(arguments), F.lit("$"), "map<string,variant>")
        entries = F.map_entries(F.coalesce(values, F.expr("cast(map() as map<string,variant>)")))
        text = lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, F.lit("$"), "string")).otherwise(F.to_json(v))
        return F.array_sort(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), text(e["value"]))))

    return F.transform(used, lambda c, i: F.concat_ws("\x1e", i.cast("string"), F.coalesce(c["tool_name"], F.lit("")), F.array_join(pairs(c["arguments"]), "\x1f")))


def spaced_json(text: Column) -> Column:
    """JSON with sorted keys and a space after commas and colons outside strings (fixed format); null for what doesn't parse."""
    canonical = F.to_json(F.try_parse_json(text))
    return F.regexp_replace(canonical, r'\G((?:[^",:]|"(?:[^"\\]|\\.)*+")*+)([,:])', "$1$2 ")


def _quoted(text: Column) -> Column:
    """A text as a JSON string."""
    return F.substring(F.to_json(F.struct(text.alias("x"))), 6, 2**31 - 1).substr(F.lit(1), F.length(F.to_json(F.struct(text.alias("x")))) - 6)


def fingerprint(domain: Column, scenario: Column, query: Column, calls: Column) -> Column:
    """The SHA-256 of a task's identity: JSON of its tool calls, domain, query (lower case, single spaces) and scenario, in a fixed format."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(query, F.lit(""))), r"\s+", " "))
    each = F.transform(tool_calls(calls), lambda c: F.concat(
        F.lit('{"arguments": '), F.coalesce(spaced_json(c["arguments"]), F.lit("{}")), F.lit(', "tool_name": '), _quoted(F.coalesce(c["tool_name"], F.lit(""))), F.lit("}")))
    payload = F.concat(
        F.lit('{"calls": ['), F.array_join(each, ", "), F.lit('], "domain": '), _quoted(F.coalesce(domain, F.lit(""))), F.lit(', "query": '), _quoted(plain),
        F.lit(', "scenario": '), _quoted(F.coalesce(scenario, F.lit(""))), F.lit("}"))
    return F.sha2(payload, 256)


def similar_traces(tasks: DataFrame, key: str, domain: str, signature: str, least: float = LEAST) -> tuple[DataFrame, DataFrame]:
    """(first, pairs): the first task of each (domain, signature), and the pairs of them that are similar.

    Tasks of equal signatures are one in the search, so a large group of equal traces makes no pairs. Places are part of the
    tokens, so the prefix index is one by place. Tasks without calls have no pairs.
    """
    whole = F.sha2(F.array_join(signature, "\x1d"), 256)
    some = tasks.where(F.size(signature) > 0).withColumn("_whole", whole)
    first = checkpointed(some.groupBy(domain, "_whole").agg(F.min_by(F.struct(key, signature), key).alias("_r")).select(domain, "_r.*"))
    return first, jaccard_pairs(first, key, domain, signature, least)


def without_similar(tasks: DataFrame, key: str, domain: str, signature: str, least: float = LEAST) -> DataFrame:
    """The tasks that a scan in key order keeps, where a task goes if a kept earlier one of its domain is similar.

    Tasks without calls are similar to nothing and stay. A task that repeats an earlier trace goes whatever became of that
    one: it stays, or a kept task similar to it is similar to both. Keys tell tasks apart; a null domain is a domain.
    """
    # signatures cost much more to make than to keep, so they are made once
    known = checkpointed(tasks.select(key, F.coalesce(F.concat(F.lit("d"), F.col(domain).cast("string")), F.lit("")).alias("_domain"), signature))
    first, pairs = similar_traces(known, key, "_domain", signature, least)
    kept = greedy_keep(first.select(key), key, pairs).select(key)
    empty = known.where(F.coalesce(F.size(signature), F.lit(0)) <= 0).select(key)
    return tasks.join(kept.unionByName(empty), key, "left_semi")


def audited(tasks: DataFrame, key: str, identity: str) -> DataFrame:
    """(identity, tasks, first): how many tasks have one identity, and the first of them; aggregates only, so a hot identity is no burden."""
    return tasks.groupBy(identity).agg(F.count(F.lit(1)).alias("tasks"), F.min(key).alias("first"))
