"""Predicates on tasks, arguments and states; free-form values are VARIANT or JSON texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.arrays import let
from weftline.operators.tasks import ENTITIES, tool_entity


def type_matches(value: Column, kind: Column) -> Column:
    """Whether a JSON text's value has a JSON type, or one of several named as a JSON list; a boolean is no integer and an integer is a number."""
    v = F.try_parse_json(value)
    found = F.schema_of_variant(v)
    whole = found.isin("BIGINT", "INT", "SMALLINT", "TINYINT") | found.rlike(r"^DECIMAL\(\d+,0\)$")
    number = whole | found.isin("DOUBLE", "FLOAT") | found.startswith("DECIMAL")
    names = F.coalesce(F.from_json(kind, "array<string>"), F.array(kind))
    fits = lambda k: (
        F.when(k == "string", found == "STRING").when(k == "integer", whole).when(k == "number", number).when(k == "boolean", found == "BOOLEAN")
        .when(k == "object", found.startswith("OBJECT")).when(k == "array", found.startswith("ARRAY")).when(k == "null", found == "VOID").otherwise(F.lit(False))
    )
    return F.exists(names, fits)


def argument_errors(arguments: Column, properties: Column, required: Column, enums: Column) -> Column:
    """missing, unexpected, type_errors and enum_errors of a map of JSON texts against maps of types and allowed values."""
    keys = F.map_keys(arguments)
    known = F.array_intersect(keys, F.map_keys(properties))
    typed = F.filter(known, lambda k: ~F.coalesce(type_matches(F.element_at(arguments, k), F.element_at(properties, k)), F.lit(False)))
    outside = F.filter(F.array_intersect(known, F.map_keys(enums)), lambda k: ~F.array_contains(F.element_at(enums, k), F.element_at(arguments, k)))
    return F.struct(
        F.array_except(required, keys).alias("missing"), F.array_except(keys, F.map_keys(properties)).alias("unexpected"), typed.alias("type_errors"), outside.alias("enum_errors")
    )


def schema_rules(schema: Column) -> Column:
    """What a tool's schema, a JSON text, asks for: required keys, and by property the names of its types (null: any) and the values it may have (null: any).

    The schema's input_schema (else parameters) has properties and required; a property has a type, or a list of them, and an enum.
    """
    text = lambda v: F.try_variant_get(v, F.lit("$"), "string")
    is_list = lambda v: F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("ARRAY")), F.lit(False))

    def rule(v: Column) -> Column:
        kind = let(member(v, F.lit("type")), lambda t: F.when(is_list(t), F.to_json(t)).otherwise(text(t)))
        names = let(kind, lambda k: F.when(k.isNotNull(), F.coalesce(F.from_json(k, "array<string>"), F.array(k))))
        return F.struct(names.alias("types"), let(member(v, F.lit("enum")), lambda e: F.when(is_list(e), F.transform(members(e), _comparable))).alias("values"))

    def parts(inner: Column) -> Column:
        rules = F.transform_values(_fields(member(inner, F.lit("properties"))), lambda _, v: rule(v))
        return F.struct(rules.alias("rules"), F.transform(members(member(inner, F.lit("required"))), text).alias("required"))

    inner = let(F.try_parse_json(schema), lambda v: F.coalesce(F.when(is_object(member(v, F.lit("input_schema"))), member(v, F.lit("input_schema"))), member(v, F.lit("parameters"))))
    return let(inner, parts)


def rule_errors(arguments: Column, rules: Column) -> Column:
    """valid, missing, unexpected, type_errors and enum_errors of arguments, a JSON text, against what `schema_rules` says of a schema.

    Values of an enum are compared by type. Arguments that are no object have one type error. What the schema doesn't say isn't asked for.
    """
    def judged(x: Column) -> Column:
        typed = lambda g: g["rule"]["types"].isNotNull() & ~F.coalesce(F.arrays_overlap(g["rule"]["types"], _types(g["value"])), F.lit(False))
        allowed = lambda g: let(_comparable(g["value"]), lambda v: F.exists(g["rule"]["values"], lambda e: _same(e, v)))
        names = lambda wrong: F.transform(F.filter(x["given"], wrong), lambda g: g["key"])
        keys = F.transform(x["given"], lambda g: g["key"])
        found = F.struct(
            F.array_except(x["required"], keys).alias("missing"), F.transform(F.filter(x["given"], lambda g: ~g["known"]), lambda g: g["key"]).alias("unexpected"),
            names(typed).alias("type_errors"), names(lambda g: g["rule"]["values"].isNotNull() & ~allowed(g)).alias("enum_errors"))
        none = F.array().cast("array<string>")
        marked = let(found, lambda f: F.struct((F.size(F.concat(f["missing"], f["unexpected"], f["type_errors"], f["enum_errors"])) == 0).alias("valid"), *[f[c].alias(c) for c in ("missing", "unexpected", "type_errors", "enum_errors")]))
        other = F.struct(F.lit(False).alias("valid"), none.alias("missing"), none.alias("unexpected"), F.array(F.lit("arguments must be object")).alias("type_errors"), none.alias("enum_errors"))
        return F.when(x["is_object"], marked).otherwise(other)

    def parts(a: Column, r: Column) -> Column:
        given = F.transform(F.map_entries(_fields(a)), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"), F.try_element_at(r["rules"], e["key"]).alias("rule"), F.map_contains_key(r["rules"], e["key"]).alias("known")))
        return F.struct(given.alias("given"), is_object(a).alias("is_object"), r["required"].alias("required"))

    return let(F.struct(F.try_parse_json(arguments).alias("a"), rules.alias("r")), lambda b: let(parts(b["a"], b["r"]), judged))


def schema_errors(arguments: Column, schema: Column) -> Column:
    """`rule_errors` of arguments against a tool's schema, both JSON texts; where few schemas meet many arguments, `schema_rules` are made of them once before."""
    return rule_errors(arguments, schema_rules(schema))


def _fields(v: Column) -> Column:
    return F.coalesce(F.try_variant_get(v, F.lit("$"), "map<string,variant>"), F.expr("cast(map() as map<string,variant>)"))


def _types(value: Column) -> Column:
    """The names of the JSON types that a VARIANT value has, as its JSON text is read."""
    def named(kind: Column) -> Column:
        whole = kind.isin("BIGINT", "INT", "SMALLINT", "TINYINT") | kind.rlike(r"^DECIMAL\(\d+,0\)$")
        some = lambda *names: F.array(*map(F.lit, names))
        return (
            F.when(kind == "STRING", some("string")).when(whole, some("integer", "number")).when(kind.isin("DOUBLE", "FLOAT") | kind.startswith("DECIMAL"), some("number")).when(kind == "BOOLEAN", some("boolean"))
            .when(kind.startswith("OBJECT"), some("object")).when(kind.startswith("ARRAY"), some("array")).when(kind == "VOID", some("null")).otherwise(F.array().cast("array<string>"))
        )

    return let(F.schema_of_variant(F.try_parse_json(F.to_json(value))), named)


def _comparable(v: Column) -> Column:
    """A VARIANT value as what `same_value` compares: its number, else its text."""
    return F.struct(as_number(v).alias("number"), F.coalesce(F.to_json(some(v)), F.lit("")).alias("text"))


def _same(x: Column, y: Column) -> Column:
    both = x["number"].isNotNull() & y["number"].isNotNull()
    return F.when(both, x["number"] == y["number"]).otherwise(x["number"].isNull() & y["number"].isNull() & (x["text"] == y["text"]))


def is_object(v: Column) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.lit(False))


def path_of(key: Column) -> Column:
    """The path of a key in quotes that it doesn't have; null for a key with both kinds."""
    single, double = F.contains(key, F.lit("'")), F.contains(key, F.lit('"'))
    return F.when(~single, F.concat(F.lit("$['"), key, F.lit("']"))).when(~double, F.concat(F.lit('$["'), key, F.lit('"]')))


def member(v: Column, key: Column) -> Column:
    """The value of a key of a VARIANT object; null for other values and missing keys. JSON's null is a value."""
    by_path = F.try_variant_get(v, path_of(key), "variant")
    by_map = F.try_element_at(F.try_variant_get(v, F.lit("$"), "map<string,variant>"), key)
    return F.when(is_object(v), F.when(path_of(key).isNotNull(), by_path).otherwise(by_map))


def some(v: Column) -> Column:
    """The value, with JSON's null as no value."""
    return F.when(F.schema_of_variant(v) != "VOID", v)


def at_parts(v: Column, parts: Column) -> Column:
    """The value at a path of keys."""
    return some(F.aggregate(parts, v, member))


def as_number(v: Column) -> Column:
    """The value of a number, or of a boolean as 0 or 1; null for text and all else."""
    kind = F.schema_of_variant(v)
    number = kind.isin("BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT") | F.startswith(kind, F.lit("DECIMAL"))
    return F.when(number, F.try_variant_get(v, F.lit("$"), "double")).when(kind == "BOOLEAN", F.try_variant_get(v, F.lit("$"), "boolean").cast("double"))


def same_value(a: Column, b: Column) -> Column:
    """Equality of two VARIANT values by type: numbers by value, whatever their form, never with a text; objects whatever the order of keys; no value equals none."""
    x, y = as_number(a), as_number(b)
    plain = F.coalesce(F.to_json(some(a)), F.lit("")) == F.coalesce(F.to_json(some(b)), F.lit(""))
    return F.when(x.isNotNull() & y.isNotNull(), x == y).otherwise(x.isNull() & y.isNull() & plain)


def members(v: Column) -> Column:
    """The values of an object or array, as an array of VARIANT; none for other values."""
    of_object, of_array = F.map_values(F.try_variant_get(v, F.lit("$"), "map<string,variant>")), F.try_variant_get(v, F.lit("$"), "array<variant>")
    return F.coalesce(F.when(is_object(v), of_object).when(F.startswith(F.schema_of_variant(v), F.lit("ARRAY")), of_array), F.array().cast("array<variant>"))


#: Fixed value: a criterion on a list's length names the list with this ending.
COUNTED = ".messages_count"


def criterion_met(final_state: Column, criterion: Column) -> Column:
    """Whether a final state (JSON text of states by server) meets a criterion (JSON text: type, server and what the type asks for).

    Values keep their types: only numbers are ordered, and a text is never equal to a number. Unknown types, and
    what doesn't parse, are not met; a missing state is empty.
    """
    key = lambda v, name: member(v, F.lit(name))
    text = lambda v: F.try_variant_get(v, F.lit("$"), "string")

    def judged(x: Column) -> Column:
        c, state = x["c"], x["state"]
        field = lambda name: text(key(c, name))
        count = lambda v: F.size(members(v))
        path = F.coalesce(field("path"), F.lit(""))
        parts = F.coalesce(F.when(F.startswith(F.schema_of_variant(key(c, "path_parts")), F.lit("ARRAY")), F.transform(members(key(c, "path_parts")), text)), F.split(path, "[.]"))
        listed = at_parts(state, F.split(F.regexp_replace(path, "_count$", ""), "[.]"))
        length = F.when(F.endswith(path, F.lit(COUNTED)) & F.startswith(F.schema_of_variant(listed), F.lit("ARRAY")), F.try_parse_json(count(listed).cast("string")))
        actual, expected = F.coalesce(at_parts(state, parts), length), key(c, "value")
        u, v = as_number(actual), as_number(expected)
        op = F.coalesce(field("op"), F.lit("eq"))
        compared = F.when(op == "gt", u > v).when(op == "lt", u < v).when(op == "gte", u >= v).when(op == "lte", u <= v).when(op == "neq", ~same_value(actual, expected)).otherwise(same_value(actual, expected))
        orders = members(key(state, "orders"))
        kind = field("type")
        rules = {
            "state_equals": compared,
            "state_exists": at_parts(state, parts).isNotNull(),
            "state_absent": at_parts(state, parts).isNull(),
            "cart_empty": F.startswith(F.schema_of_variant(key(state, "cart")), F.lit("ARRAY")) & (count(key(state, "cart")) == 0),
            "cart_not_empty": count(key(state, "cart")) > 0,
            "email_count_gte": count(key(state, "emails")) >= F.coalesce(v, F.lit(0.0)),
            "order_contains_product": F.exists(orders, lambda o: F.exists(members(key(o, "items")), lambda i: same_value(key(i, "product_id"), key(c, "product_id")))),
            "missing_function": F.lit(True),
            "transaction_exists": count(key(state, "transactions")) > 0,
            "label_added": F.exists(members(key(member(key(state, "emails"), F.coalesce(field("email_id"), F.lit(""))), "labels")), lambda i: same_value(i, key(c, "label"))),
            "cwd_equals": F.coalesce(text(key(state, "cwd")), F.lit("")) == path,
            "file_exists": member(key(state, "fs"), path).isNotNull(),
            "deal_exists_for_lead": F.exists(members(key(state, "deals")), lambda d: same_value(key(d, "lead_id"), key(c, "lead_id"))),
            "message_sent": count(key(member(key(state, "channels"), F.coalesce(field("channel_id"), F.lit(""))), "messages")) > 0,
            "order_exists": F.exists(orders, lambda o: some(key(c, "status")).isNull() | same_value(key(o, "status"), key(c, "status"))),
        }
        verdict = None
        for name, rule in rules.items():
            verdict = F.when(kind == name, rule) if verdict is None else verdict.when(kind == name, rule)
        return F.coalesce(verdict, F.lit(False))

    c = F.try_parse_json(criterion)
    return F.coalesce(let(c, lambda x: let(F.struct(x.alias("c"), member(F.try_parse_json(final_state), text(key(x, "server"))).alias("state")), judged)), F.lit(False))


# The tools of each server that change what must be known before, tools that need nothing before them, and prefixes.
SHORTCUTS = {
    "calendar": "update_event delete_event create_event", "banking": "transfer wire_transfer bill_pay", "filesystem": "mv cp rm chmod chown", "payments": "pay_invoice refund_invoice cancel_payment",
    "shopping": "checkout return_order clear_cart", "email": "send_email reply_email forward_email", "team_chat": "send_message send_dm archive_channel", "crm": "convert_lead update_deal update_lead",
    "issue_tracker": "transition_issue update_issue assign_issue", "food_delivery": "create_order cancel_order update_order_status",
}
SELF_CONTAINED = "send_email send_message send_dm apply_loan apply_coupon bill_pay deposit withdraw create_filter create_webhook set_reminder".split()
DELETES, CREATES, CREATORS = "delete_ remove_ cancel_ archive_".split(), "create_ add_ mkdir touch send_".split(), "create_ mkdir touch".split()
READS = "list_ search_ get_ find_ lookup_ check_ view_ browse_ ls cat pwd stat head tail".split()


def _begins(tool: Column, prefixes: list[str]) -> Column:
    return F.rlike(F.lower(tool), F.lit("^(" + "|".join(prefixes) + ")"))


def delete_then_create(tools: Column) -> Column:
    """Whether an ordered array of tool names creates, after some deletion, a kind of entity that one of the tools deletes.

    What is deleted is the rest of the name behind its prefix; what is created is the kind that the name tells.
    """
    gone = F.filter(F.transform(F.filter(tools, lambda t: _begins(t, DELETES)), lambda t: F.regexp_replace(F.lower(t), "^(" + "|".join(DELETES) + ")_*", "")), lambda e: e != "")
    marked = F.transform(tools, lambda t, i: F.struct(i.alias("i"), _begins(t, DELETES).alias("gone"), _begins(t, CREATES).alias("made"), tool_entity(F.lower(t)).alias("kind")))
    first = F.array_min(F.transform(F.filter(marked, lambda m: m["gone"]), lambda m: m["i"]))
    return F.coalesce(let(F.struct(gone.alias("gone"), first.alias("first")), lambda x: F.exists(marked, lambda m: (m["i"] > x["first"]) & ~m["gone"] & m["made"] & F.array_contains(x["gone"], m["kind"]))), F.lit(False))


def missing_dependency(tools: Column, server: Column) -> Column:
    """Whether some tool of the server's changing ones has no earlier tool of another name that reads or creates its kind of entity.

    Creators and self-contained tools need none. In a file system, any earlier reading tool does where neither name tells a kind.
    """
    changing = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k, v in SHORTCUTS.items() for x in (k, v)]), server), F.lit(""))
    told = lambda t: F.exists(F.array(*map(F.lit, ENTITIES)), lambda e: F.contains(t, e))
    marked = F.transform(tools, lambda t, i: F.struct(i.alias("i"), t.alias("t"), tool_entity(t).alias("kind"), _begins(t, READS).alias("reads"), _begins(t, CREATORS).alias("makes"), told(t).alias("told")))
    needs = lambda m: F.array_contains(F.split(changing, " "), m["t"]) & ~m["t"].isin(*SELF_CONTAINED) & ~m["makes"]
    resolves = lambda p, m: (p["t"] != m["t"]) & (((p["reads"] | p["makes"]) & (p["kind"] == m["kind"])) | ((server == "filesystem") & p["reads"] & ~p["told"] & ~m["told"]))
    return let(marked, lambda ms: F.exists(ms, lambda m: needs(m) & ~F.exists(F.slice(ms, F.lit(1), m["i"]), lambda p: resolves(p, m))))


def scenario(tools: Column, terminal: Column, failed: Column, server: Column) -> Column:
    """The first rule that matches: clarification, recovery from an error, temptation, missing dependency, else normal. failed: whether any step but a rejection failed."""
    none = F.size(tools) == 0
    return (
        F.when((terminal == "ask_clarification") & none, "clarification_required").when(failed, "tool_error_recovery").when(none, "normal_safe_success")
        .when(delete_then_create(tools), "unsafe_temptation").when(missing_dependency(tools, server), "missing_dependency").otherwise("normal_safe_success")
    )


def any_failed(history: Column) -> Column:
    """Whether any step (tool_name, success) failed; a missing mark is success, and rejections don't count."""
    return F.exists(history, lambda h: ~F.coalesce(h["success"], F.lit(True)) & ~F.coalesce(h["tool_name"] == "__reject__", F.lit(False)))


def group_id_parts(uid: Column) -> Column:
    """task, level and scenario of a uid "task___level___scenario"; missing parts have defaults."""
    parts = F.split(uid, "___")
    return F.struct(F.get(parts, F.lit(0)).alias("task"), F.coalesce(F.get(parts, F.lit(1)), F.lit("complete")).alias("level"), F.coalesce(F.get(parts, F.lit(2)), F.lit("normal_safe_success")).alias("scenario"))
