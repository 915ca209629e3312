"""Seeded disturbances of what tools return: errors, half pages, snippets and batches with failures.

Observations are JSON texts. What a disturbance does not fit is left as it is. Draws are hashes of a seed and a key.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.arrays import let
from weftline.functions.contracts import is_object, member, members
from weftline.operators.sampling import uniform

# The disturbances of each domain, in the order in which they are tried, and the chance of each.
KINDS = {
    "filesystem": ("intermittent_api_error", "partial_batch_failure"), "calendar": ("intermittent_api_error", "partial_batch_failure"), "crm": ("intermittent_api_error", "partial_batch_failure"),
    "email": ("paginated_response", "partial_batch_failure"), "team_chat": ("paginated_response", "partial_batch_failure"), "shopping": ("paginated_response", "incomplete_intermediate"),
    "banking": ("intermittent_api_error", "partial_batch_failure"), "payments": ("intermittent_api_error", "partial_batch_failure"), "food_delivery": ("intermittent_api_error", "partial_batch_failure"),
    "issue_tracker": ("intermittent_api_error", "partial_batch_failure"),
}
OTHERS = ("intermittent_api_error", "partial_batch_failure")
CHANCE = 0.10
ERROR = '{"error":"Internal Server Error","retry":true}'
SUMMARY = "Partial results returned. Use get_detail / extract / get_item to retrieve complete information."
FAILURE = "Transient processing failure — retry required"
LISTS, COUNTS, BATCHES = ("items", "results", "matches", "entries", "records"), ("total", "count", "next_cursor", "cursor"), ("results", "updated", "processed", "created")

_MAP = "map<string,variant>"


def _fields(v: Column) -> Column:
    return F.try_variant_get(v, F.lit("$"), _MAP)


def _json(text: Column) -> Column:
    return F.try_parse_json(text)


def _with(v: Column, **new: Column) -> Column:
    """The object as JSON text with some keys set to JSON texts."""
    kept = F.map_filter(_fields(v), lambda k, _: ~k.isin(*new))
    return F.to_json(F.map_concat(kept, F.create_map(*[x for k, t in new.items() for x in (F.lit(k), _json(t))])))


def _is_list(v: Column) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("ARRAY")), F.lit(False))


def paged(observation: Column) -> Column:
    """The first half of the items (or results) with a cursor; null for fewer than two."""
    def use(v):
        items = F.coalesce(member(v, F.lit("items")), member(v, F.lit("results")))
        return let(items, lambda i: F.when(_is_list(i) & (F.size(members(i)) > 1), _with(v, items=F.to_json(F.slice(members(i), F.lit(1), F.floor(F.size(members(i)) / 2).cast("int"))), next_cursor=F.lit('"page_2"'))))
    return let(_json(observation), lambda v: F.when(is_object(v), use(v)))


def snippets(observation: Column, draw: Column) -> Column:
    """A summary with a number of snippets, one to three by the draw, in place of results; null for fewer than two results. Totals and cursors stay."""
    def use(v):
        lists = F.filter(F.array(*[member(v, F.lit(k)) for k in LISTS]), _is_list)
        total = F.size(members(F.get(lists, F.lit(0))))
        own = F.map_filter(_fields(v), lambda k, _: k.isin(*COUNTS))
        told = {"summary": F.lit(f'"{SUMMARY}"'), "snippet_count": F.least(total, (1 + F.floor(draw * 3)).cast("int")).cast("string"), "requires_detail_fetch": F.lit("true")}
        made = F.create_map(*[x for k, t in told.items() for x in (F.lit(k), _json(t))])
        return F.when(total >= 2, F.to_json(F.map_concat(own, made)))
    return let(_json(observation), lambda v: F.when(is_object(v), use(v)))


def failed_batch(observation: Column, key: Column) -> Column:
    """A third of the results (at least one), those of the smallest hashes of key and place, marked as failed; null where no list has two or more. Values that are no objects stay."""
    def use(v):
        lists = F.array(*[F.struct(F.lit(k).alias("k"), member(v, F.lit(k)).alias("v")) for k in BATCHES])
        return let(F.get(F.filter(lists, lambda x: _is_list(x["v"]) & (F.size(members(x["v"])) > 1)), F.lit(0)), lambda x: F.when(x.isNotNull(), marked(v, x["k"], members(x["v"]))))

    def marked(v, name, items):
        n = F.greatest(F.lit(1), F.floor(F.size(items) / 3).cast("int"))
        ranked = F.array_sort(F.transform(items, lambda _, i: F.struct(F.md5(F.concat_ws(":", key, i.cast("string"))).alias("h"), i.alias("i"))))
        gone = F.transform(F.slice(ranked, F.lit(1), n), lambda r: r["i"])
        new = F.transform(items, lambda x, i: F.when(F.array_contains(gone, i) & is_object(x), _json(_with(x, status=F.lit('"failed"'), error=F.lit(f'"{FAILURE}"')))).otherwise(x))
        kept = F.map_filter(_fields(v), lambda k, _: (k != name) & ~k.isin("partial_failure", "failed_count"))
        made = F.create_map(name, _json(F.to_json(new)), F.lit("partial_failure"), _json(F.lit("true")), F.lit("failed_count"), _json(n.cast("string")))
        return F.to_json(F.map_concat(kept, made))

    return let(_json(observation), lambda v: F.when(is_object(v), use(v)))


def disturbed(observation: Column, domain: Column, key: Column, seed: int = 42, chance: float = CHANCE) -> Column:
    """The observation after the first disturbance of its domain that is drawn and fits; each is drawn on its own. Others stay as they are, text by text."""
    draw = lambda kind: uniform(F.concat_ws(":", F.lit(kind), key.cast("string")), seed)
    made = {
        "intermittent_api_error": F.lit(ERROR), "paginated_response": paged(observation),
        "incomplete_intermediate": snippets(observation, uniform(F.concat_ws(":", F.lit("snippets"), key.cast("string")), seed)),
        "partial_batch_failure": failed_batch(observation, F.concat_ws(":", F.lit(str(seed)), key.cast("string"))),
    }
    drawn = {kind: F.when(draw(kind) < chance, text) for kind, text in made.items()}
    pairs = sorted({*KINDS.values(), OTHERS})
    out = F.coalesce(*[drawn[k] for k in OTHERS])
    for pair in pairs:
        names = [d for d, p in KINDS.items() if p == pair]
        out = F.when(domain.isin(*names), F.coalesce(*[drawn[k] for k in pair])).otherwise(out)
    return F.coalesce(out, observation)
