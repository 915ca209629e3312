"""Loosely typed values as text: parsing with defaults, extraction from model output, typed equality, hashes and paths."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_or(text: Column, default: str) -> Column:
    """The text if it parses as JSON, else the default; null too gives the default."""
    return F.when(F.try_parse_json(text).isNotNull(), text).otherwise(F.lit(default))


def json_object_or_empty(text: Column) -> Column:
    """The text if it is a JSON object, else {}."""
    whole = F.schema_of_variant(F.try_parse_json(text))
    return F.when(F.startswith(whole, F.lit("OBJECT")), text).otherwise(F.lit("{}"))


def canonical(text: Column) -> Column:
    """JSON with sorted keys and no spaces; null for what doesn't parse."""
    return F.to_json(F.try_parse_json(text))


def args_equal(actual: Column, expected: Column) -> Column:
    """Typed equality of two values given as text.

    Both numbers: within 1e-9. An object or array on either side: equal JSON,
    whatever the order of keys. Else the trimmed texts without case. Null is equal to nothing.
    """
    a, b = actual.try_cast("double"), expected.try_cast("double")
    nested = F.rlike(actual, F.lit(r"^\s*[\[{]")) | F.rlike(expected, F.lit(r"^\s*[\[{]"))
    plain = F.lower(F.trim(actual)) == F.lower(F.trim(expected))
    return F.when(a.isNotNull() & b.isNotNull(), F.abs(a - b) < 1e-9).when(nested & canonical(actual).isNotNull() & canonical(expected).isNotNull(), canonical(actual) == canonical(expected)).otherwise(plain)


def state_text(state: Column) -> Column:
    """A state's JSON as the hashes take it (fixed format): sorted keys, a space after commas and colons, ASCII only; null for what doesn't parse."""

    @F.pandas_udf("string")
    def run(column):
        return column.map(lambda t: None if (v := _loads(t)) is None else json.dumps(v, sort_keys=True))

    return run(state)


def state_hash(state: Column, digits: int = 16) -> Column:
    """The first hex digits of the SHA-256 of a state's text, all 64 for the stable hash; "" for null or broken states."""
    return F.coalesce(F.left(F.sha2(state_text(state), 256), F.lit(digits)), F.lit(""))


def at_path(text: Column, path: str) -> Column:
    """The value at a dotted path of JSON objects, as text; null where a part is missing."""
    steps = "".join("['" + p.replace("'", "\\'") + "']" for p in path.split("."))
    return F.get_json_object(text, "$" + steps)


def prompt_messages(prompt: Column) -> Column:
    """Messages (role, content) of a prompt: a JSON list, a JSON object as one message, other text as the user's message; null gives none."""
    kind = "array<struct<role:string,content:string>>"
    parsed = F.schema_of_variant(F.try_parse_json(prompt))
    one = F.array(F.struct(F.lit("user").alias("role"), prompt.alias("content")))
    none = F.array().cast(kind)
    found = F.when(F.startswith(parsed, F.lit("ARRAY")), F.from_json(prompt, kind)).when(F.startswith(parsed, F.lit("OBJECT")), F.from_json(F.concat(F.lit("["), prompt, F.lit("]")), kind)).otherwise(one)
    return F.when(prompt.isNull() | (F.trim(prompt) == ""), none).otherwise(F.coalesce(found, none).cast(kind))


def without_system(messages: Column) -> Column:
    """Messages without those of the system."""
    return F.filter(messages, lambda m: m["role"] != "system")


def think_tags_valid(text: Column) -> Column:
    """Whether a message is not blank, has at most one pair of think tags, in order, with something inside and outside."""
    opens, closes = F.regexp_count(text, F.lit("<think>")), F.regexp_count(text, F.lit("</think>"))
    inside = F.regexp_extract(text, r"(?s)<think>(.*)</think>", 1)
    outside = F.regexp_replace(text, r"(?s)<think>.*</think>", "")
    pair = (opens == 1) & (closes == 1) & (F.instr(text, "<think>") < F.instr(text, "</think>")) & (F.trim(inside) != "") & (F.trim(outside) != "")
    return F.coalesce((F.trim(text) != "") & (((opens == 0) & (closes == 0)) | pair), F.lit(True))


def media_segments(text: Column) -> Column:
    """A prompt cut at <image> and <video>: structs of type and text, empty pieces left out."""
    pieces = F.filter(F.split(text, r"(?=<image>|<video>)|(?<=<image>)|(?<=<video>)"), lambda p: p != "")
    return F.transform(pieces, lambda p: F.struct(F.when(p == "<image>", "image").when(p == "<video>", "video").otherwise("text").alias("type"), F.when(~p.isin("<image>", "<video>"), p).alias("text")))


def code_split(text: Column) -> Column:
    """The first <code> block of a message, without tags and fences, and the text after it; null and the text where there is none."""
    found = F.rlike(text, F.lit(r"(?s)<code>.*?</code>"))
    block = F.regexp_extract(text, r"(?s)<code>(.*?)</code>", 1)
    body = F.trim(F.regexp_replace(block, r"^\s*```(?:python)?\s*|\s*```\s*$", ""))
    rest = F.regexp_replace(text, r"(?s)^.*?</code>", "")
    return F.struct(F.when(found, body).alias("code"), F.when(found, rest).otherwise(text).alias("rest"))


def balanced_span(text: str, start: int) -> str | None:
    """The text from an opening brace or bracket to the one that closes it, strings skipped; null if none does."""
    depth, quoted, skip = 0, False, False
    for i in range(start, len(text)):
        c = text[i]
        if quoted:
            skip, quoted = (c == "\\" and not skip), c != '"' or skip
        elif c == '"':
            quoted = True
        elif c in "{[":
            depth += 1
        elif c in "}]":
            depth -= 1
            if depth == 0:
                return text[start : i + 1]
    return None


def _loads(text: str | None):
    try:
        return json.loads(text) if text is not None else None
    except ValueError:
        return None


def repaired(text: str) -> str | None:
    """A JSON object or array out of broken text: from the first opener to the last matching closer, or with missing closers added."""
    spots = [i for i in (text.find("{"), text.find("[")) if i >= 0]
    if not spots:
        return None
    start = min(spots)
    end = text.rfind("}" if text[start] == "{" else "]")
    if end > start:
        return text[start : end + 1]
    body = text[start:]
    return body + "}" * max(0, body.count("{") - body.count("}")) + "]" * max(0, body.count("[") - body.count("]"))


def balanced_spans(text: str) -> Iterator[str]:
    """balanced_span() from each opener in turn, in two passes over the text instead of one an opener.

    Whether a place lies in a string depends on where the reading began, and there are two ways to read a text: as if it
    began outside a string or inside one. An opener that lies outside in a reading is closed as that reading closes it; one
    that lies inside a string in both is read on its own.
    """
    ends: dict[int, int] = {}
    outside: set[int] = set()
    for quoted in (False, True):
        stack, skip = [], False
        for m in re.finditer(r'["\\{}\[\]]|(?<=\\).', text, re.DOTALL):
            i, c = m.start(), m[0]
            if skip and i == escaped + 1:
                skip = False
                continue
            skip = False
            if c == "\\":
                skip, escaped = quoted, i
            elif c == '"':
                quoted = not quoted
            elif quoted:
                continue
            elif c in "{[":
                stack.append(i)
                outside.add(i)
            elif c in "}]" and stack:
                ends.setdefault(stack.pop(), i)
    for m in re.finditer(r"[{\[]", text):
        i = m.start()
        if i in ends:
            yield text[i : ends[i] + 1]
        elif i not in outside and (span := balanced_span(text, i)):
            yield span


def first_json(text: str | None) -> str | None:
    """JSON in model output: the whole text, a fenced block, a paragraph, or the first balanced span; canonical, null for none."""
    if not text:
        return None
    tries = chain([text.strip()], re.findall(r"(?s)```(?:json)?\s*(.*?)```", text), re.split(r"\n\s*\n", text), balanced_spans(text))
    for t in tries:
        value = _loads(t.strip()) if t else None
        if isinstance(value, dict | list):
            return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
    return None


def tool_calls(text: str | None) -> tuple[list[str], str]:
    """The tool calls between <tool_call> tags as canonical JSON, broken ones repaired or skipped, and the text without them."""
    found = []
    for block in re.findall(r"(?s)<tool_call>(.*?)</tool_call>", text or ""):
        value = _loads(block.strip())
        if value is None:
            value = _loads(repaired(block))
        if isinstance(value, dict) and "name" in value:
            found.append(json.dumps({"arguments": value.get("arguments", {}), "name": value["name"]}, sort_keys=True, ensure_ascii=False, separators=(",", ":")))
    return found, re.sub(r"(?s)<tool_call>.*?</tool_call>", "", text or "")


def extract_json(text: Column) -> Column:
    """first_json over Arrow batches: the multi-step search has no form in built-in functions."""

    @F.pandas_udf("string")
    def run(column):
        return column.map(first_json)

    return run(text)


def extract_tool_calls(text: Column) -> Column:
    """tool_calls over Arrow batches: a struct of calls and rest."""

    @F.pandas_udf("calls array<string>, rest string")
    def run(column):
        import pandas as pd

        return pd.DataFrame([tool_calls(t) for t in column], columns=["calls", "rest"])

    return run(text)


def flattened(text: Column) -> Column:
    """A nested JSON object as a map from dotted paths to values as text; arrays are values."""

    def walk(value, prefix: str, out: dict) -> dict:
        for k, v in value.items():
            if isinstance(v, dict) and v:
                walk(v, f"{prefix}{k}.", out)
            else:
                out[f"{prefix}{k}"] = v if isinstance(v, str) else json.dumps(v, separators=(",", ":"))
        return out

    @F.pandas_udf("map<string,string>")
    def run(column):
        return column.map(lambda t: walk(v, "", {}) if isinstance(v := _loads(t), dict) else {})

    return run(text)


def field_names(text: Column) -> Column:
    """All names and dotted paths in nested JSON, sorted; of an array the first element counts."""

    def walk(value, prefix: str, out: set) -> set:
        if isinstance(value, dict):
            for k, v in value.items():
                out.update((k, prefix + k))
                walk(v, f"{prefix}{k}.", out)
        elif isinstance(value, list) and value:
            walk(value[0], prefix, out)
        return out

    @F.pandas_udf("array<string>")
    def run(column):
        return column.map(lambda t: sorted(walk(_loads(t), "", set())))

    return run(text)
