"""Text functions as column expressions: answer extraction, normalisation and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the scores' definitions.
STRICT_ANSWER = r"#### (\-?[0-9\.\,]+)"
NUMBER = r"(\-?[0-9\.\,]+)"
ANSWER_BLOCK = r"(?s)<answer>(.*?)</answer>"
STALE_YEAR = r"\b202[0-5][-/]"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def strip_think(text: Column) -> Column:
    """Closed think blocks go, then what follows an open one, then stray closing tags."""
    closed = F.regexp_replace(text, r"(?s)<think>.*?</think>", "")
    return F.trim(F.regexp_replace(F.regexp_replace(closed, r"(?s)<think>.*", ""), "</think>", ""))


def last_match(text: Column, pattern: str, group: int = 1) -> Column:
    """The last match's group, or null."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.lit(-1))


def marked_answer(text: Column, method: str = "strict", tail: int = 300) -> Column:
    """The number after the last "#### ", or with "flexible" the last number that is more than signs; from the last `tail` characters."""
    end = F.right(text, F.lit(tail))
    if method == "strict":
        return F.regexp_replace(last_match(end, STRICT_ANSWER), r"[,$]", "")
    numbers = F.filter(F.regexp_extract_all(end, F.lit(NUMBER), F.lit(1)), lambda x: ~x.isin("", "."))
    return F.try_element_at(numbers, F.lit(-1))


def marked_score(answer: Column, truth: Column, right: float = 1.0, wrong: float = 0.0) -> Column:
    """0 without an answer, `right` if it equals the truth, else `wrong`."""
    return F.when(answer.isNull(), F.lit(0.0)).when(answer == truth, F.lit(right)).otherwise(F.lit(wrong))


def normal_answer(text: Column) -> Column:
    """Lower case, no punctuation, no articles, single spaces."""
    bare = F.translate(F.lower(text), PUNCTUATION, "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?U)\b(a|an|the)\b", " "), r"\s+", " "))


def exact_match(prediction: Column, golden: Column) -> Column:
    """1 if the normal form of an array's text equals the prediction's."""
    p = normal_answer(prediction)
    return F.coalesce(F.exists(golden, lambda g: normal_answer(g) == p), F.lit(False)).cast("int")


def contained_match(prediction: Column, golden: Column) -> Column:
    p = normal_answer(prediction)
    return F.coalesce(F.exists(golden, lambda g: F.contains(p, normal_answer(g))), F.lit(False)).cast("int")


def answer_block(text: Column) -> Column:
    """The inside of the last answer block, trimmed; null without one."""
    return F.regexp_replace(last_match(text, ANSWER_BLOCK), r"^\s+|\s+$", "")


def last_boxed(text: Column) -> Column:
    """The content of the last \\boxed{...}, with balanced braces; null if there is none or it isn't closed.

    One fold over the characters after the last marker counts depth.
    """
    marker = "\\boxed{"
    at = F.length(text) - F.length(F.substring_index(text, marker, -1))
    rest = F.substring_index(text, marker, -1)
    chars = F.split(rest, "")
    zero = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("n"))
    walked = F.aggregate(chars, zero, lambda s, c: F.when(s["depth"] == 0, s).otherwise(
        F.struct((s["depth"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)).alias("depth"), (s["n"] + F.length(c)).alias("n"))))
    return F.when((at > 0) & (walked["depth"] == 0), F.left(rest, walked["n"] - 1))


def short_hash(text: Column) -> Column:
    """The first 16 hex digits of SHA-1."""
    return F.left(F.sha1(text.cast("binary")), F.lit(16))


def has_stale_year(text: Column) -> Column:
    return text.rlike(STALE_YEAR)


#: Operation of a tool by the prefix of its name: rules in order, then "query".
CREATE = ("create_", "add_", "send_", "book_", "place_")
DELETE = ("delete_", "remove_", "cancel_")
UPDATE = ("update_", "set_", "mark_", "move_", "rename_")
QUERY = ("get_", "list_", "search_", "check_", "find_")


def _prefixed(name: Column, prefixes: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | name.startswith(p)
    return out


def operation_of(name: Column, order: str = "create delete update query", default: str = "query") -> Column:
    """The kind of a tool by prefix, in a given order of kinds; callers that differ in order get different kinds."""
    sets = {"create": CREATE, "delete": DELETE, "update": UPDATE, "query": QUERY}
    out = F.lit(default)
    for kind in reversed(order.split()):
        out = F.when(_prefixed(name, sets[kind]), F.lit(kind)).otherwise(out)
    return out


def overlong_penalty(length: Column, limit: int, buffer: int, factor: float) -> Column:
    """0 up to limit - buffer, then falling to -factor at the limit and on."""
    return F.least(-(length - (limit - buffer)) / buffer * factor, F.lit(0.0))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def formatted_passages(passages: Column) -> Column:
    """"Doc i (Title: first line)" and the rest, with a blank line between, for an array of texts whose first line is the title."""
    rows = F.transform(passages, lambda p, i: F.concat(
        F.lit("Doc "), (i + 1).cast("string"), F.lit(" (Title: "), F.substring_index(p, "\n", 1), F.lit(")\n"), F.regexp_replace(p, r"(?s)^[^\n]*\n?", ""), F.lit("\n\n")))
    return F.regexp_replace(F.array_join(rows, ""), r"^\s+|\s+$", "")
