"""Grading of mathematical and question answers, and parsing of model actions, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions import text as tx

# Fixed values of the grading's definition, in the order in which they apply.
SUBSTITUTIONS = (
    ("an ", ""), ("a ", ""), (".$", "$"), ("\\$", ""), ("\\ ", ""), (" ", ""), ("mbox", "text"), (",\\text{and}", ","), ("\\text{and}", ","),
    ("\\text{m}", "\\text{}"),
)
REMOVED = (
    "square", "ways", "integers", "dollars", "mph", "inches", "hours", "km", "units", "\\ldots", "sue", "points", "feet", "minutes", "digits", "cents",
    "degrees", "cm", "gm", "pounds", "meters", "meals", "edges", "students", "childrentickets", "multiples", "\\text{s}", "\\text{.}", "\\text{\ns}",
    "\\text{}^2", "\\text{}^3", "\\text{\n}", "\\text{}", "\\mathrm{th}", "^\\circ", "^{\\circ}", "\\;", ",\\!", "{,}", '"', "\\dots",
)
PATTERNS = (
    (r"(.*?)(\$)(.*?)(\$)(.*)", r"\$$3\$"),
    (r"(\\text\{)(.*?)(\})", "$2"),
    (r"(\\textbf\{)(.*?)(\})", "$2"),
    (r"(\\overline\{)(.*?)(\})", "$2"),
    (r"(\\boxed\{)(.*)(\})", "$2"),
    (r"(frac)([^{])(.)", "frac{$2}{$3}"),
    (r"(sqrt)([^{])", "sqrt{$2}"),
)
ANSWER_LINE = r"(?i)Answer\s*:\s*([^\n]+)"
ACTION_TAGS = "tool_call|final_answer|ask_clarification|report_error"


def normal_final_answer(answer: Column) -> Column:
    """What follows the last "=", without units, words and LaTeX dressing, in one spelling of fractions and roots; whole numbers without commas."""
    out = F.substring_index(answer, "=", -1)
    for old, new in (*SUBSTITUTIONS, *((unit, "") for unit in REMOVED)):
        out = F.replace(out, F.lit(old), F.lit(new))
    for pattern, new in PATTERNS:
        out = F.regexp_replace(out, pattern, new)
    out = F.replace(out, F.lit("$"), F.lit(""))
    digits = F.replace(out, F.lit(","), F.lit(""))
    return F.trim(F.when(F.rlike(digits, F.lit(r"^\d+$")), digits).otherwise(out))


def line_answer(solution: Column) -> Column:
    """The normal form of the last "Answer: ..." line; "[INVALID]" where there is none."""
    return normal_final_answer(F.coalesce(tx.last_match(solution, ANSWER_LINE), F.lit("[INVALID]")))


def answer_score(solution: Column, truth: Column, strict_box: bool = False) -> Column:
    """score (1 or -1), acc and pred, from the last 300 characters; strictly, the boxed text in the last 100 must equal the truth."""
    end = F.right(solution, F.lit(300))
    pred = tx.last_boxed(F.right(end, F.lit(100))) if strict_box else line_answer(end)
    right = F.coalesce(pred == (truth if strict_box else normal_final_answer(truth)), F.lit(False))
    return F.struct(F.when(right, F.lit(1.0)).otherwise(F.lit(-1.0)).alias("score"), right.alias("acc"), pred.alias("pred"))


def question_score(solution: Column, golden: Column, contained: bool = False, wrong: float = 0.0, right: float = 1.0) -> Column:
    """0 without an answer block, `right` for a match (a quarter of it with over ten tags), else `wrong`."""
    answer = tx.answer_block(solution)
    match = tx.contained_match(answer, golden) if contained else tx.exact_match(answer, golden)
    tags = F.greatest(F.regexp_count(solution, F.lit("<answer>")), F.regexp_count(solution, F.lit("</answer>")))
    full = F.lit(right) if contained else F.when(tags > 10, F.lit(right / 4)).otherwise(F.lit(right))
    return F.when(answer.isNull(), F.lit(0.0)).when(match == 1, full).otherwise(F.lit(wrong))


def think_and_box(solution: Column) -> Column:
    """1 if the text is a think block followed by a boxed answer."""
    return solution.rlike(r"(?s)^<think>.*</think>.*\\boxed\{.*\}.*$").cast("double")


def format_weighted(accuracy: Column, form: Column, weight: float = 0.1) -> Column:
    return (1 - weight) * accuracy + weight * form


def point_reward(points: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """1 / sqrt(n * k) if the k-th of n points (structs x, y) is the first in the box, -1 / n if none is, -1 without points."""
    inside = F.transform(points, lambda p: p["x"].between(x1, x2) & p["y"].between(y1, y2))
    rank, n = F.array_position(inside, F.lit(True)), F.size(points)
    return F.when(F.coalesce(n, F.lit(0)) <= 0, F.lit(-1.0)).when(rank > 0, 1 / F.sqrt(n * rank)).otherwise(F.lit(-1.0) / F.nullif(n, F.lit(0)))


def parsed_action(output: Column, strict: bool = False, least: int = 10) -> Column:
    """action_type and content of a model's output: the first known tag decides; then a JSON tool call; then plain text of `least` characters."""
    tag = F.regexp_extract(output, rf"(?s)<({ACTION_TAGS})>(.*?)</\1>", 1)
    inside = F.trim(F.regexp_extract(output, rf"(?s)<({ACTION_TAGS})>(.*?)</\1>", 2))
    name = F.get_json_object(output, "$.name")
    found = F.when(F.coalesce(F.trim(output), F.lit("")) == "", F.struct(F.lit("unparseable").alias("action_type"), F.lit("").alias("content")))
    found = found.when(tag != "", F.struct(tag.alias("action_type"), inside.alias("content")))
    if not strict:
        found = found.when(name.isNotNull(), F.struct(F.lit("tool_call").alias("action_type"), output.alias("content")))
        found = found.when(F.length(F.trim(output)) >= least, F.struct(F.lit("final_answer").alias("action_type"), F.trim(output).alias("content")))
    return found.otherwise(F.struct(F.lit("unparseable").alias("action_type"), output.alias("content")))


def json_lines(text: Column, schema: str) -> Column:
    """The lines that are JSON of a schema, as an array; others are left out."""
    good = F.filter(F.split(text, "\n"), lambda x: F.try_parse_json(x).isNotNull())
    return F.transform(good, lambda x: F.from_json(x, schema))


def choice_score(solution: Column, truth: Column) -> Column:
    """1 if the first "Answer: X" names the right letter, else 0."""
    said = F.regexp_extract(solution, r"(?i)Answer[ \t]*:[ \t]*\$?([A-D])\$?", 1)
    return F.coalesce(said == truth, F.lit(False)).cast("double")
