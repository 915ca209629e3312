"""Answers in LaTeX: one spelling for equal ones, and scores by data source."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions import answers
from weftline.functions import text as tx

# Fixed values of the definition, in the order in which they apply: texts replaced, then patterns.
PLAIN = (
    ("\n", ""), ("\\!", ""), ("\\\\", "\\"), ("tfrac", "frac"), ("dfrac", "frac"), ("\\left", ""), ("\\right", ""), ("^{\\circ}", ""), ("^\\circ", ""), ("\\$", ""),
)
UNITS = r"(?s)\\text\{ .*$"
DECIMALS = ((" .", " 0."), ("{.", "{0."))
NAMED = r"^[^=]{0,2}=([^=]*)$"
ROOT, ROOT_TO = r"\\sqrt([^{])", r"\\sqrt{$1}"
FRAC_TWO, FRAC_TWO_TO = r"\\frac([^{])([^{])", r"\\frac{$1}{$2}"
FRAC_ONE, FRAC_ONE_TO = r"\\frac([^{])\{", r"\\frac{$1}{"
SLASH, SLASH_TO = r"^(0|-?[1-9][0-9]*)/(0|-?[1-9][0-9]*)$", r"\\frac{$1}{$2}"


def latex_normal(text: Column) -> Column:
    """A LaTeX answer without spaces, units, degrees, percent signs and sizes, with fractions and roots in braces."""
    x = text
    for a, b in PLAIN:
        x = F.replace(x, F.lit(a), F.lit(b))
    x = F.replace(F.regexp_replace(x, UNITS, ""), F.lit("\\%"), F.lit(""))
    for a, b in DECIMALS:
        x = F.replace(x, F.lit(a), F.lit(b))
    x = F.regexp_replace(F.regexp_replace(x, r"^\.", "0."), NAMED, "$1")
    x = F.replace(F.regexp_replace(x, ROOT, ROOT_TO), F.lit(" "), F.lit(""))
    x = F.regexp_replace(F.regexp_replace(x, FRAC_TWO, FRAC_TWO_TO), FRAC_ONE, FRAC_ONE_TO)
    return F.regexp_replace(F.when(x == "0.5", "\\frac{1}{2}").otherwise(x), SLASH, SLASH_TO)


def latex_equal(a: Column, b: Column) -> Column:
    """Whether two answers have one normal form; two nulls are equal, one is not."""
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(latex_normal(a) == latex_normal(b))


def latex_score(solution: Column, truth: Column) -> Column:
    """1 if the last boxed answer equals the truth, else 0."""
    boxed = tx.last_boxed(solution)
    return F.when(boxed.isNull(), F.lit(0.0)).otherwise(latex_equal(boxed, truth).cast("double"))


def boxed_equal(solution: Column, truth: Column) -> Column:
    """1 if the last boxed text is the truth, character by character."""
    return F.coalesce(tx.last_boxed(solution) == truth, F.lit(False)).cast("double")


def tool_box_score(solution: Column, truth: Column, turns: Column) -> Column:
    """1 for the right strict box; a wrong one gets -1 and a twentieth for each turn past two, -0.6 at most."""
    right = answers.answer_score(solution, truth, strict_box=True)["score"]
    return F.when(right < 0, F.least(F.lit(-0.6), right + (turns - 2) / 2 * 0.1)).otherwise(right)


def nearly(a: Column, b: Column, relative: float = 1e-9) -> Column:
    return F.abs(a - b) <= relative * F.greatest(F.abs(a), F.abs(b))


def collinear(points: Column) -> Column:
    """Whether any three of the points (structs x, y) lie on a line. An answer's few points are compared three by three within its row."""
    n = F.size(points)
    upto = lambda a: F.when(a < n, F.sequence(a, n - 1)).otherwise(F.array().cast("array<int>"))
    at = lambda i, c: F.get(points, i)[c]
    line = lambda i, j, k: nearly((at(j, "y") - at(i, "y")) * (at(k, "x") - at(i, "x")), (at(k, "y") - at(i, "y")) * (at(j, "x") - at(i, "x")))
    return F.exists(upto(F.lit(0)), lambda i: F.exists(upto(i + 1), lambda j: F.exists(upto(j + 1), lambda k: line(i, j, k))))


#: Data sources by the scorer that grades them.
MATH_SOURCES = ("lighteval/MATH", "DigitalLearningGmbH/MATH-lighteval", "HuggingFaceH4/MATH-500")
LINE_SOURCES = ("math_dapo", "math", "math_dapo_reasoning")


def score_by_source(source: Column, solution: Column, truth: Column) -> Column:
    """The score of a solution by its data source's grader; null for sources of no known grader."""
    return (
        F.when(source == "openai/gsm8k", tx.marked_score(tx.marked_answer(solution), truth)).when(source.isin(*MATH_SOURCES), latex_score(solution, truth))
        .when(source.isin(*LINE_SOURCES) | source.startswith("aime"), answers.answer_score(solution, truth)["score"])
        .when(source == "hiyouga/geometry3k", answers.format_weighted(latex_score(solution, truth), answers.think_and_box(solution)))
        .when(source.startswith("searchR1_"), answers.question_score(solution, F.array(truth))).when(source.startswith("tau_bench_"), F.lit(0.0))
    )
