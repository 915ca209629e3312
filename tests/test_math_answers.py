"""Grading by structure: shapes that are equal and shapes that aren't, and the extraction against plain string search."""

import math
import random

import pytest

from weftline.functions import mathanswers as ma

EQUAL = [
    ("1/2", "0.5"), (r"\frac{1}{2}", "0.5"), (r"\frac12", "1/2"), (r"50\%", "0.5"), ("50%", "50"), ("(1,2)", "(1, 2)"), ("1,2", "(1,2)"), ("[0,1)", "[0, 1)"), ("Point(1,2)", "(1,2)"),
    (r"\begin{pmatrix}1\\2\end{pmatrix}", "Matrix([[1],[2]])"), ("[[1,2],[3,4]]", r"\begin{pmatrix}1&2\\ 3&4\end{pmatrix}"), ("(x+1)(x+2)", "x^2+3x+2"), ("x=5", "5"), (r"2\sqrt{3}", r"\sqrt{12}"),
    (r"(-\infty,2)\cup(3,\infty)", r"(-\infty, 2) \cup (3, \infty)"), ("2xy", "2yx"), ("y=2x+1", "2x+1=y"), ("1,000", "1000"), (r"3\pi", "9.42477796"), ("12_8", "12"), ("5!", "120"), ("|-3|", "3"),
    (r"\sqrt[3]{8}", "2"), ("2^{10}", "1024"), ("-(-2)", "2"), (r"$\left(1, \frac{1}{2}\right)$", "(1, 0.5)"), ("2^-1", "0.5"), ("((1,2),(3,4))", "((1, 2.0), (3, 4))"),
]
DIFFERENT = [
    ("1", "2"), ("(1,2)", "[1,2]"), ("(1,2)", "(2,1)"), ("(1,2,3)", "(1,2)"), ("x+1", "x+2"), ("", "1"), ("[[1,2],[3,4]]", r"\begin{pmatrix}1&2\\3&5\end{pmatrix}"), ("abc def ?", "1"), ("[0,1)", "[0,1]"),
    ("(1", "1"), ("1/0", "2"), ("x", "y"), ("(" * 3000, "1"), (r"(0,1)\cup(2,3)", "(0,1)"), ("[[1,2]]", "[[1],[2]]"),
]


@pytest.mark.parametrize("pair", EQUAL)
def test_equal(pair):
    assert ma.structurally_equal(*pair) and ma.structurally_equal(*pair[::-1])


@pytest.mark.parametrize("pair", DIFFERENT)
def test_different(pair):
    assert not ma.structurally_equal(*pair)


def test_two_values_of_pi():
    assert ma.structurally_equal(r"3\pi", "9.42", 3.14) and not ma.structurally_equal(r"3\pi", "9.42", math.pi)


def test_terms_against_python():
    """Random terms have the value that Python gives them."""
    rng = random.Random(2)

    def term(depth):
        if depth == 0 or rng.random() < 0.2:
            n = rng.randint(1, 9)
            return str(n), str(n)
        (a, x), (b, y) = term(depth - 1), term(depth - 1)
        return rng.choice([(f"{a}+{b}", f"{x}+{y}"), (f"({a})-({b})", f"({x})-({y})"), (rf"({a})\cdot({b})", f"({x})*({y})"), (rf"\frac{{{a}}}{{{b}}}", f"(({x})/({y}))"), (rf"\sqrt{{{a}}}", f"abs({x})**0.5" if True else ""), (f"({a})({b})", f"({x})*({y})")])

    seen = 0
    for _ in range(300):
        latex, python = term(4)
        try:
            due = eval(python)  # noqa: S307
        except ZeroDivisionError:
            assert ma.values(latex, math.pi) is None
            continue
        if "sqrt" in latex and "-" in latex:
            continue
        assert ma.values(latex, math.pi)[0] == pytest.approx(due)
        seen += 1
    assert seen > 100


def test_graded_rows(spark):
    rows = [("\\text{Ten}", "ten", True), ("3 degrees", "3", True), ("2 million", "2*10^6", True), ("6/4", "3/2", True), (None, "1", False), ("1", None, False), ("", "0", False), ("1 1/2", "1.5", True), ("$5$", "5", True), ("1,234", "1234", True), ("x" * 200_000, "y", False)]
    rows += [(a, b, True) for a, b in EQUAL]
    df = spark.createDataFrame(rows, "given string, truth string, due boolean").repartition(3)
    got = ma.graded(df, "given", "truth").collect()
    assert [r for r in got if r.correct != r.due] == [] and len(got) == len(rows)
    assert ma.graded(df.limit(0), "given", "truth").collect() == []


def by_hand(text):
    """The cascade with rfind, from its definition."""
    found = False
    for m in ma.BEFORE:
        if (at := text.lower().rfind(m)) >= 0:
            found, text = True, text[at + len(m) :].strip()
    for m in ma.BEHIND:
        if (at := text.lower().rfind(m)) >= 0:
            found, text = True, text[:at].strip()
    at = max(text.rfind("\\boxed"), -1)
    at = text.rfind("\\fbox") if at < 0 else at
    if at >= 0 and (begin := text.find("{", at)) >= 0:
        depth = 0
        for i in range(begin, len(text)):
            depth += (text[i] == "{") - (text[i] == "}")
            if depth == 0:
                if box := text[begin + 1 : i].strip():
                    found, text = True, box
                break
    if ". " in text:
        text = text[: text.rfind(". ")].strip()
    for m in ma.LAST_WORDS:
        if (at := text.lower().rfind(m)) >= 0:
            found, text = True, text[at + len(m) :].strip()
    return found and any(c.isdigit() for c in text), text


def test_extraction_against_string_search(spark):
    rng = random.Random(6)
    pieces = ["Answer:", "ANSWER IS", "answers are", "is the answer", "are answers", "\\boxed{", "\\fbox {", "}", "{", "3", "x", "²", ". ", "be ", " is ", "are\n", "=", ": ", "get ", "\n", " ", "ok", "\\frac{1}{2}", "é"]
    texts = ["", " ", "7", *("".join(rng.choices(pieces, k=rng.randint(1, 14))) for _ in range(600))]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(3)
    got = {r.i: (r.a.found, r.a.answer) for r in df.select("i", ma.found_answer(ma.F.col("t")).alias("a")).collect()}
    assert {i: g for i, g in got.items() if g != by_hand(texts[i])} == {}
    assert spark.createDataFrame([(None,)], "t string").select(ma.found_answer(ma.F.col("t")).alias("a")).first().a is None
