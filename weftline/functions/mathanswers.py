"""Answers of mathematical solutions: found by markers, and graded by their structure.

Finding an answer and bringing it into one spelling are column expressions. Grading works on Arrow
batches: answers are read as numbers, lists in brackets, matrices or terms, and compared part by
part. Terms are equal if they have equal values at a few fixed points for their letters; nothing is simplified
symbolically.
"""

from __future__ import annotations

import cmath
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from weftline.functions import maths
from weftline.functions.arrays import let

# What stands before an answer, what stands behind one, and the last words before one, each tried in this order.
BEFORE = ("answer:", "answer is", "answers are")
BEHIND = ("is answer", "is the answer", "are answers", "are the answers")
LAST_WORDS = ("be ", "is ", "are ", "=", ": ", "get ", "be\n", "is\n", "are\n", ":\n", "get\n")
# Units that are dropped, and words for powers of ten.
UNITS = "degree cm centimeter meter mile second minute hour day week month year foot feet inch yard liter".split()
POWERS = (("million", "*10^6"), ("billion", "*10^9"), ("trillion", "*10^12"))

SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
DIGIT = r"[\p{Nd}\x{b2}\x{b3}\x{b9}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}]"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def _step(state: Column, there, rest) -> Column:
    """One step on (found, text): where `there` holds, the text becomes `rest` and an answer counts as found."""
    def use(x):
        hit = there(x["text"])
        return F.struct((x["found"] | hit).alias("found"), F.when(hit, rest(x["text"])).otherwise(x["text"]).alias("text"))

    return let(state, use)


def _has(marker: str):
    return lambda t: F.contains(F.lower(t), F.lit(marker))


def boxed_span(text: Column) -> Column:
    """What the first brace after the last \\boxed (where there is none, \\fbox) encloses; null if none is closed."""
    last = lambda marker: F.when(F.contains(text, F.lit(marker)), F.substring_index(text, marker, -1))
    tail = F.coalesce(last("\\boxed"), last("\\fbox"))
    zero = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("n"))
    walk = lambda rest: F.aggregate(F.split(rest, ""), zero, lambda s, c: F.when(s["depth"] == 0, s).otherwise(
        F.struct((s["depth"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)).alias("depth"), (s["n"] + F.length(c)).alias("n"))))
    rest = let(tail, lambda t: F.when(F.contains(t, F.lit("{")), F.substr(t, F.instr(t, "{") + 1)))
    return let(rest, lambda r: let(walk(r), lambda w: F.when(w["depth"] == 0, stripped(F.left(r, w["n"] - 1)))))


def found_answer(response: Column) -> Column:
    """found and answer of a response: what is left after the last marker of each kind in turn, in the last box, or behind the last words.

    An answer without a digit doesn't count as found. Null gives null.
    """
    state = F.struct(F.lit(False).alias("found"), response.alias("text"))
    for marker in BEFORE:
        state = _step(state, _has(marker), lambda t, m=marker: stripped(F.regexp_extract(t, f"(?is)^.*{m}(.*)$", 1)))
    for marker in BEHIND:
        state = _step(state, _has(marker), lambda t, m=marker: stripped(F.regexp_extract(t, f"(?is)^(.*){m}", 1)))
    boxed = let(state, lambda x: F.struct(x["found"].alias("found"), x["text"].alias("text"), F.nullif(boxed_span(x["text"]), F.lit("")).alias("box")))
    state = let(boxed, lambda x: F.struct((x["found"] | x["box"].isNotNull()).alias("found"), F.coalesce(x["box"], x["text"]).alias("text")))
    state = let(state, lambda x: F.struct(x["found"].alias("found"), F.when(F.contains(x["text"], F.lit(". ")), stripped(F.regexp_extract(x["text"], r"(?s)^(.*)\. ", 1))).otherwise(x["text"]).alias("text")))
    for marker in LAST_WORDS:
        state = _step(state, _has(marker), lambda t, m=marker: stripped(F.regexp_extract(t, f"(?is)^.*{m}(.*)$", 1)))
    return F.when(response.isNotNull(), let(state, lambda x: F.struct((x["found"] & F.rlike(x["text"], F.lit(DIGIT))).alias("found"), x["text"].alias("answer"))))


def plain_answer(answer: Column) -> Column:
    """One spelling of an answer: no text command, dollar or percent signs, units, degrees or commas in numbers; words for powers of ten as powers; lower case."""
    x = F.when(F.rlike(answer, F.lit(r"^\\text\{.+?\}$")), F.regexp_extract(answer, r"^\\text\{(.+?)\}$", 1)).otherwise(answer)
    for gone in ("\\%", "\\$", "$", "%"):
        x = F.replace(x, F.lit(gone), F.lit("%" if gone == "\\%" else "$" if gone == "\\$" else ""))
    for word in (" or ", " and "):
        x = F.replace(x, F.lit(word), F.lit(" , "))
    for word, power in POWERS:
        x = F.replace(x, F.lit(word), F.lit(power))
    for unit in UNITS:
        x = F.regexp_replace(x, rf"{unit}(es)?(s)? *(\^[0-9]+)?", "")
    x = F.regexp_replace(x, r"\^ *\\circ", "")
    x = let(x, lambda t: F.when(F.startswith(t, F.lit("{")) & F.endswith(t, F.lit("}")), F.substr(t, F.lit(2), F.length(t) - 2)).otherwise(t))
    x = F.regexp_replace(F.regexp_replace(x, r",\\! *", ""), "- *", "-")
    x = F.lower(F.regexp_replace(x, r"([0-9]) +([0-9])", "$1+$2"))
    # commas part thousands only where three digits and no more follow
    as_number = lambda t: F.regexp_replace(t, r"(?<=\d),(?=\d{3}(\D|$))", "").try_cast("double")
    whole = lambda n: n.isNotNull() & (F.abs(n) < 1e15) & (F.abs(n - F.round(n)) <= 1e-7)
    return let(x, lambda t: let(as_number(t), lambda n: F.when(whole(n), F.round(n).cast("bigint").cast("string")).otherwise(t)))


TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:e[+-]?\d+)?|\.\d+)|\\?([A-Za-z]+)|(\*\*|[-+*/^(){}\[\]|,_=√π·×÷!]))")
CALLS = {"sqrt": cmath.sqrt, "sin": cmath.sin, "cos": cmath.cos, "tan": cmath.tan, "ln": cmath.log, "log": cmath.log, "exp": cmath.exp, "abs": abs}
NAMES = {"infty": complex(math.inf), "inf": complex(math.inf), "oo": complex(math.inf), "e": complex(math.e), "i": 1j}
SAME = {"√": "sqrt", "π": "pi", "·": "*", "×": "*", "÷": "/", "cdot": "*", "times": "*", "div": "/", "dfrac": "frac", "tfrac": "frac", "**": "^"}
#: Values that the letters of a term take, one after the other; a term has as many values as there are points.
POINTS = (0.731, 1.377, 2.113, 0.419)


class Term:
    """The value of a term at one point, read from left to right; brackets nest, factors may stand side by side."""

    def __init__(self, text: str, point: float, pi: float):
        self.point, self.pi, self.at, self.tokens = point, pi, 0, []
        end = 0
        while end < len(text.rstrip()):
            m = TOKEN.match(text, end)
            if not m:
                raise ValueError(text)
            end = m.end()
            kind = "number" if m[1] else "name" if m[2] else "sign"
            word = SAME.get(m[m.lastindex], m[m.lastindex])
            # letters that are no known name are factors: "xy" is x times y
            if kind == "name" and word not in CALLS and word not in NAMES and word not in ("pi", "frac", "left", "right", "*", "/"):
                self.tokens += [("name", letter) for letter in word]
            elif word not in ("left", "right"):
                self.tokens.append(("sign" if word in "*/^" else kind, word))

    def next(self, *words: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][1] in words and self.tokens[self.at][0] == "sign":
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def value(self) -> complex:
        out = self.sum()
        if self.at < len(self.tokens):
            raise ValueError("left over")
        return out

    def sum(self) -> complex:
        out = self.product()
        while sign := self.next("+", "-"):
            out = out + self.product() if sign == "+" else out - self.product()
        return out

    def product(self) -> complex:
        out = self.signed()
        while True:
            if sign := self.next("*", "/"):
                out = out * self.signed() if sign == "*" else out / self.signed()
            elif self.at < len(self.tokens) and (self.tokens[self.at][0] != "sign" or self.tokens[self.at][1] in "({["):
                out *= self.power()
            else:
                return out

    def signed(self) -> complex:
        if sign := self.next("+", "-"):
            return self.signed() if sign == "+" else -self.signed()
        return self.power()

    def power(self) -> complex:
        out = self.atom()
        if self.next("^"):
            out **= self.signed()
        while self.next("!"):
            out = complex(math.gamma(out.real + 1))
        return out

    def closed(self, opener: str) -> complex:
        out = self.sum()
        if not self.next({"(": ")", "{": "}", "[": "]", "|": "|"}[opener]):
            raise ValueError("not closed")
        return out

    def atom(self) -> complex:
        if opener := self.next("(", "{", "["):
            return self.closed(opener)
        if self.next("|"):
            return complex(abs(self.closed("|")))
        if self.at == len(self.tokens):
            raise ValueError("ends early")
        kind, word = self.tokens[self.at]
        self.at += 1
        if kind == "number":
            return complex(float(word))
        if word == "frac":
            above = self.argument()
            return above / self.argument()
        if word == "sqrt" and self.next("["):
            order = self.closed("[")
            return self.argument() ** (1 / order)
        if word in CALLS:
            return complex(CALLS[word](self.argument()))
        if word == "pi":
            return complex(self.pi)
        if kind != "name":
            raise ValueError(word)
        return NAMES.get(word, complex(self.point + (ord(word[0]) % 61) / 17))

    def argument(self) -> complex:
        """A group in braces, or a single digit or name, as \\frac12 has."""
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "number" and len(self.tokens[self.at][1]) > 1 and self.tokens[self.at][1].isdigit():
            word = self.tokens[self.at][1]
            self.tokens[self.at] = ("number", word[1:])
            return complex(float(word[0]))
        return self.power()


@lru_cache(maxsize=4096)
def values(text: str, pi: float) -> tuple[complex, ...] | None:
    """A term's values at POINTS; null for what is no term or has no value."""
    try:
        return tuple(Term(text, p, pi).value() for p in POINTS)
    except (ValueError, ArithmeticError, IndexError, RecursionError, TypeError):
        return None


def number(text: str) -> float | None:
    try:
        return float(text.replace("{,}", "").replace(",", "")) if re.search(r"\d", text) else None
    except ValueError:
        return None


OPENS, CLOSES = "([{", ")]}"


def parts(text: str, separator: str = ",") -> list[str]:
    """The text cut at separators outside brackets. An interval's brackets close each other whatever their kind."""
    out, depth, begin = [], 0, 0
    for i, c in enumerate(text):
        depth += (c in OPENS) - (c in CLOSES)
        if depth == 0 and text.startswith(separator, i):
            out.append(text[begin:i])
            begin = i + len(separator)
    return [x.strip() for x in [*out, text[begin:]]]


def enclosed(text: str) -> bool:
    """Whether one pair of round or square brackets, or an interval's mixed one, goes around all of it."""
    if len(text) < 2 or text[0] not in "([" or text[-1] not in ")]":
        return False
    depth = 0
    for i, c in enumerate(text):
        depth += (c in OPENS) - (c in CLOSES)
        if depth == 0:
            return i == len(text) - 1
    return False


def matrix(text: str) -> list[list[str]] | None:
    """The rows of a LaTeX matrix, of Matrix([[...]]) or of nested lists."""
    m = re.fullmatch(r"\\begin\{([pbvB]?)matrix\}(.*)\\end\{\1matrix\}", text, re.DOTALL)
    if m:
        return [[x.strip() for x in row.split("&")] for row in re.split(r"\\\\+", m[2]) if row.strip()]
    body = text.removeprefix("Matrix").strip()
    body = body[1:-1].strip() if text.startswith("Matrix") and enclosed(body) and body[0] == "(" else body
    if not (enclosed(body) and body[0] == "[" and body[1:].lstrip()[:1] == "["):
        return None
    rows = parts(body[1:-1])
    return [parts(row[1:-1]) for row in rows] if all(enclosed(row) and row[0] == "[" for row in rows) else None


def cleaned(text: str) -> str:
    text = re.sub(r"(?<!\\)\\(left|right|[!,;: ])", "", text.strip())
    text = re.sub(r"^\$(.*)\$$", r"\1", text, flags=re.DOTALL).strip()
    text = re.sub(r"^\$(?=\d)|(?<=\d)\\?%$", "", text)
    return re.sub(r"^(\d+)(\.0*)?_\{?\d+\}?$", r"\1", text)


def structurally_equal(given: str, truth: str, pi: float = math.pi, tolerance: float = 1e-4, percent: bool = True) -> bool:
    """Whether two answers are the same number, list, matrix or term.

    A number may also be a hundredth or the hundredfold of the true one. Lists need equal brackets, unless one
    has none; Point(...) is a list in round ones. Numbers and the values of terms are equal within a relative tolerance.
    """
    a, b = cleaned(given), cleaned(truth)
    if a.lower() == b.lower() or re.sub(r"\s", "", a) == re.sub(r"\s", "", b):
        return True
    x, y = number(a), number(b)
    near = lambda p, q: p == q or (cmath.isfinite(p) and cmath.isfinite(q) and abs(p - q) <= tolerance * max(abs(p), abs(q)))
    # a comma may part a number's thousands, or the members of a list of two
    if x is not None and y is not None:
        return any(near(x, q) for q in ((y / 100, y, y * 100) if percent else (y,)))
    if not a or not b:
        return False
    m, n = matrix(a), matrix(b)
    if m is not None and n is not None:
        return len(m) == len(n) and all(len(r) == len(s) and all(structurally_equal(u, v, pi, tolerance, percent) for u, v in zip(r, s, strict=True)) for r, s in zip(m, n, strict=True))
    a, b = a.removeprefix("Point"), b.removeprefix("Point")
    one, two = (parts(re.sub(r"\\cup|∪", "∪", t), "∪") for t in (a, b))
    if len(one) > 1 or len(two) > 1:  # a union of intervals, in the order given
        return len(one) == len(two) and all(structurally_equal(u, v, pi, tolerance, percent) for u, v in zip(one, two, strict=True))
    outer = [(t[0], t[-1]) if enclosed(t) and len(parts(t[1:-1])) > 1 else None for t in (a, b)]
    lists = [parts(t[1:-1]) if o else parts(t) for t, o in zip((a, b), outer, strict=True)]
    if len(lists[0]) > 1 or len(lists[1]) > 1:
        fit = outer[0] == outer[1] or None in outer
        return fit and len(lists[0]) == len(lists[1]) and all(structurally_equal(u, v, pi, tolerance, percent) for u, v in zip(*lists, strict=True))
    if a.count("=") == 1 and b.count("=") == 1:
        (p, q), (r, s) = (t.split("=") for t in (a, b))
        u, v = values(f"({p})-({q})", pi), values(f"({r})-({s})", pi)
        return u is not None and v is not None and (all(map(near, u, v)) or all(near(g, -h) for g, h in zip(u, v, strict=True)))
    if a.count("=") == 1 and len(a.split("=")[0].strip()) <= 2 and "=" not in b:
        a = a.split("=")[1]
    if b.count("=") == 1 and len(b.split("=")[0].strip()) <= 2 and "=" not in a:
        b = b.split("=")[1]
    u, v = values(a, pi), values(b, pi)
    return u is not None and v is not None and all(map(near, u, v))


FRACTION = re.compile(r"^-?[0-9]+.?/0*[1-9][0-9]*.?$")
INTEGER = re.compile(r"^-?\d+$")


def parts_agree(given: str, truth: str) -> bool:
    """Whether normal answers agree part by part: fractions must be written alike, an integer needs an integer, terms equal values."""
    if not given or not truth:
        return False
    one, two = (parts(t[1:-1]) if enclosed(t) else [t] for t in (given, truth))
    if len(one) != len(two) or (len(two) > 1 and (given[0], given[-1]) != (truth[0], truth[-1])):
        return False
    for a, b in zip(one, two, strict=True):
        if FRACTION.match(a) and FRACTION.match(b):
            same = a == b
        elif bool(INTEGER.match(a)) != bool(INTEGER.match(b)):
            same = False
        else:
            u, v = values(a, math.pi), values(b, math.pi)
            same = a == b or (u is not None and v is not None and all(abs(p - q) <= 1e-9 * max(1, abs(p), abs(q)) for p, q in zip(u, v, strict=True)))
        if not same:
            return False
    return True


@F.pandas_udf(BooleanType())
def _graded(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
    for given, truth, plain, plain_truth in batches:
        out = []
        for a, b, p, q in zip(given, truth, plain, plain_truth, strict=True):
            pis = (math.pi, 3.14) if "\\pi" in a or "\\pi" in b else (math.pi,)
            out.append(parts_agree(p, q) or any(structurally_equal(a, b, pi) for pi in pis))
        yield pd.Series(out, dtype=bool)


def graded(answers: DataFrame, given: str, truth: str, out: str = "correct") -> DataFrame:
    """The rows with a column that tells whether an answer is the true one.

    It is if both are written alike once they are plain, agree part by part, or are equal in structure with either value
    of pi. Null is equal to nothing. Only answers that aren't written alike have work in Python; no rows move.
    """
    known = answers.withColumns({"_plain": plain_answer(F.col(given)), "_plain_truth": plain_answer(F.col(truth))})
    alike = (maths.latex_normal(F.col(given)) == maths.latex_normal(F.col(truth))) | (F.col("_plain") == F.col("_plain_truth"))
    known = known.withColumn("_alike", F.coalesce(alike, F.lit(True)))
    asked = {f"_ask{i}": F.when(~F.col("_alike"), F.col(c)).otherwise("") for i, c in enumerate((given, truth, "_plain", "_plain_truth"))}
    known = known.withColumns(asked).withColumn("_asked", _graded(*asked))
    verdict = F.when(F.col(given).isNull() | F.col(truth).isNull(), F.lit(False)).when(F.col("_alike"), F.lit(True)).otherwise(F.col("_asked"))
    return known.select(*[answers[c] for c in answers.columns], verdict.alias(out))


def scored(solutions: DataFrame, solution: str, truth: str) -> DataFrame:
    """The rows with answer, correct and form: form is met by a right answer, or by a second step and a box."""
    found = solutions.withColumn("answer", found_answer(F.col(solution))["answer"])
    form = F.contains(F.col(solution), F.lit("Step 2:")) & F.contains(F.col(solution), F.lit("\\box"))
    return graded(found, "answer", truth).withColumn("form", F.col("correct") | F.coalesce(form, F.lit(False)))
