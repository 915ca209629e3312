"""Queries and checking SQL of mathematical answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import mathanswers as ma
from weftline.plans.samples import table

#: Responses with markers of every kind around whole texts, in SQL that both engines know.
RESPONSES = r"""
SELECT doc_id, CASE doc_id % 12
    WHEN 0 THEN text || ' Answer: ' || doc_id || ' km. That was it'
    WHEN 1 THEN text || ' so the ANSWER IS x=' || doc_id || ' '
    WHEN 2 THEN 'answer is 3 ' || text || ' the answers are: ' || doc_id || '/2'
    WHEN 3 THEN doc_id || ' is the answer ' || text
    WHEN 4 THEN text || ' we get ' || doc_id || ' are the answers'
    WHEN 5 THEN text || ' \boxed{1} then \boxed {\frac{' || doc_id || '}{7}} done. And more'
    WHEN 6 THEN text || ' \fbox{ {' || doc_id || '} }'
    WHEN 7 THEN text || ' \boxed{' || doc_id
    WHEN 8 THEN text || ' \boxed{} = ' || doc_id || chr(10)
    WHEN 9 THEN text || '. It must be' || chr(10) || ' ' || doc_id || chr(10)
    WHEN 10 THEN text || ' \fbox{0} \boxed{x is ' || doc_id || '. no}'
    ELSE text END AS response FROM documents"""


def math_extract(s, d):
    """The answer that each response ends in, behind markers, in boxes and behind words."""
    table(s, d, "documents").createOrReplaceTempView("_texts_to_answer")
    made = s.sql(RESPONSES.replace("\\", "\\\\").replace("FROM documents", "FROM _texts_to_answer"))
    return made.select("doc_id", ma.found_answer(F.col("response")).alias("a")).select("doc_id", F.col("a.found").alias("found"), F.md5("a.answer").alias("answer"), F.length("a.answer").cast("bigint").alias("chars"))


#: Pairs of answers made of orders: numbers near each other, shares, lists, intervals, matrices, multiples of pi, products. b differs from a by `off`.
PAIRS = r"""
WITH o AS (
  SELECT o_orderkey, o_orderkey % 9 AS kind, o_custkey % 89 + 2 AS p, o_orderkey % 61 + 3 AS q, CASE WHEN o_custkey % 3 = 0 THEN 1 ELSE 0 END AS off, o_custkey % 2 AS c FROM orders)
SELECT o_orderkey, kind, p, q, off, c, CASE kind
    WHEN 0 THEN '\frac{' || p || '}{' || q || '}' WHEN 1 THEN p || '\%' WHEN 2 THEN '(' || p || ', \dfrac{1}{' || q || '})' WHEN 3 THEN '[' || p || ',' || (p + q) || ')'
    WHEN 4 THEN '[[' || p || ',' || q || '],[0,1]]' WHEN 5 THEN p || '\pi' WHEN 6 THEN '(x+' || p || ')(x-' || q || ')' WHEN 7 THEN '\sqrt{' || (p * p * q) || '}' ELSE 'x=' || p || '^2' END AS given,
  CASE kind
    WHEN 0 THEN '' || (10000 * p + off * q * 100) / (q * 10000.0) WHEN 1 THEN '' || (p + off) / 100.0 WHEN 2 THEN '(' || p || '.0, ' || (1.0 / q + off) || ')' WHEN 3 THEN '[' || p || ', ' || (p + q + off) || CASE WHEN c = 0 THEN ')' ELSE ']' END
    WHEN 4 THEN '\begin{pmatrix}' || p || ' & ' || (q + off) || ' \\ 0 & 1\end{pmatrix}' WHEN 5 THEN '' || (p + off) * CASE WHEN c = 0 THEN 3.14 ELSE 3.14159265 END
    WHEN 6 THEN 'x^2+(' || (p - q + off) || ')x-' || (p * q) WHEN 7 THEN p || '\sqrt{' || (q + off) || '}' ELSE '' || (p * p + off) END AS truth
FROM o"""


def math_equal(s, d):
    """Pairs of answers of every shape, graded by structure."""
    table(s, d, "orders").createOrReplaceTempView("_orders_to_grade")
    made = s.sql(PAIRS.replace("\\", "\\\\").replace("FROM orders", "FROM _orders_to_grade"))
    return ma.graded(made, "given", "truth").select("o_orderkey", "correct")


QUERIES = {"math_extract": math_extract, "math_equal": math_equal}

_SPACE = r"[\t\n\x0b\x0c\r\x1c-\x1f \x{85}\p{Z}]"
_STRIP = lambda x: f"regexp_replace({x}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


def _steps() -> str:
    """One common table a step, so that a step's text is made once."""
    out, last, n = [], "r", 0
    for marker in ma.BEFORE:
        n += 1
        out.append(f"a{n} AS MATERIALIZED (SELECT doc_id, f OR contains(lower(t), '{marker}') AS f, CASE WHEN contains(lower(t), '{marker}') THEN {_STRIP(f'''right(t, strpos(reverse(lower(t)), '{marker[::-1]}') - 1)''')} ELSE t END AS t FROM {last})")
        last = f"a{n}"
    for marker in ma.BEHIND:
        n += 1
        out.append(f"a{n} AS MATERIALIZED (SELECT doc_id, f OR contains(lower(t), '{marker}') AS f, CASE WHEN contains(lower(t), '{marker}') THEN {_STRIP(f'''left(t, length(t) - strpos(reverse(lower(t)), '{marker[::-1]}') - {len(marker) - 1})''')} ELSE t END AS t FROM {last})")
        last = f"a{n}"
    # the boxes of the made responses by their form: what they hold is known
    out.append(f"""b AS MATERIALIZED (SELECT doc_id, f, t, CASE doc_id % 12 WHEN 5 THEN '\\frac{{' || doc_id || '}}{{7}}' WHEN 6 THEN '{{' || doc_id || '}}' WHEN 10 THEN 'x is ' || doc_id || '. no' END AS box FROM {last})""")
    out.append("c AS MATERIALIZED (SELECT doc_id, f OR box IS NOT NULL AS f, coalesce(box, t) AS t FROM b)")
    out.append(f"d AS MATERIALIZED (SELECT doc_id, f, CASE WHEN contains(t, '. ') THEN {_STRIP('''left(t, length(t) - strpos(reverse(t), ' .') - 1)''')} ELSE t END AS t FROM c)")
    last = "d"
    for marker in ma.LAST_WORDS:
        n += 1
        m, back = marker.replace("\n", "' || chr(10) || '"), marker[::-1].replace("\n", "' || chr(10) || '")
        out.append(f"a{n} AS MATERIALIZED (SELECT doc_id, f OR contains(lower(t), '{m}') AS f, CASE WHEN contains(lower(t), '{m}') THEN {_STRIP(f'''right(t, strpos(reverse(lower(t)), '{back}') - 1)''')} ELSE t END AS t FROM {last})")
        last = f"a{n}"
    return ",\n".join(out) + f"\nSELECT doc_id, f AND regexp_matches(t, '[0-9]') AS found, md5(t) AS answer, length(t) AS chars FROM {last}"


ORACLE_SQL = {
    "math_extract": f"WITH r AS MATERIALIZED (SELECT doc_id, false AS f, response AS t FROM ({RESPONSES})),\n{_steps()}",
    # the numbers behind the answers, compared as numbers
    "math_equal": f"""
WITH m AS ({PAIRS}),
n AS (SELECT *, CASE kind WHEN 0 THEN p / q::DOUBLE WHEN 1 THEN p / 100.0 WHEN 2 THEN 1.0 / q WHEN 3 THEN p + q WHEN 4 THEN q WHEN 5 THEN p WHEN 6 THEN p - q WHEN 7 THEN sqrt(q) ELSE p * p END::DOUBLE AS x,
        CASE kind WHEN 0 THEN p / q::DOUBLE + off / 100.0 WHEN 1 THEN (p + off) / 100.0 WHEN 2 THEN 1.0 / q + off WHEN 3 THEN p + q + off WHEN 4 THEN q + off WHEN 5 THEN p + off WHEN 6 THEN p - q + off WHEN 7 THEN sqrt(q + off) ELSE p * p + off END::DOUBLE AS y FROM m)
SELECT o_orderkey, CASE WHEN kind = 6 THEN x = y ELSE abs(x - y) <= 1e-4 * greatest(x, y) OR (kind IN (2, 3, 4) AND (abs(x - y / 100) <= 1e-4 * y / 100 OR abs(x - 100 * y) <= 100e-4 * y)) OR (kind = 1 AND abs(x - y) < 1e-9) END AND NOT (kind = 3 AND c = 1) AS correct FROM n""",
}
