"""Merkle trees over sections, paragraphs and pieces, in DataFrame operations only.

Blank lines part sections, line breaks part paragraphs, and a paragraph is cut into
pieces of a fixed number of characters, the leaves. A node is the MD5 of its
children's digests, so equal roots mean equal texts and unequal branches lead to
the edits. A fingerprint is "root/tree": the tree has the first 8 hex digits of
every node, a section as "digest:paragraphs" and a paragraph as "digest-leaves", with "." between
paragraphs and "/" between sections. Two trees are compared from the top: only where sections
differ are their paragraphs compared, and only where these differ their leaves.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import small_or_shuffled

PIECE = 32
#: Rows that one window of neighbours should hold.
BUCKET_ROWS = 1000
BOUNDS = 255


def fingerprint(text: str, piece: int = PIECE) -> Column:
    """The fingerprint of a string expression; null counts as empty."""
    leaves = f"transform(regexp_extract_all(p, '(?s).{{1,{piece}}}', 0), x -> md5(x))"
    paragraph = f"transform(array({leaves}), ls -> named_struct('n', md5(array_join(ls, '')), 't', concat(left(md5(array_join(ls, '')), 8), '-', array_join(transform(ls, l -> left(l, 8)), ''))))[0]"
    paragraphs = f"transform(split(s, '\\n'), p -> {paragraph})"
    section = f"transform(array({paragraphs}), ps -> named_struct('n', md5(array_join(transform(ps, q -> q.n), '')), 't', concat(left(md5(array_join(transform(ps, q -> q.n), '')), 8), ':', array_join(transform(ps, q -> q.t), '.'))))[0]"
    sections = f"transform(split(coalesce({text}, ''), '\\n\\n'), s -> {section})"
    return F.expr(
        f"transform(array({sections}), ss -> concat(md5(array_join(transform(ss, q -> q.n), '')), '/', array_join(transform(ss, q -> q.t), '/')))[0]"
    )


def leaves_of(fp: Column) -> Column:
    leaves = F.regexp_replace(F.substring(fp, 34, 2**31 - 1), "[0-9a-f]{8}[:-]", "")
    return F.array_distinct(F.regexp_extract_all(leaves, F.lit("[0-9a-f]{8}"), F.lit(0)))


def likeness(a: str, b: str) -> Column:
    """Twice the common leaves over all leaves of two fingerprints (columns); 1 for equal roots."""
    x, y = leaves_of(F.col(a)), leaves_of(F.col(b))
    common, total = F.size(F.array_intersect(x, y)), F.size(x) + F.size(y)
    return F.when(F.col(a) == F.col(b), F.lit(1.0)).when(total == 0, F.lit(0.0)).otherwise(2.0 * common / total)


def _branches(a: str, b: str, sections: str, paragraphs: str, pieces: str, label: str) -> str:
    """Labels of the leaves that differ, found from the top: i, j and k run over what `sections`, `paragraphs` and `pieces` say."""
    leaf = lambda p: f"substring({p}, 10 + 8 * k, 8)"
    within = f"transform(filter({pieces}, k -> NOT {leaf('w.p')} <=> {leaf('w.q')}), k -> {label})"
    below = f"transform(array(named_struct('p', coalesce(get(y.ps, j), ''), 'q', coalesce(get(y.qs, j), ''))), w -> if(left(w.p, 8) = left(w.q, 8), array(), {within}))[0]"
    split_ = "named_struct('ps', split(substring(coalesce(get(z.s, i), ''), 10), '[.]'), 'qs', split(substring(coalesce(get(z.t, i), ''), 10), '[.]'))"
    inner = f"if(left(coalesce(get(z.s, i), ''), 8) = left(coalesce(get(z.t, i), ''), 8), array(), transform(array({split_}), y -> flatten(transform({paragraphs}, j -> {below})))[0])"
    return f"""CASE WHEN left({a}, 32) = left({b}, 32) THEN array() ELSE
      transform(array(named_struct('s', split(substring({a}, 34), '/'), 't', split(substring({b}, 34), '/'))), z -> flatten(transform({sections}, i -> {inner})))[0] END"""


def _upto(n: str) -> str:
    return f"if({n} > 0, sequence(0, cast({n} as int) - 1), cast(array() as array<int>))"


def differing(a: str, b: str) -> Column:
    """Where two fingerprints (columns) differ: structs of section, paragraph and piece, from 0, in the first tree or the second; none for equal or null ones.

    A paragraph with no leaf on either side that differs counts as its piece 0.
    """
    pieces = _upto("greatest(1, floor((greatest(length(w.p), length(w.q)) - 9) / 8))")
    return F.coalesce(F.expr(_branches(a, b, _upto("greatest(size(z.s), size(z.t))"), _upto("greatest(size(y.ps), size(y.qs))"), pieces, "named_struct('section', i, 'paragraph', j, 'piece', k)")), F.array())


def pieces_changed(a: str, b: str) -> Column:
    """The pieces of fingerprint b (columns) that a doesn't have at their place, as "section.paragraph.piece" from 0, joined by commas; none for null ones."""
    found = _branches(a, b, _upto("size(z.t)"), _upto("size(y.qs)"), _upto("floor((length(w.q) - 9) / 8)"), "concat_ws('.', i, j, k)")
    return F.array_join(F.coalesce(F.expr(found), F.array().cast("array<string>")), ",")


def fingerprints(docs: DataFrame, piece: int = PIECE) -> DataFrame:
    """doc_id and fingerprint of every row. No shuffle. Null texts count as empty; repeated rows and long texts are rows like others."""
    return docs.select("doc_id", fingerprint("text", piece).alias("fingerprint"))


def bucketed(docs: DataFrame, tie: str, rows: int = BUCKET_ROWS) -> DataFrame:
    """The documents with a bucket that ascends with doc_id and holds about `rows` rows.

    Up to 256 quantiles are taken, which are numbers of fixed size on the driver;
    between two of them buckets are of equal width. An id that makes up several quantiles
    has buckets of its own, by the hex digits of `tie`, which orders its rows; so have null ids, below 0.
    """
    shares = [i / (BOUNDS + 1) for i in range(BOUNDS + 2)]
    n, every, found = docs.agg(F.count("doc_id"), F.count(F.lit(1)), F.percentile_approx("doc_id", shares, 10_000)).first()
    # a larger bucket comes first, a smaller tie as well
    by_tie = lambda places: F.floor((1 - F.conv(F.left(tie, F.lit(7)), 16, 10).cast("bigint") / F.lit(1 << 28)) * places - F.lit(1e-9)).cast("bigint")
    places = max(1, -(-(every - n) // rows))
    nameless = by_tie(F.lit(places)) - F.lit(places)
    if not found:
        return docs.withColumn("bucket", nameless)
    times = Counter(found)
    low = sorted(times)
    per = max(1, -(-n // (rows * max(1, len(low) - 1))))
    own = [-(-times[v] * n // ((BOUNDS + 2) * rows)) if times[v] > 2 else 0 for v in low]
    most = max(own)
    listed = lambda xs: F.array(*[F.lit(int(x)).cast("bigint") for x in xs])
    part = F.greatest(F.size(F.filter(listed(low), lambda b: b <= F.col("doc_id"))), F.lit(1)) - 1
    at = lambda xs: F.get(listed(xs), F.col("_part"))
    width = [max(1, -(-(b - a) // per)) for a, b in zip(low, [*low[1:], low[-1] + 1], strict=True)]
    inner = F.least(F.greatest(F.floor((F.col("doc_id") - at(low)) / at(width)), F.lit(0)), F.lit(per))
    within = F.when((F.col("doc_id") == at(low)) & (at(own) > 0), by_tie(at(own))).otherwise(most + inner)
    bucket = F.when(F.col("doc_id").isNull(), nameless).otherwise(F.col("_part") * (per + 1 + most) + within).cast("bigint")
    return docs.withColumn("_part", part).withColumn("bucket", bucket).drop("_part")


def with_next(docs: DataFrame, columns: list[str], tie: str) -> DataFrame:
    """Each row with next_<column> of the next row by descending doc_id (after the last: the first).

    Rows with equal doc_id follow in the order of column `tie` (hex digits), null ids last. Rows
    are shuffled once, by bucket; the first row of each bucket is copied to the
    bucket before it, so that neighbours are found within buckets.
    """
    kept = list(dict.fromkeys([tie, *columns]))
    placed = bucketed(docs, tie)
    firsts = placed.groupBy("bucket").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), (-F.col("doc_id")).alias("m"), F.col(tie).alias("t"))).alias("f"))
    down = Window.orderBy(F.col("bucket").desc())
    ghosts = firsts.select(
        F.col("bucket").alias("own"), (-F.col("f.m")).alias("first_id"), F.col("f.t").alias("first_tie"), F.coalesce(F.lag("bucket").over(down), F.min("bucket").over(Window.partitionBy())).alias("to")
    )
    spots = F.when(F.col("to").isNull(), F.array(F.struct("bucket", F.lit(0).alias("ghost")))).otherwise(
        F.array(F.struct("bucket", F.lit(0).alias("ghost")), F.struct(F.col("to").alias("bucket"), F.lit(1).alias("ghost")))
    )
    first = (F.col("bucket") == F.col("own")) & (F.col(tie) == F.col("first_tie")) & F.col("doc_id").eqNullSafe(F.col("first_id"))
    rows = placed.join(small_or_shuffled(ghosts, 72), first, "left").select(
        "doc_id", *kept, F.explode(spots).alias("spot")
    ).select("doc_id", *kept, "spot.bucket", "spot.ghost")
    order = Window.partitionBy("bucket").orderBy("ghost", F.col("doc_id").desc_nulls_last(), tie)
    nexts = {f"next_{c}": F.lead(c).over(order) for c in columns}
    return rows.withColumns(nexts).where("ghost = 0").drop("bucket", "ghost")


def edits(docs: DataFrame, piece: int = PIECE) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are.

    In the edited text the last third of the characters (rounded down) are replaced
    by as many from the start of the next document by descending doc_id, or by all
    of it if it is shorter. Null texts are empty: with no leaves they are like
    nothing but an equal text. Equal doc_ids follow each other by their texts'
    digests; a single document is its own next one; no rows give no rows. A text's
    fingerprint is made once, and its neighbour takes it from there. Column
    `edited_pieces` lists the branches of the edited tree that differ.
    """
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).select(
        "doc_id", "text", fingerprint("text", piece).alias("fingerprint")
    )
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.left("text", F.col("n_chars").cast("int") - cut), F.left("next_text", cut))
    return (
        with_next(texts.withColumn("tie", F.md5("text")), ["text", "fingerprint"], "tie")
        .withColumn("n_chars", F.length("text").cast("bigint"))
        .withColumn("edited", edited)
        .withColumn("edited_fingerprint", fingerprint("edited", piece))
        .select(
            "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
            likeness("fingerprint", "edited_fingerprint").alias("near_edited"),
            likeness("fingerprint", "next_fingerprint").alias("near_next"),
            pieces_changed("fingerprint", "edited_fingerprint").alias("edited_pieces"),
        )
    )


_FP = """(list_transform([list_transform(string_split({t}, chr(10) || chr(10)), lambda s:
  list_transform([list_transform(string_split(s, chr(10)), lambda p:
    list_transform([list_transform(regexp_extract_all(p, '(?s).{{1,32}}'), lambda x: md5(x))], lambda ls:
      {{'n': md5(array_to_string(ls, '')), 't': left(md5(array_to_string(ls, '')), 8) || '-' || array_to_string(list_transform(ls, lambda l: left(l, 8)), '')}})[1])], lambda ps:
    {{'n': md5(array_to_string(list_transform(ps, lambda q: q.n), '')), 't': left(md5(array_to_string(list_transform(ps, lambda q: q.n), '')), 8) || ':' || array_to_string(list_transform(ps, lambda q: q.t), '.')}})[1])], lambda ss:
  md5(array_to_string(list_transform(ss, lambda q: q.n), '')) || '/' || array_to_string(list_transform(ss, lambda q: q.t), '/'))[1])"""
_TREE = "regexp_replace(substr({f}, 34), '[0-9a-f]{{8}}[:-]', '', 'g')"
_LEAVES = f"list_distinct(regexp_extract_all({_TREE}, '[0-9a-f]{{{{8}}}}'))"


_LABELS = """flatten(list_transform(string_split(regexp_replace(substr({f}, 34), '[0-9a-f]{{8}}[:-]', '', 'g'), '/'), lambda s, i: flatten(list_transform(string_split(s, '.'), lambda p, j:
  list_transform(range(0, length(p) // 8), lambda k: (i - 1)::VARCHAR || '.' || (j - 1)::VARCHAR || '.' || k::VARCHAR || '=' || substr(p, (8 * k + 1)::BIGINT, 8))))))"""


def _near(a: str, b: str) -> str:
    x, y = _LEAVES.format(f=a), _LEAVES.format(f=b)
    return f"CASE WHEN {a} = {b} THEN 1.0 WHEN len({x}) + len({y}) = 0 THEN 0.0 ELSE 2.0::DOUBLE * len(list_intersect({x}, {y})) / (len({x}) + len({y})) END::DOUBLE"


ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (
  SELECT *, coalesce(lead(text) OVER (ORDER BY doc_id DESC), first_value(text) OVER (ORDER BY doc_id DESC)) AS next_text,
         length(text) AS n_chars
  FROM d),
e AS (SELECT *, left(text, n_chars - n_chars // 3) || left(next_text, n_chars // 3) AS edited FROM n),
f AS (
  SELECT doc_id, n_chars, sha256(edited) AS edited_sha256, {_FP.format(t='text')} AS fingerprint,
         {_FP.format(t='edited')} AS edited_fingerprint, {_FP.format(t='next_text')} AS next_fingerprint
  FROM e),
g AS (SELECT *, {_LABELS.format(f='fingerprint')} AS old, {_LABELS.format(f='edited_fingerprint')} AS new FROM f)
SELECT doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
       {_near('fingerprint', 'edited_fingerprint')} AS near_edited, {_near('fingerprint', 'next_fingerprint')} AS near_next,
       array_to_string(list_transform(list_filter(new, lambda x: NOT list_contains(old, x)), lambda x: string_split(x, '=')[1]), ',') AS edited_pieces
FROM g
"""
