"""Near copies against brute force over pairs."""

import random

from weftline.llm import near


def sets(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def changed(rng, w, times):
    w = list(w)
    for at in range(5, 5 + 24 * times, 24):
        w[at] = f"x{rng.random()}"
    return " ".join(w)


def test_near_copies_between_080_and_090(spark):
    import corpus_pipeline

    rng = random.Random(3)
    rows, originals = [(0, None), (1, " "), (2, "two words"), (3, "Two  words"), (None, "no id at all here now")], []
    for i in range(150):
        w = [f"w{rng.randrange(5000)}" for _ in range(200)]
        text = " ".join(w)
        originals.append((10 * i + 10, text))
        rows += [(10 * i + 10, text), (10 * i + 11, changed(rng, w, 3 + i % 6))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sizes = {i: sets(t) for i, t in rows}
    alike = lambda a, b: len(sizes[a] & sizes[b]) / len(sizes[a] | sizes[b])
    due = {i + 1 for i, _ in originals if alike(i, i + 1) >= 0.8}
    assert 20 < sum(alike(i - 1, i) < 0.9 for i in due) and len(due) < 150
    left = {r.doc_id for r in corpus_pipeline.no_near_duplicates(spark, docs, "").collect()}
    gone = set(sizes) - left
    assert gone - {1, 3} <= due and len(due - gone) <= len(due) // 20
    assert {1, 3} <= gone
    assert corpus_pipeline.no_near_duplicates(spark, docs.limit(0), "").count() == 0


def test_similarity_is_exact(spark):
    texts = ["a b c d e f g h i j", "a b c d e f g h i j", "a b c d e f g h i k", " ".join(map(str, range(13))), " ".join(map(str, range(12)))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ids = docs.select(near.F.col("doc_id").alias("node"), "doc_id", near.text_key().alias("text_key"))
    pairs = spark.createDataFrame([(0, 2, 0, 2), (3, 4, 3, 4), (0, 3, 0, 3)], "a long, b long, ra long, rb long")
    sets = near.shingle_sets(ids, docs)
    assert {tuple(r) for r in near.verified(pairs, sets).collect()} == {(3, 4, 3, 4)}


def test_large_bucket_of_copies_is_joined(spark):
    rng = random.Random(4)
    base = [f"w{rng.randrange(5000)}" for _ in range(400)]
    rows = [(0, " ".join(base))] + [(i, changed(rng, base, 1 + i % 2)) for i in range(1, 120)] + [(1000 + i, " ".join(f"u{rng.randrange(9000)}" for _ in range(300))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = {r.doc_id for r in near.without_near_copies(docs).collect()}
    assert left == {0} | {1000 + i for i in range(40)}


def components(rows, least=0.8):
    """Brute force over all pairs."""
    own, up = {i: sets(t) for i, t in rows}, {i: i for i, _ in rows}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in own.items():
        for j, b in own.items():
            if i < j and len(a & b) >= least * len(a | b):
                up[max(top(i), top(j))] = min(top(i), top(j))
    return {top(i) for i in own}


def test_large_bucket_with_lone_links(spark, monkeypatch):
    """Most of a large bucket is one component; a few of its texts are tied to it by one pair only, or to each other, or not at all."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(9000)}" for _ in range(300)]
    body, tail = base[:200], base[200:]
    rows = [(i, changed(rng, base, 1)) for i in range(150)]
    # far from the base, and a text halfway between: the only one that either is linked to
    for k in range(6):
        other = [f"v{k} {rng.randrange(9000)}" for _ in range(40)]
        far, half = " ".join(body + other), " ".join(body + tail[:60] + other[:10])
        rows += [(500 + 10 * k, far), (501 + 10 * k, half)]
    rows += [(900 + i, " ".join(body + [f"z{i} {rng.randrange(99)}" for _ in range(60)])) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    due = components(rows)
    assert 1 < len(due) < 40
    # every text in one bucket, so that what the bucket's search misses would show; small blocks and no small buckets
    monkeypatch.setattr(near, "BLOCK", 8)
    monkeypatch.setattr(near, "band_keys", lambda own: near.np.full(near.BANDS, 7, near.np.uint64))
    assert {r.doc_id for r in near.without_near_copies(docs).collect()} == due


def test_blocks_alone_find_every_link(spark, monkeypatch):
    """Without heads the blocks compare all pairs of a bucket, within blocks and across them."""
    rng = random.Random(9)
    rows = []
    for g in range(12):
        base = [f"g{g}w{rng.randrange(9000)}" for _ in range(120)]
        rows += [(100 * g + i, changed(rng, base, i % 4)) for i in range(9)]
    monkeypatch.setattr(near, "BLOCK", 8)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ids = docs.select(near.F.col("doc_id").alias("node"), "doc_id", near.text_key().alias("text_key"))
    placed = docs.select(near.F.lit(0).alias("nth"), near.F.lit(0).cast("bigint").alias("key"), near.F.col("doc_id").alias("node"), near.F.lit(100).alias("size"), near.F.col("doc_id").alias("root"))
    heads = near.main_roots(placed)
    got = {tuple(r) for r in near.linked_in_blocks(placed, heads, near.shingle_sets(ids, docs)).collect()}
    own = {i: sets(t) for i, t in rows}
    assert got == {(i, j) for i in own for j in own if i < j and len(own[i] & own[j]) >= 0.8 * len(own[i] | own[j])}
