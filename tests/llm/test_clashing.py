"""Extra columns whose names the operators use themselves are kept, values and all, by every stage."""

import random

import pytest
from pyspark.sql import functions as F

from weftline.llm import bpe, language, matroska, merkle, mixing, quality, repeats, simhash, warc

NAMES = (
    "row", "text_key", "src", "key", "copies", "nth", "k1", "k2", "kept", "doc_id_2", "text_key_2", "src_2", "_id", "_src", "_key", "_copy", "_copies", "_text_key", "_a", "_b", "_k1", "_k2",
    "_kept", "hash", "root", "node", "least", "most", "total", "n", "label", "_label", "held_out", "score", "predicted", "ids", "decoded", "fingerprint", "bucket", "ghost", "digest", "size", "spot",
    "class", "begins", "rate", "target", "start", "content", "best", "rows", "stays", "times", "a.b", "per", "x`y", "_part", "next_text", "edited", "media",
)


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    long = " ".join(word() for _ in range(90))
    rows = [(i, " ".join(word() for _ in range(40)).capitalize() + ".", "en", f"s{i % 2}", 1) for i in range(24)]
    rows += [(100, long, "en", "s0", 1), (101, long, "en", "s1", 1), (102, long + " end", "en", None, 1), (None, None, None, None, None), (None, None, None, None, None), (103, "", "en", "s0", 0), (103, "", "en", "s0", 0)]
    rows += [(110 + i, word() + " " + long[:300] + " " + word(), "en", "s1", 1) for i in range(3)]
    base = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    extra = [F.concat_ws("/", F.lit(name), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(name) for name in NAMES]
    return base.select("*", *extra)


def kept(out, docs):
    assert out.columns == docs.columns
    got = out.collect()
    for r in got:
        assert all(r[name] == f"{name}/{'none' if r.doc_id is None else r.doc_id}" for name in NAMES)
    return got


def test_stages_keep_clashing_columns(spark, docs, tmp_path):
    import corpus_pipeline

    labels = spark.createDataFrame([(i, 1, 0) for i in range(24)] + [(100, 0, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = kept(stage(spark, docs, str(tmp_path)), docs)
        assert got, name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == docs.count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), str(tmp_path)).count() == 0


def test_operators_ignore_clashing_columns(spark, docs):
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    same = lambda f: sorted(map(tuple, f(docs).collect()), key=str) == sorted(map(tuple, f(plain).collect()), key=str)
    assert same(lambda d: simhash.near_duplicates(d).select("doc_id", "fingerprint", "component_id"))
    assert same(mixing.mix) and same(repeats.removed) and same(merkle.edits) and same(language.identify)
    assert same(lambda d: matroska.features(matroska.encode(d)))
    import public_tokenizers as P

    tokens = lambda d: bpe.digests(d, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    assert same(tokens) and tokens(docs.limit(0)).count() == 0
    assert same(lambda d: quality.scores(d, quality.fit([], quality.np.zeros(0))))


def test_repeated_pages(spark):
    from weftline.llm.common import shared_folder

    path = shared_folder(spark, "t")
    pages = [(1, "u", "x" * 200)] * 3 + [(2, "v", "x" * 200), (3, "w", "short"), (3, "w", "short")]
    warc.write_warc(spark.createDataFrame(pages, "page_id long, url string, html string"), path)
    got = sorted((r.page_id, r.record_type, r.refers_to) for r in warc.page_records(spark, path).collect())
    assert [g for g in got if g[0] == 2] == [(2, "revisit", 1)] and [g for g in got if g[0] == 3] == [(3, "response", None)] * 2 and len([g for g in got if g[0] == 1]) == 3


def test_language_bundles_by_brute_force():
    rng = random.Random(22)
    texts = ["", None, "a", "Ab  ba!", "12 3", *("".join(rng.choice("abcé ñ.,1\n") for _ in range(rng.randint(1, 60))) for _ in range(30))]
    vectors, has = language.bundle(texts)
    for text, got, some in zip(texts, vectors, has, strict=True):
        slots = []
        for c in f" {text or ''} ":
            s = ord(c.lower()[0]) if c.isalpha() else 0
            if s or not slots or slots[-1]:
                slots.append(s)
        want = language.np.zeros(language.DIM)
        grams = [g for g in zip(slots, slots[1:], slots[2:], strict=False) if any(g)]
        for g in grams:
            bound = language.np.ones(language.DIM)
            for place, s in enumerate(g):
                bound = bound * language.np.roll(language.np.random.default_rng([9, s]).choice(language.np.array([-1, 1], language.np.int8), 1024), place)
            want = want + bound
        assert some == bool(grams) and language.np.array_equal(got, want.astype(language.np.float32))


def test_no_two_letters_share_a_vector():
    letters = [c for c in range(0x30, 0x2FFF) if chr(c).isalpha() and chr(c).lower()[:1] == chr(c)]
    assert len({language.letter_vector(c).tobytes() for c in [0, *letters]}) == len(letters) + 1
    codes = language.letters_of(language.np.array([*map(ord, "bweézyæäùöáüçBWEÉ 1.İ")]))
    assert len(set(codes[:13].tolist())) == 13 and codes[13:17].tolist() == codes[:4].tolist() and codes[17:20].tolist() == [0, 0, 0]


def test_rows_of_one_id_are_spread(spark):
    """A hundred thousand rows of one id, and as many of none: no bucket, window or partition holds more than a small share of them."""
    rows = spark.range(200_000).select(F.when(F.col("id") % 2 == 0, F.lit(7)).alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"), F.lit("s").alias("source"))
    rows = rows.unionByName(spark.range(50).select(F.col("id").alias("doc_id"), F.lit("few words").alias("text"), F.lit("s").alias("source")))
    tied = rows.withColumn("tie", F.md5("text"))
    sizes = merkle.bucketed(tied, "tie").groupBy("bucket").count().agg(F.max("count"), F.count("bucket")).first()
    assert sizes[0] < 2000 and sizes[1] > 150
    assert mixing.decided(rows).agg(F.sum("copies")).first()[0] > 200_000
    placed = rows.select(F.md5(F.concat_ws(":", F.lit("17"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5("text"))).alias("spot"))
    assert placed.groupBy(F.substring("spot", 1, 2)).count().agg(F.max("count")).first()[0] < 1200


def test_neighbours_of_one_id_with_many_rows(spark):
    import hashlib

    rows = [(i, f"t{i}") for i in range(40)] + [(20, f"many {i}") for i in range(3000)] + [(39, f"last {i}") for i in range(1500)] + [(10**12, "far")]
    tied = spark.createDataFrame(rows, "doc_id long, text string").withColumn("tie", F.md5("text"))
    got = {r.text: r.next_text for r in merkle.with_next(tied, ["text"], "tie").collect()}
    order = sorted(rows, key=lambda r: (-r[0], hashlib.md5(r[1].encode()).hexdigest()))
    assert got == {t: order[(k + 1) % len(order)][1] for k, (_, t) in enumerate(order)}


def test_neighbours_of_rows_without_ids(spark):
    rows = [(None, f"text {i}") for i in range(2600)] + [(7, f"seven {i}") for i in range(5)] + [(3, "three")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    tied = docs.withColumn("tie", F.md5("text"))
    got = {r.text: r.next_text for r in merkle.with_next(tied, ["text"], "tie").collect()}
    import hashlib

    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashlib.md5(r[1].encode()).hexdigest()))
    assert got == {t: order[(k + 1) % len(order)][1] for k, (_, t) in enumerate(order)}
    assert tied.transform(lambda d: merkle.bucketed(d, "tie")).where("doc_id is null").select("bucket").distinct().count() == 3


def test_media_features_by_brute_force(spark):
    import hashlib

    texts = ["", "a", "é" * 700, "x" * 131_073, "ab" * 65_536 + "\x00\xff"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in matroska.features(matroska.encode(docs)).collect():
        raw = texts[r.doc_id].encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\x00")
        media = matroska.mux(payload)
        level = [b - 128 for b in payload]
        bands = [sum(b // 16 == k for b in payload) for k in range(16)]
        crossings = sum((x < 0) != (y < 0) for x, y in zip(level, level[1:], strict=False))
        cluster = matroska.FRAME * matroska.LACED * matroska.PER_CLUSTER
        mean, rms = sum(level) / len(level), (sum(v * v for v in level) / len(level)) ** 0.5
        want = f"packets={-(-len(payload) // matroska.FRAME)};cues={-(-len(payload) // cluster)};mean={mean:.6f};rms={rms:.6f};crossings={crossings};bands={','.join(map(str, bands))}"
        assert (r.media_bytes, r.media_sha256, r.feature) == (len(media), hashlib.sha256(media).hexdigest(), want)
