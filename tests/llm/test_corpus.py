"""The corpus operators against brute force, on small tables with nulls, empties, ties and odd columns."""

import base64
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from weftline.llm import bpe, components, language, lyndon, matroska, merkle, mixing, quality, repeats, simhash, warc, wavelet
from weftline.llm.common import shared_folder
from weftline.llm.pieces import Memo
from weftline.llm.words import BLOCK, PATTERN, BatchEncoder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, k1 string, bucket int, size int, copies int"
JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")


def table(spark, rows):
    """(doc_id, text, lang, source) with further columns whose names clash with those the operators make."""
    return spark.createDataFrame([(i, t, g, s, len(t or ""), "x", "y", 1, 2, 3) for i, t, g, s in rows], SCHEMA)


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    long = words(rng, 3000)
    passage = words(rng, 120)
    out = [(1, None, "en", "a"), (2, "", "en", None), (3, "  \n ", None, "a"), (4, "one", "fr", "b"), (5, long, "en", "a"), (6, long, "en", "a"), (7, long + " end", "en", "c")]
    out += [(8, words(rng, 50) + "\n" + passage + "\n" + words(rng, 60), "en", "a"), (9, passage, "fr", "b"), (10, "x" * 900, "en", "c"), (11, "日本語。" * 300, None, None), (11, "日本語。" * 300, None, None)]
    out += [(20 + i, words(rng, rng.randint(0, 120)), "en", rng.choice(["a", "a", "b", None])) for i in range(20)]
    out.append((None, "an id is missing here", "en", "a"))
    return out


def test_warc_round_trip_over_many_ranges(spark, tmp_path):
    rng = random.Random(1)
    big = bytes(rng.randrange(32, 127) for _ in range(30_000)).decode()
    pages = [(5, "u\r\nX: y", big), (3, None, big), (9, "u9", big), (4, "u4", None), (6, "u6", ""), (7, "u7", "short"), (8, "u8", "short"), (None, "un", big), (10, "é", "é" * 60), (11, "e", "é" * 60)]
    pages += [(100 + i, f"u{i}", "\x1f\x8b\x08 WARC/1.1 \r\n\r\n" + big[: i * 100]) for i in range(60)]
    path = shared_folder(spark, "t")
    warc.write_warc(spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("payload", F.lit(1)), path)
    want = {}
    first = {}
    for p, _, h in pages:
        if len((h or "").encode()) >= 100 and p is not None:
            first[h] = min(first.get(h, p), p)
    for p, _, h in pages:
        raw = (h or "").encode()
        f = first.get(h) if len(raw) >= 100 else None
        want[p] = (len(raw), hashlib.sha256(raw).hexdigest(), "response" if f in (None, p) else "revisit", None if f in (None, p) else f)
    assert {r[0]: tuple(r)[1:] for r in warc.page_records(spark, path).collect()} == want
    for split in (700, 5000):
        got = warc.read_warc(spark, path, split).where("warc_type = 'response'").select("record_id", F.sha2("payload", 256)).collect()
        assert Counter(got) == Counter(warc.read_warc(spark, path).where("warc_type = 'response'").select("record_id", F.sha2("payload", 256)).collect())
        assert len(got) == sum(v[2] == "response" for v in want.values())
    assert warc.member(b"\x00" * (1 << 24))[-1] == 0
    empty = shared_folder(spark, "t")
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), empty)
    assert warc.page_records(spark, empty).count() == 0


def test_matroska_lacing_and_unknown_sizes(spark, rows):
    rng = random.Random(2)
    for n in (0, 1, 63, 64, 65, 4096, 200_001):
        payload, size = matroska.padded("z" * n)
        media = matroska.mux(payload)
        parsed = matroska.demux(media)
        assert size == n and len(payload) % 64 == 0 and matroska.samples(media, parsed["packets"]) == payload
        assert [p[3] for p in parsed["packets"]] == sorted(p[3] for p in parsed["packets"])
        for _, _, at in parsed["cues"]:
            assert media[at : at + 4] == matroska.CLUSTER.to_bytes(4, "big")
    frames = [bytes([i]) * rng.choice([1, 300, 70_000]) for i in range(8)]
    flag, body = matroska.laced(frames)
    kind, spans = matroska.frames_of(body, 0, len(body), flag)
    assert kind == "ebml" and [body[a : a + n] for a, n in spans] == frames
    xiph = bytes([2, 255, 45, 1]) + b"a" * 300 + b"b" + b"c" * 9
    assert matroska.frames_of(xiph, 0, len(xiph), 0b010) == ("xiph", [(4, 300), (304, 1), (305, 9)])
    cluster = matroska.uint(matroska.TIMESTAMP, 7) + matroska.element(matroska.BLOCK_GROUP, matroska.element(matroska.BLOCK, b"\x81\x00\x01\x00abc") + matroska.uint(matroska.REFERENCE_BLOCK, 1))
    unknown = lambda i: i.to_bytes(4, "big") + b"\x01" + b"\xff" * 7
    parsed = matroska.demux(unknown(matroska.SEGMENT) + unknown(matroska.CLUSTER) + cluster + unknown(matroska.CLUSTER) + cluster)
    assert [(p[1], p[3], p[4], p[7]) for p in parsed["packets"]] == [(0, 8_000_000, False, 3), (1, 8_000_000, False, 3)]
    got = matroska.features(matroska.encode(table(spark, rows))).collect()
    assert len(got) == len(rows)
    for r in got:
        texts = [(t or "").encode() for i, t, _, _ in rows if i == r.doc_id]
        payload = texts[0].ljust(max(64, -(-len(texts[0]) // 64) * 64), b"\x00")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(texts[0]), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    packets = matroska.packets(matroska.encode(table(spark, rows)).union(spark.createDataFrame([(0, 0, None), (0, 0, bytearray(b"\x1a\x45"))], "doc_id long, n_bytes long, media binary")))
    assert packets.groupBy("doc_id").count().count() == len({r[0] for r in rows})
    assert matroska.features(matroska.encode(table(spark, rows).limit(0))).count() == 0
    whole = matroska.mux(b"a" * 4096)
    odd = spark.createDataFrame([(1, 0, None, 5), (2, 0, bytearray(), 5), (3, 0, bytearray(b"\x1a\x45"), 5), (4, 9, bytearray(whole), 5)], "doc_id long, n_bytes long, media binary, feature int")
    assert [(r.doc_id, r.payload_bytes, r.feature is None) for r in matroska.features(odd).sort("doc_id").collect()] == [(1, None, True), (2, None, True), (3, None, True), (4, 4096, False)]


def reference_encoder():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    return lambda text: t.encode(text, add_special_tokens=False).ids


ODD = ["", "  ", "a  b   c\n\n d \n e", "aaaa bbbb ", "\x00 a\x00b", "don't  we'll   a   b\x1c \x1d c", "<|endoftext|> hi,", "a <|endoftext|> b", "x<|endoftext|>y\nz", "a <|endoftext |> b", "averyveryverylongword " * 3 + "averyveryvexylongword " * 2 + "end", "日本語テキスト," * 100, "a ,b ., c_. d.,e f,g ½. ٣, ok", "\t\tx  y  z", "x" * 3000]


def test_pieces_and_memo():
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice("ab'sdt \n\t1.,_é日½!") for _ in range(rng.randint(0, 50))) for _ in range(1500)]
    encode = reference_encoder()
    texts += ["word " * (BLOCK // 5) + "end", None, "one", "a\nb c\nd", *(words(rng, 30).replace(" ab", "\nab") for _ in range(300))]
    rng.shuffle(texts)
    peer = BatchEncoder(JSON, most=500)
    for part in (texts, texts[:1], ["", None], texts[3:9], texts):
        ids, counts = peer.encode(part, 2)
        ends = np.cumsum(counts).tolist()
        assert [ids[e - n : e].tolist() for e, n in zip(ends, counts.tolist(), strict=True)] == [[*encode(t or ""), 2] for t in part]
    assert P.PATTERN == PATTERN
    calls = []
    memo = Memo(lambda ps: calls.append(len(ps)) or [p * 2 for p in ps], most=3)
    for ps in ({"a", "b"}, {"a", "c", "d", "e"}, {"a", "f"}, {"g"}, {"a", "z"}):
        known = memo.learn(set(ps))
        assert all(known[p] == p * 2 for p in ps)
    assert len(memo.young) + len(memo.old) <= 10


def test_wavelet_queries():
    rng = np.random.default_rng(4)
    for ids in (rng.integers(0, 50257, 70_000), np.full(10, 7), np.array([2]), rng.integers(0, 3, 5000), np.array([], np.int64), np.array([70_000, 0, 70_000])):
        shard = wavelet.Shard(wavelet.build(ids.astype("<u4"), {"docs": [(1, len(ids), 0)]}))
        assert shard.decode().tolist() == ids.tolist()
        for i in {0, len(ids) // 2, len(ids) - 1} if len(ids) else ():
            t = int(ids[i])
            assert shard.access(i) == t and shard.count(t) == int((ids == t).sum()) and shard.count(t, i) == int((ids[:i] == t).sum())
            assert len(ids) > 10_000 and shard.count(t) > 5000 or shard.places(t) == np.flatnonzero(ids == t).tolist()
        assert shard.count(99_999_999) == 0 and shard.places(99_999_999) == []
        with pytest.raises(IndexError):
            shard.access(len(ids))


def test_wavelet_shards(spark, rows):
    encode = reference_encoder()
    docs = table(spark, rows)
    path = shared_folder(spark, "t")
    wavelet.write_shards(docs, path, JSON, 2, shard_tokens=1000)
    got = wavelet.read_documents(spark, path).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start, want = 0, Counter()
    for i, t, _, _ in order:
        ids = np.array([*encode(t or ""), 2], "<u4")
        want[i, start, len(ids), zlib.crc32(ids.tobytes())] += 1
        start += len(ids)
    assert Counter(map(tuple, got)) == want
    assert wavelet.lookup(spark, path, 2).agg(F.sum("count")).first()[0] == len(rows)
    empty = shared_folder(spark, "t")
    wavelet.write_shards(docs.limit(0), empty, JSON, 2)
    assert wavelet.read_documents(spark, empty).count() == 0


def test_bpe(spark, rows):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    peer = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec = bpe.codec(RANKS, P.PATTERN)
    rng = random.Random(6)
    texts = ODD + ["".join(rng.choice("abcdefgh") for _ in range(2000)), "ab" * 3000] + ["".join(rng.choice("ab'sdt \n\t1.,_é日½!") for _ in range(rng.randint(0, 60))) for _ in range(1000)]
    for t, ids in zip(texts, codec.encode_texts(texts), strict=True):
        assert ids.tolist() == peer.encode_ordinary(t) and codec.decode(ids) == t.encode()
    got = bpe.digests(table(spark, rows), RANKS, P.PATTERN).collect()
    assert len(got) == len(rows)
    for r in got:
        t = next(t or "" for i, t, _, _ in rows if i == r.doc_id)
        ids = peer.encode_ordinary(t)
        assert tuple(r)[1:] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    back = bpe.decode(bpe.encode(table(spark, rows).withColumn("ids", F.lit(1)), RANKS, P.PATTERN), RANKS, P.PATTERN)
    assert back.where(F.col("decoded").cast("string") != F.coalesce("text", F.lit(""))).count() == 0


def brute_fingerprint(text, k=4):
    import re

    import xxhash

    raw = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    w = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    grams = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [b" ".join(w)] if w else []
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def roots_of(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


def test_simhash_components(spark, rows):
    got = simhash.near_duplicates(table(spark, rows)).collect()
    prints = {(i, t): brute_fingerprint(t) for i, t, _, _ in rows}
    values = sorted(set(prints.values()))
    roots = roots_of(values, [(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 4])
    least = {}
    for (i, _), f in prints.items():
        if i is not None:
            least[roots[f]] = min(least.get(roots[f], i), i)
    by_id = {}
    for (i, _), f in prints.items():
        by_id[i] = (f"{f:016x}", least.get(roots[f]))
    assert len(got) == len(rows)
    assert all((r.fingerprint, r.component_id) == by_id[r.doc_id] for r in got)
    kept = simhash.one_of_each(table(spark, rows))
    assert kept.columns == table(spark, rows).columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) and {5, 11, None} <= set(ids) and not {2, 3, 6} & set(ids)
    assert simhash.near_duplicates(table(spark, rows).limit(0)).count() == 0


def test_ball_links_lose_no_component():
    rng = np.random.default_rng(7)
    centre = rng.integers(0, 2**64, 12, np.uint64)
    fps = [int(c) for c in centre]
    for c in centre:
        for _ in range(25):
            x = int(c)
            for b in rng.choice(64, rng.integers(1, 7), replace=False):
                x ^= 1 << int(b)
            fps.append(x)
    fps = np.unique(np.array(fps, np.uint64))
    edges = []
    for bits in (3, 12):
        edges = []
        for bucket in range(1 << bits):
            there = np.diff(simhash.Ball(2, bits).by_class(bits)[1]) > 0
            own = fps[there[(simhash.Ball(2, bits).hash(fps) & ((1 << bits) - 1)) ^ bucket]]
            if len(own):
                a, b = simhash.links(own, bucket, 2, bits)
                edges += list(zip(a.tolist(), b.tolist(), strict=True))
        nodes = [int(x) for x in fps]
        want = roots_of(nodes, [(a, b) for a in nodes for b in nodes if a < b and (a ^ b).bit_count() <= 4])
        assert roots_of(nodes, edges) == want
        assert all((a ^ b).bit_count() <= 4 for a, b in edges)


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1001 + i) for i in range(300)] + [(5000, 5000), (6001, 6000)]
    got = {r.node: r.root for r in components.stars(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = roots_of(sorted({x for e in edges for x in e}), edges)
    assert got == {n: r for n, r in want.items() if n != r}
    assert components.stars(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, opened, left = {}, set(names), 1.5 * sum(sizes.values())
    while opened:
        total = sum(weight[s] for s in opened)
        over = [s for s in opened if left * weight[s] / total > 2 * sizes[s]]
        if not over:
            target |= {s: left * weight[s] / total for s in opened}
            break
        for s in over:
            target[s] = 2 * sizes[s]
            opened.discard(s)
        left = 1.5 * sum(sizes.values()) - sum(target.values())
    return target


def test_mixing(spark, rows):
    rng = random.Random(8)
    many = rows + [(1000 + i, "w " * rng.choice([1, 3, 50, 400]), "en", rng.choice(["a", "a", "a", "b", "z", None])) for i in range(600)]
    got = mixing.mix(table(spark, many)).collect()
    assert len(got) == len(many)
    sizes, taken = Counter(), Counter()
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert 0 <= r.copies <= 2 and r.taken == r.copies * r.size
    for s, t in brute_targets(sizes).items():
        assert {round(r.target, 6) for r in got if r.source == s} == {round(t, 6)}
        assert {r.source_size for r in got if r.source == s} == {sizes[s]}
        assert abs(taken[s] - t) <= max(0.05 * t, 3200)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(table(spark, many)).collect()), key=str)
    mixed = mixing.mixed(table(spark, many))
    assert mixed.count() == sum(r.copies for r in got) or abs(mixed.count() - sum(r.copies for r in got)) <= 2
    assert mixing.mix(table(spark, rows).limit(0)).count() == 0 and mixing.mix(table(spark, [(1, None, None, "a")])).first().taken == 0


def test_suffix_arrays():
    rng = random.Random(9)
    for _ in range(3000):
        k = rng.choice([1, 2, 20])
        s = bytes(rng.randint(0, k) for _ in range(rng.randint(0, 40)))
        assert lyndon.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])
    for _ in range(200):
        texts = [bytes(rng.randint(97, 98) for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(1, 5))]
        for n in (3, 8, 12):
            c = Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
            assert [x.tolist() for x in lyndon.repeated_starts(texts, n)] == [[c[t[i : i + n]] > 1 for i in range(len(t) - n + 1)] for t in texts]


def brute_repeats(texts, n):
    c = Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - n + 1):
            if c[t[i : i + n]] > 1:
                gone[i : i + n] = True
        out.append((len(t), int(gone.sum()), len(repeats.runs(gone)), hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("most", [1 << 19, 2000, 1])
def test_repeats(spark, rows, most, monkeypatch):
    monkeypatch.setattr(repeats, "GROUP_BYTES", most)
    monkeypatch.setattr(repeats, "BLOCK", 8192)
    rng = random.Random(10)
    text = words(rng, 400)
    more = rows + [(300 + i, words(rng, 20) + text[i * 40 : i * 40 + 700] + words(rng, 20), "en", "a") for i in range(12)] + [(400, "ab" * 450, "en", "a"), (401, text[:300] + text[:300], "en", "b")]
    for length in (400, 60, 1000):
        found = repeats.removed(table(spark, more), length)
        got = Counter(map(tuple, found.drop("text").collect()))
        assert {r.doc_id: r.text for r in found.collect() if not r.n_removed} == {i: t or "" for i, t, _, _ in more if i in {r.doc_id for r in found.collect() if not r.n_removed}}
        want = Counter((i, *x) for (i, _, _, _), x in zip(more, brute_repeats([(t or "").encode() for _, t, _, _ in more], length), strict=True))
        assert got == want
    assert repeats.removed(table(spark, rows).limit(0)).count() == 0
    clean = repeats.without_repeats(table(spark, more), 60)
    assert clean.columns == table(spark, more).columns and clean.count() == len(more)
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert texts[1] is None and texts[4] == "one" and texts[400] == ""


def test_runs_of_one_byte(spark):
    run, other = "a" * 1_000_000, "b" * 999 + "".join(map(str, range(2000)))
    found = sum(len(repeats.segments([t.encode()], 400)["n"]) for t in (run, "ab" * 100_000))
    assert found < 400
    docs = spark.createDataFrame([(1, run), (2, "x" + "a" * 5000 + "y"), (3, other)], "doc_id long, text string")
    got = {r[0]: tuple(r)[1:4] for r in repeats.removed(docs, 1000).collect()}
    assert got == {1: (1_000_000, 1_000_000, 1), 2: (5002, 5000, 1), 3: (len(other), 0, 0)}


def test_quality(spark):
    rng = random.Random(11)
    good = [(i, words(rng, 80).capitalize() + ".", "en", "a") for i in range(150)]
    bad = [(i + 150, " ".join(w.upper() + "!!" for w in words(rng, 80).split()), "en", "a") for i in range(150)]
    docs = table(spark, good + bad + [(900, None, None, None), (901, "", None, None), (901, "", None, None), (None, "a b", None, None)])
    labels = spark.createDataFrame([(i, int(i < 150), 0) for i in range(300)] + [(5, None, 0), (99_999, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    got = quality.scores(docs, model).collect()
    assert len(got) == 304 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 300]
    assert sum(r.predicted == int(r.doc_id < 150) for r in held) >= 0.95 * len(held)
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert {r.doc_id: r.score for r in quality.scores(docs, quality.train(docs, flipped)).collect() if r.doc_id} == {r.doc_id: r.score for r in got if r.doc_id}
    index, value = quality.features("Some words, some WORDS!! 12")
    pairs = sum(float(model.factors[i] @ model.factors[j]) * a * b for k, (i, a) in enumerate(zip(index, value, strict=True)) for j, b in list(zip(index, value, strict=True))[k + 1 :])
    z = model.bias + float((model.weights[index] * value).sum()) + pairs
    assert abs(model.score([(index, value)])[0] - 1 / (1 + np.exp(-z))) < 1e-9
    assert quality.scores(docs, quality.train(docs, labels.limit(0))).where("score <> 0.5").count() == 0
    assert quality.accepted(docs, model).columns == docs.columns


def test_language(spark):
    rng = random.Random(12)
    make = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(60))
    rows = [(i, make("abcdefgh" if i % 2 else "éèklmnop"), "en" if i % 2 else "fr", "s") for i in range(200)]
    rows += [(900, None, "en", "s"), (901, "", "en", "s"), (902, "12 !? 3", "fr", "s"), (903, "a", None, "s"), (903, "a", None, "s"), (904, make("abcdefgh") * 4000, None, "s")]
    got = language.identify(table(spark, rows)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in got if r.doc_id in (900, 901, 902)} == {"und"}
    assert all(r.lang_pred == ("en" if r.doc_id % 2 else "fr") for r in got if r.doc_id < 200)
    assert next(r.lang_pred for r in got if r.doc_id == 904) == "en" and next(r.lang_pred for r in got if r.doc_id == 903) in ("en", "fr")
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert {r.lang_pred for r in language.identify(table(spark, rows).withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language.identify(table(spark, rows).limit(0)).count() == 0


def test_merkle(spark, rows):
    docs = table(spark, rows)
    got = merkle.edits(docs).collect()
    assert len(got) == len(rows)
    order = sorted([r for r in rows if r[0] is not None], key=lambda r: -r[0]) + [r for r in rows if r[0] is None]
    want = Counter()
    for k, (i, t, _, _) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        c = len(t) // 3
        want[i, len(t), hashlib.sha256((t[: len(t) - c] + after[:c]).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    by_id = {r.doc_id: r for r in got}
    assert by_id[5].fingerprint == by_id[6].fingerprint and by_id[6].near_next == 1.0 and by_id[5].near_edited > 0.5
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert by_id[1].fingerprint == by_id[2].fingerprint
    x, y = "p" * 40 + "\nq\n\nlast", "p" * 39 + "Z\nq\n\nlast one\n\nx"
    pair = spark.createDataFrame([(x, y)], "a string, b string").select(merkle.fingerprint("a").alias("x"), merkle.fingerprint("b").alias("y"))
    assert pair.select(merkle.pieces_changed("x", "y"), merkle.pieces_changed("x", "x")).first()[:] == ("0.0.1,1.0.0,2.0.0", "")
    assert merkle.edits(docs.limit(0)).count() == 0
    one = merkle.edits(table(spark, [(1, "abcdef", None, None)])).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()
    a, b = "p " * 40 + "\nq\n\nlast one", "p " * 40 + "\nQ\n\nlast one\nmore"
    where = spark.createDataFrame([(a, b)], "a string, b string").select(merkle.fingerprint("a").alias("x"), merkle.fingerprint("b").alias("y")).select(merkle.differing("x", "y")).first()[0]
    assert [(w.section, w.paragraph, w.piece) for w in where] == [(0, 1, 0), (1, 1, 0)]


def test_pipeline_stages_keep_columns(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(13)
    rows = [(i, words(rng, 60).capitalize() + ".", "en", f"s{i % 3}", 0) for i in range(60)] + [(60 + i, " ".join(w.upper() + "!!" for w in words(rng, 60).split()), "en", "s0", 0) for i in range(30)]
    rows += [(100, rows[3][1], "en", "s1", 0), (101, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 60), 0) for i in range(90)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now = docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        seen[name] = [r.doc_id for r in out.collect()]
        if name != "tokens":
            assert out.columns == docs.columns
            now = out
    assert sum(60 <= i < 90 for i in seen["quality"] if i is not None) <= 2
    assert 100 not in seen["near_duplicates"] and 3 in seen["near_duplicates"]
    assert sorted(map(str, seen["tokens"])) == sorted(map(str, seen["mix"]))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(seen["tokens"])
