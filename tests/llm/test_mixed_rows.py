"""Every row of the mix keeps its own copies, whether or not ids tell rows apart."""

from collections import Counter

from weftline.llm import mixing


def test_rows_without_ids_keep_their_own_copies(spark):
    rows = [(None, f"w{i} " * (5 + i % 3), "s", i) for i in range(300)] + [(7, "same row", "s", 0)] * 40 + [(8, None, "s", 1), (8, "", "s", 2)]
    rows += [(1000 + i, "other words here", "t", i) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n int")
    for cycle in ((1, 9), (1, 2)):
        due, got = Counter(), Counter()
        for r in mixing.decided(docs, cycle=cycle).collect():
            due[r.doc_id, r.src[1:], r.text_key] += r.copies
        keyed = mixing.mixed(docs, cycle=cycle)
        assert keyed.columns == docs.columns
        for r in keyed.withColumn("text_key", mixing.text_key()).collect():
            got[r.doc_id, r.source, r.text_key] += 1
        assert got == +due
        assert 0 < sum(n for (i, _, _), n in got.items() if i is None) < 2 * 300
