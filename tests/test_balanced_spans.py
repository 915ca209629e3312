"""Balanced spans in two passes against a scan from each opener."""

import random
import time

from weftline.functions import jsons


def test_same_spans():
    rng = random.Random(8)
    for _ in range(4000):
        text = "".join(rng.choices('{}[]"\\\\ a1:,', k=rng.randint(0, 24)))
        due = [s for i, c in enumerate(text) if c in "{[" and (s := jsons.balanced_span(text, i))]
        assert list(jsons.balanced_spans(text)) == due, text


def test_many_openers_take_linear_time():
    began = time.perf_counter()
    assert jsons.first_json("{ " * 100_000) is None and jsons.first_json('say "{" ' * 50_000 + '{"a": [1]}') == '{"a":[1]}'
    assert time.perf_counter() - began < 5
