from __future__ import annotations

import random

import pytest

from rungmill.llm import linking


def brute(pairs):
    up = {}
    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x
    for a, b in pairs:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


def cases():
    rnd = random.Random(3)
    order = rnd.sample(range(200), 120)
    yield "path", [(k, k + 1) for k in range(100)]
    yield "mixed path", list(zip(order, order[1:], strict=False))
    yield "star", [(500, k) for k in range(100)]
    yield "random", [(rnd.randrange(150), rnd.randrange(150)) for _ in range(110)]
    yield "dirty", [(None, 1), (2, None), (3, 3), (4, 5), (5, 4), (5, 4), (9, 8)]
    yield "empty", []


@pytest.mark.parametrize(("name", "pairs"), list(cases()))
def test_groups(spark, name, pairs):
    df = spark.createDataFrame([(a, b, 7) for a, b in pairs], "a long, b long, node int")
    got = linking.connected_groups(df).collect()
    assert {r["node"]: r["group"] for r in got} == brute(pairs) and len(got) == len(brute(pairs))


def test_valid_links(spark):
    pairs = spark.createDataFrame([(1, 2, 0.95), (2, 1, 0.99), (1, 3, 0.94), (1, 4, 0.99), (1, 5, 0.99), (1, 9, 1.0), (1, 1, 1.0), (None, 1, 1.0), (5, 6, float("nan")), (5, 6, None), (7, 8, 1.0)], "record_a long, record_b long, score double")
    meta = spark.createDataFrame([(1, "Self_Harm", "x"), (2, "self harm ", "x"), (3, "Self_Harm", "x"), (4, "Minors", "x"), (5, None, "x"), (6, None, "x"), (7, "", "x"), (8, "--", "x")], "record_ordinal long, category string, a string")
    assert sorted(tuple(r) for r in linking.valid_links(pairs, meta, 0.95).collect()) == [(1, 2), (7, 8)]
