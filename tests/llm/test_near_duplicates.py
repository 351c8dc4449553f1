from __future__ import annotations

import random
import re

import numpy as np
import pytest

from rungmill.llm import near_duplicates as nd

WORD = re.compile(r"[^\W_]+")


def brute(rows, num, den):
    sets = [(t, i, set(WORD.findall(x.lower()))) for t, i, x in rows if x is not None]
    out = set()
    for k, (t, i, a) in enumerate(sets):
        for u, j, b in sets[:k]:
            if t == u and a and b and len(a & b) * den >= num * len(a | b):
                out.add((t, min(i, j), max(i, j)))
    return out


def texts(seed, n=160, vocabulary=60):
    rnd = random.Random(seed)
    rows = []
    for k in range(n):
        if rows and rnd.random() < 0.5:
            w = rnd.choice(rows)[2].split()
            for _ in range(rnd.randrange(0, 4)):
                w[rnd.randrange(len(w))] = f"w{rnd.randrange(vocabulary)}"
            if rnd.random() < 0.3:
                rnd.shuffle(w)
        else:
            w = [f"w{rnd.randrange(vocabulary) if rnd.random() < 0.7 else rnd.randrange(10**6)}" for _ in range(rnd.randrange(1, 26))]
        rows.append((rnd.randrange(2), k, " ".join(w)))
    return rows


def run(spark, rows, num=7, den=10, **kw):
    df = spark.createDataFrame([(t, i, x, 0, "s") for t, i, x in rows], "tbl int, id long, text string, n int, words string")
    got = [tuple(r) for r in nd.near_duplicate_pairs(df, num, den, **kw).collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize(("seed", "num", "den"), [(1, 7, 10), (2, 8, 10), (3, 1, 2)])
def test_against_all_pairs(spark, seed, num, den):
    rows = texts(seed)
    assert run(spark, rows, num, den) == brute(rows, num, den)


def test_records_with_too_many_combinations(spark, monkeypatch):
    monkeypatch.setattr(nd, "MOST_OFFERS", 4)
    monkeypatch.setattr(nd, "KEY_COST", -1.0)
    rows = texts(4, 120, 40)
    assert run(spark, rows) == brute(rows, 7, 10)


def test_edges(spark):
    long = " ".join(f"v{k}" for k in range(3000))
    rows = [(0, 1, None), (0, 2, ""), (0, 3, "?!"), (0, 4, "A b"), (1, 4, "a B"), (0, 5, "b a!"), (0, 6, long), (0, 7, long + " more"), (0, 8, "b, a a")]
    assert run(spark, rows) == {(0, 4, 5), (0, 4, 8), (0, 5, 8), (0, 6, 7)}
    assert run(spark, []) == set()


def test_large_classes_are_stars(spark):
    rows = [(0, k, "one two three four five six seven") for k in range(6)] + [(0, 9, "one two three four five six")]
    assert run(spark, rows, expand_limit=3) == {(0, 0, k) for k in range(1, 6)} | {(0, 0, 9)}


def test_only_equal_texts_are_stars(spark):
    """Other orders and spellings of a word set keep all their pairs; with the classes the pairs of equal texts can be rebuilt."""
    w = "one two three four five six seven".split()
    rows = [(0, k, " ".join(w[k:] + w[:k])) for k in range(6)] + [(0, k, " ".join(w).upper()) for k in range(10, 15)] + [(0, 20, " ".join(w[:6])), (0, 21, "other"), (0, 22, "?!"), (0, 23, "?!")]
    shown = [*range(6), 10]
    got = run(spark, rows, expand_limit=4)
    assert got == {(0, a, b) for a in shown for b in shown if a < b} | {(0, a, 20) for a in shown} | {(0, 10, k) for k in range(11, 15)}
    df = spark.createDataFrame(rows, "tbl int, id long, text string")
    classes = [tuple(r) for r in nd.near_duplicate_classes(df, 4).collect()]
    assert sorted(classes) == [(0, k, 10) for k in range(10, 15)]
    members = {10: range(10, 15)}
    whole = {(0, min(x, y), max(x, y)) for _, a, b in got | {(0, 10, 10)} for x in members.get(a, [a]) for y in members.get(b, [b]) if x != y}
    assert whole == brute(rows, 7, 10)


def test_prefix_lengths():
    sim = nd.Similarity(7, 10)
    n = np.arange(1, 200)
    for m in (1, 2, 3):
        ok = sim.most_words(n) >= m
        least = -(-7 * n // 10)
        assert (sim.probe_length(n, m)[ok] == (n - least + m)[ok]).all() and (sim.offer_length(n, m) <= sim.probe_length(n, m)).all()


def test_keys_in_several_passes(spark, monkeypatch):
    """With bitmaps too small for all keys at once each range of keys has its own pass."""
    monkeypatch.setattr(nd, "KEY_BITS", 1 << 16)
    rows = texts(5)
    assert run(spark, rows) == brute(rows, 7, 10)


def test_sizes_in_classes(spark, monkeypatch):
    """Larger sets, whose sizes share classes; near sets differ in size as far as the similarity lets them."""
    rnd = random.Random(6)
    rows = []
    for k in range(40):
        w = [f"w{rnd.randrange(3000)}" for _ in range(rnd.randrange(30, 140))]
        rows += [(0, 3 * k, " ".join(w)), (0, 3 * k + 1, " ".join(w[: int(len(w) * rnd.uniform(0.66, 1))])), (0, 3 * k + 2, " ".join(w[int(len(w) * rnd.uniform(0, 0.34)) :]))]
    assert run(spark, rows) == brute(rows, 7, 10)
