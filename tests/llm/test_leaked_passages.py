from __future__ import annotations

import random
import re

import pytest

from rungmill.llm import leaked_passages as lp

WORD = re.compile(r"[^\W_]+")


def longest(a, b):
    best = 0
    for i in range(len(a)):
        for j in range(len(b)):
            k = 0
            while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
                k += 1
            best = max(best, k)
    return best


def run(spark, docs, items):
    d = spark.createDataFrame([(*x, "x", 1) for x in docs], "doc_id long, text string, words string, id int")
    e = spark.createDataFrame([(*x, "x", 1) for x in items], "item_id long, text string, words string, id int")
    return {(r["doc_id"], r["item_id"]): r for r in lp.leaked_passages(d, e).collect()}


def test_against_all_pairs(spark):
    rnd = random.Random(1)
    word = lambda: f"w{rnd.randrange(400)}"
    items = [(k, " ".join(word() for _ in range(rnd.randrange(8, 40)))) for k in range(12)]
    docs = []
    for k in range(80):
        text = [word() for _ in range(30)]
        source = rnd.choice(items)[1].split()
        at, n = rnd.randrange(len(source)), rnd.randrange(7, 20)
        text[10:10] = source[at : at + n]
        docs.append((k, rnd.choice([" ", ", ", "\n- "]).join(w.upper() if rnd.random() < 0.2 else w for w in text)))
    got = run(spark, docs, items)
    split = lambda t: WORD.findall(t.lower())
    want = {(d, i): n for d, t in docs for i, s in items if (n := longest(split(t), split(s))) >= 10}
    assert {k: r["longest_run"] for k, r in got.items() if r["longest_run"] >= 10} == want


def test_replaced_words(spark):
    item = [f"a{k}" for k in range(30)]
    changed = [w if k % 8 != 6 else "other" for k, w in enumerate(item)]
    got = run(spark, [(1, " ".join(changed))], [(5, " ".join(item))])
    assert got[(1, 5)]["longest_run"] == 7 and got[(1, 5)]["matched_words"] == 27


def _recall(spark, patterns):
    """Share of overlaps with these replaced words (False) that are found with all of their equal words."""
    items = [(k, " ".join(f"a{k}x{j}" for j in range(len(p)))) for k, p in enumerate(patterns)]
    docs = [(k, "before " + " ".join(f"a{k}x{j}" if ok else f"z{k}x{j}" for j, ok in enumerate(p)) + " after") for k, p in enumerate(patterns)]
    got = run(spark, docs, items)
    return sum((k, k) in got and got[k, k]["matched_words"] == sum(p) for k, p in enumerate(patterns)) / len(patterns)


def test_every_nth_word_replaced(spark):
    assert _recall(spark, [[(j + start) % n != 0 for j in range(48)] for n in range(2, 15) for start in range(n)]) == 1.0


@pytest.mark.parametrize(("rate", "least"), [(0.1, 0.99), (0.2, 0.98), (0.33, 0.93)])
def test_words_replaced_at_random(spark, rate, least):
    rnd = random.Random(rate)
    patterns = []
    while len(patterns) < 400:
        p = [True]
        while len(p) < 19:
            p.append(not (p[-1] and rnd.random() < rate))
        p.append(True)
        if sum(p) >= 10:
            patterns.append(p)
    assert _recall(spark, patterns) >= least


def test_repetitive_texts(spark):
    """Every shift is a hit; each compares an item's length of words, not the document."""
    got = run(spark, [(1, "la " * 30_000), (2, "la " * 9)], [(5, "la " * 12)])
    assert {k: (r["longest_run"], r["matched_words"]) for k, r in got.items()} == {(1, 5): (12, 12)}


def test_items_too_many_to_send(spark, monkeypatch):
    item = " ".join(f"a{k}" for k in range(20))
    docs, items = [(1, "x " + item), (2, "other words"), (3, item[:60])], [(5, item), (6, item + " b")]
    want = run(spark, docs, items)
    monkeypatch.setattr(lp, "MOST_SENT", 0)
    assert run(spark, docs, items) == want and set(want) == {(1, 5), (1, 6), (3, 5), (3, 6)}


def test_all_overlaps_of_a_diagonal(spark):
    item = [f"a{k}" for k in range(60)]

    def kept(*runs):
        return " ".join(w if any(lo <= k < hi for lo, hi in runs) else f"x{k}" for k, w in enumerate(item))

    docs = [(1, kept((0, 8), (10, 15), (16, 21), (22, 27))), (2, kept((0, 12), (20, 28), (29, 37), (38, 46))), (3, kept((0, 10), (12, 20)))]
    got = run(spark, docs, [(5, " ".join(item))])
    assert {k[0]: (r["longest_run"], r["matched_words"]) for k, r in got.items()} == {1: (5, 15), 2: (12, 24), 3: (10, 10)}


def test_edges(spark):
    item = " ".join(f"a{k}" for k in range(12))
    nine = " ".join(f"a{k}" for k in range(9))
    docs = [(1, None), (2, ""), (3, nine + " x"), (4, item), (5, item), (6, ("b " * 50_000) + item + " " + item)]
    got = run(spark, docs, [(7, item), (8, item), (9, nine), (10, None), (11, "")])
    assert {k for k, r in got.items() if r["longest_run"] >= 10} == {(d, i) for d in (4, 5, 6) for i in (7, 8)}
    assert run(spark, [], [(7, item)]) == {} and run(spark, docs, []) == {}
