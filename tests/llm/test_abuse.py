from __future__ import annotations

import random

import numpy as np
import pytest

from rungmill.llm import abuse

GOOD = ["The caption names {}, yet the picture shows a mill.", "Rats are vermin, the {} granary says.", "A stupid mistake of mine: I swapped {} and the tram.", "With firelight, the harbour of {} looks calm.", "Our team stored 5 versions of {}."]
BAD = ["You are a worthless fool and nobody at {} can stand you.", "I hope you choke on that {}, you fool.", "Those people from {} are vermin and should be driven out."]


@pytest.mark.parametrize(("raw", "plain"), [("w.o.r.t.h.l.e.s.s fool", "worthless fool"), ("you j e r k", "you jerk"), ("1d1ot", "idiot"), ("looooser", "loser"), ("it is 1990, no. 7", "it is 1990, no. 7"), ("U.S.", "u.s.")])
def test_plain(raw, plain):
    assert abuse.plain(raw) == plain


def test_sentences():
    assert abuse.sentences('One. Two!\n\n- three "four." Five 。六。') == ["One.", "Two!", '- three "four.', "Five 。", "六。"]
    assert abuse.sentences("") == [] and abuse.sentences("...") == []


def corpus(seed, n):
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        name = f"Name{rnd.randrange(1000)}"
        s = [rnd.choice(GOOD).format(name) for _ in range(rnd.randrange(1, 8))]
        bad = rnd.random() < 0.3
        if bad:
            s.insert(rnd.randrange(len(s) + 1), rnd.choice(BAD).format(name))
        out.append((" ".join(s), bad))
    return out


def test_learns_sentences_from_documents():
    rnd = random.Random(0)
    train, held = corpus(1, 400), corpus(2, 200)
    targets = np.array([float(b != (rnd.random() < 0.08)) for _, b in train])  # reviewers err
    w = abuse.fit([t for t, _ in train], targets, np.ones(len(train)))
    p, text = abuse.score_texts([t for t, _ in held], w, abuse.Vectors())
    flagged = abuse.noisy_or(p, text, len(held)) >= 0.5
    right = sum(f == b for f, (_, b) in zip(flagged, held, strict=True))
    assert right >= 0.95 * len(held)
    for k, (t, b) in enumerate(held):
        if flagged[k] and b:
            assert any(word in abuse.sentences(t)[int(p[text == k].argmax())] for word in ("fool", "driven"))


@pytest.mark.parametrize("text", ["One two. Three!\n\n- four \"five.\" Six 。六九。 w.o.r.t.h y o u j e r k s", "a b c d e", "", "...", "1d1ot looooser it's no. 7?\rend", "x. y. z. e.g. this", "U.S. and 你好。世界 \0 z"])
def test_pieces_are_the_words_of_sentences(text):
    """Looking up pieces gives what the rules give for whole sentences."""
    flat, at = abuse.Vectors()._hashes(["before", text, "after it"])
    got, now = [], []
    for h in flat[at == 1]:
        now, got = ([], [*got, now]) if h == 0 else ([*now, int(h)], got)
    got = [x for x in [*got, now] if x]
    assert got == [[abuse._hash(w) for w in abuse._words(abuse.plain(s))] for s in abuse.sentences(text)]


def test_length_adds_nothing():
    held = corpus(7, 300)
    w = abuse.fit([t for t, _ in held], np.array([float(b) for _, b in held]), np.ones(len(held)))
    texts = [" ".join(g.format("it") for g in GOOD) * n for n in (1, 10, 400)]
    p, text = abuse.score_texts(texts, w, abuse.Vectors())
    scores = abuse.noisy_or(p, text, 3)
    assert scores.max() < 0.1


def test_documents(spark):
    train = corpus(3, 300)
    docs = [(k, t, "s", "x") for k, (t, _) in enumerate(train)] + [(900, None, None, "x"), (901, "", "s", "x"), (902, GOOD[0] * 3000, "s", "x"), (903, BAD[0], "s", "x")]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string, score string")
    r = spark.createDataFrame([(k, f"r{j}", int(b)) for k, (_, b) in enumerate(train) for j in (0, 1)] + [(0, "r0", None), (5000, "r0", 1)], "doc_id long, reviewer string, flagged int")
    got = {x["doc_id"]: x for x in abuse.scored_documents(d, r).collect()}
    assert len(got) == len(docs) and got[900]["score"] == got[901]["score"] == 0 and got[900]["worst_sentence"] is None
    assert got[903]["score"] > 0.5 and sum((got[k]["score"] >= 0.5) == b for k, (_, b) in enumerate(train)) >= 0.95 * len(train)
    assert max(x["score"] for x in abuse.scored_documents(d, r.limit(0)).collect()) < 1.0
    assert abuse.scored_documents(d.limit(0), r).count() == 0
