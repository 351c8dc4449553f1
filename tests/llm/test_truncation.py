from __future__ import annotations

import html
import json
import random

from pyspark.sql import functions as F

from rungmill.llm import truncation


def test_lengths(spark):
    texts = ["plain", "é漢😀", 'a "q" & <b> \'c\'', "two\nlines\r\nmore\ttab", "\x01\\"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for t, r in zip(texts, df.select(*[c.alias(k) for k, c in truncation.lengths(F.col("t")).items()]).collect(), strict=True):
        crlf = t.replace("\r\n", "\n").replace("\n", "\r\n")
        assert r.asDict() == {
            "characters": len(t), "utf8": len(t.encode()), "utf16": len(t.encode("utf-16-le")) // 2,
            "entities": len(html.escape(t).replace("&#x27;", "&#39;")), "entities_utf8": len(html.escape(t).replace("&#x27;", "&#39;").encode()),
            "json": len(json.dumps(t)) - 2, "json_utf8": len(json.dumps(t, ensure_ascii=False).encode()) - 2,
            "crlf": len(crlf), "crlf_utf8": len(crlf.encode()),
        }


def corpus(n=3000):
    rnd = random.Random(2)
    names = [a + b + c for a in ("Tol", "Vel", "Mar", "Rin") for b in ("pe", "du", "ma", "li") for c in ("dale", "wick", "ford", "ana")]
    rows, cut = [], set()
    for k in range(n):
        parts = [rnd.choice(["in the manner of {} {}", "as told in {} and {}", "after {} of {}", "a wooden kite in the background", "by the old harbour"]).format(rnd.choice(names), rnd.choice(names)) for _ in range(rnd.randrange(1, 9))]
        text = f"A {rnd.choice(['grüne', 'red', 'tiny'])} boat near {rnd.choice(names)}, " + ", ".join(parts) + rnd.choice([".", ""])
        source = rnd.choice(["chars", "bytes", "free"])
        if source == "chars" and len(text) > 120:
            text = text[:120]
            cut.add(k)
        elif source == "bytes" and len(text.encode()) > 150:
            text = text.encode()[:150].decode(errors="ignore")
            cut.add(k)
        elif source == "free" and rnd.random() < 0.03:
            text = text[: rnd.randrange(30, len(text))]
            cut.add(k)
        rows.append((0, k, source, text, "x", 1))
    return rows, cut


def test_limits_and_endings(spark):
    rows, cut = corpus()
    df = spark.createDataFrame(rows, "tbl int, id long, source string, text string, encoding string, limit int")
    limits = {r["source"]: (r["encoding"], r["limit"]) for r in truncation.limits(df).collect()}
    assert limits == {"chars": ("characters", 120), "bytes": ("utf8", 150)}
    found = {r["id"] for r in truncation.truncated(df).collect()}
    assert len(found & cut) >= 0.9 * len(cut) and len(found - cut) <= 0.03 * len(rows)


def test_two_limits_of_a_source(spark):
    """A field of 120 characters that was widened to 200; the texts at both are cut, and a text that is delivered often is no limit."""
    rnd = random.Random(5)
    rows, cut = [], set()
    for k in range(3000):
        text = " ".join(rnd.choice(["a wooden kite", "the old harbour", "two red boats", "near the mill,", "in fog"]) + f" {rnd.randrange(10**4)}" for _ in range(rnd.randrange(2, 16))) + "."
        most = 120 if k % 3 == 0 else 200
        if len(text) > most:
            text = text[:most]
            cut.add(k)
        rows.append((0, k, "wide", text))
    rows += [(0, 10_000 + k, "wide", "A whole text that comes again and again without a stop") for k in range(500)]
    df = spark.createDataFrame(rows, "tbl int, id long, source string, text string")
    assert {(r["encoding"], r["limit"]) for r in truncation.limits(df).collect()} == {("characters", 120), ("characters", 200)}
    found = [r["id"] for r in truncation.truncated(df).where("cause = 'limit'").collect()]
    assert len(found) == len(set(found)) and set(found) == {k for k, t in ((r[1], r[3]) for r in rows) if k in cut and not t.rstrip().endswith(".")}


def test_edges(spark):
    schema = "tbl int, id long, source string, text string"
    assert truncation.truncated(spark.createDataFrame([], schema)).count() == 0
    rows = [(0, 1, None, None), (0, 2, None, ""), (0, 3, "s", " "), (0, 4, "s", "word " * 50_000 + "end.")]
    assert {r["id"] for r in truncation.truncated(spark.createDataFrame(rows, schema)).collect()} <= {4}


def test_own_end_and_rare_contexts(spark):
    """A context of three words that other texts hold 100 times can't show a rate of 0.004; its last word can."""
    rows = [f"The three musicians from the town play number {k} here." for k in range(100)] + [f"The {'red blue tiny old'.split()[k % 4]} boat from the town lies at place {k} here." for k in range(500)]
    rows += ["The red boat lies here, and the three musicians from"]
    df = spark.createDataFrame([(0, k, "s", t) for k, t in enumerate(rows)], "tbl int, id long, source string, text string")
    assert [(r["id"], r["cause"]) for r in truncation.truncated(df).collect()] == [(600, "ending")]


def test_copies_do_not_vouch_for_their_ending(spark):
    rows = [f"The {'red blue tiny old'.split()[k % 4]} boat from the town lies at place {k} here." for k in range(600)] + ["The red boat lies here, and the three musicians from"] * 301
    df = spark.createDataFrame([(0, k, "s", t) for k, t in enumerate(rows)], "tbl int, id long, source string, text string")
    assert {r["id"] for r in truncation.truncated(df).collect()} == set(range(600, 901))
