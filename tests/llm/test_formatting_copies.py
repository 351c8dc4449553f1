from __future__ import annotations

import random
import re

from rungmill.llm import formatting_copies as fc

bare = lambda s: "".join(re.findall(r"[^\W_]", s.lower()))


def contents(rows):
    """Brute force: closure over equal letters and digits, and over equal parts in any order."""
    keys = []
    for _, c, p in rows:
        if c is None or p is None:
            keys.append(None)
            continue
        parts = [x for x in re.split(r"[;|\r\n]+", p) if x.strip(" ")]
        listed = bool(parts) and all(re.match(r"[^:=]*[:=]", x) for x in parts)
        keys.append({("whole", bare(c), bare(p))} | ({("parts", bare(c), tuple(sorted(bare(x) for x in parts)))} if listed else set()))
    groups = []
    for (o, *_), k in zip(rows, keys, strict=True):
        if k is not None:
            same = [g for g in groups if g[1] & k]
            groups = [g for g in groups if not g[1] & k] + [({o}.union(*(g[0] for g in same)), k.union(*(g[1] for g in same)))]
    return {(min(g), o) for g, _ in groups for o in g if o != min(g)}


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "record_ordinal long, category string, prompt_unsafe string, text string, ordinal int")
    got = fc.formatting_copies(df, "record_ordinal", "category", "prompt_unsafe").collect()
    out = {(r["kept_ordinal"], r["copy_ordinal"]) for r in got}
    assert len(out) == len(got)
    return out


def test_cases(spark):
    rows = [
        (5, "Self_Harm", "A red-hot Day."), (3, "self harm", "a RED hot day"), (9, "SelfHarm", "a red hot night"),
        (11, "V", "a: one; b: two"), (12, "v", "B=TWO | A=one"), (13, "v", "a: two; b: one"), (14, "v", "a: one; a: one; b: two"), (15, "v", "b: two\na: one\r\n a: one"),
        (20, "v", "a one b two"), (21, "w", "x: yz; u: v"), (22, "w", "u: v; xy: z"), (23, "w", "u: v; x: yz"),
        (30, None, "same"), (31, None, "same"), (32, "v", None), (33, "v", None), (40, "v", ""), (41, "v", " ...!"), (42, "v", ";;"),
        (50, "v", "é" * 5000 + "x"), (51, "v", "É" * 5000 + " X"),
    ]
    assert run(spark, rows) == contents(rows)


def test_random_lists(spark):
    rnd = random.Random(5)
    rows = []
    for k in range(150):
        parts = [f"{rnd.choice('ab')}{rnd.choice([': ', '=', ' : '])}{rnd.choice(['x', 'Y', 'x y'])}" for _ in range(rnd.randrange(1, 4))]
        rows.append((k, rnd.choice(["C", "c ", "D"]), rnd.choice(["; ", "|", "\n"]).join(parts)))
    assert run(spark, rows) == contents(rows)


def test_collisions_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(fc, "_PRIME", 1)  # every record has the same fingerprint
    calls = []
    real = fc._round
    def later(stage, left, seed):
        calls.append(seed)
        return real(stage, left, seed)
    monkeypatch.setattr(fc, "_round", later)
    rows = [(1, "a", "x"), (2, "a", "y"), (3, "a", "X"), (4, "a", "Y!")]
    assert run(spark, rows) == {(1, 3), (2, 4)} and calls == [0, 1]


def test_empty(spark):
    assert run(spark, []) == set()
