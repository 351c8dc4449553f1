from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rungmill.functions.levels import LEVELS
from rungmill.operators import components, dedup, export, judge, ladders, quota, similarity, verify


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_dedup(spark):
    r = spark.createDataFrame([(1, "a", "x", 1.0, 9), (2, "a", "x", 3.0, 9), (3, "a", "x", 3.0, 9), (4, "b", "x", 0.0, 9), (5, None, "x", 1.0, 9), (6, None, "x", 1.0, 9), (7, "c", "y", float("nan"), 9), (8, "c", "y", None, 9)], "id int, k string, t string, s double, place int")
    kept = dedup.exact_dedup(r, ["k", "t"], F.col("s"), "id")
    assert sorted(x["id"] for x in kept.collect()) == [2, 4, 5, 6, 7] and kept.columns == r.columns
    text = lambda df: sorted(repr(tuple(x)) for x in df.collect())  # NaN is not equal to itself
    assert text(dedup.exact_dedup(kept, ["k", "t"], F.col("s"), "id")) == text(kept)
    assert text(dedup.exact_dedup(r.repartition(7), ["k", "t"], F.col("s"), "id")) == text(kept)
    assert rows(dedup.removed(r, kept)) == [(8, 5, 3)]
    assert dedup.exact_dedup(r.limit(0), ["k", "t"], F.col("s"), "id").count() == 0


def union_find(pairs):
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
    return sorted((x, find(x)) for x in up)


@pytest.mark.parametrize("kind", ["path", "star", "random", "empty"])
def test_components(spark, kind):
    rnd = random.Random(1)
    pairs = {"path": [(k, k + 1) for k in range(60)], "star": [(0, k) for k in range(1, 60)] + [(99, 5)], "random": [(rnd.randrange(80), rnd.randrange(80)) for _ in range(60)] + [(None, 3), (4, 4), (7, 7)], "empty": []}[kind]
    df = spark.createDataFrame(pairs, "a long, b long")
    assert rows(components.components(df)) == sorted(union_find(pairs), key=repr)


def test_cosine_edges(spark):
    rnd = np.random.default_rng(0)
    v = [(k, k % 2, [float(x) for x in rnd.normal(size=4)]) for k in range(40)]
    v += [(100, 0, v[0][2]), (101, 0, [2 * x for x in v[0][2]]), (102, None, v[0][2]), (103, 0, None), (104, 0, []), (105, 0, [0.0] * 4)]
    df = spark.createDataFrame(v, "vec_id long, label int, embedding array<double>")
    got = {(r["a"], r["b"]) for r in similarity.cosine_edges(df, 0.6, tile_rows=7).collect()}
    def cos(x, y):
        return float(np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y))
    reps = [x for x in v if x[0] < 100]
    want = {(a[0], b[0]) for a in reps for b in reps if a[0] < b[0] and a[1] == b[1] and cos(a[2], b[2]) >= 0.6} | {(0, 100)}
    assert got - {(0, 101)} == want and similarity.cosine_edges(df.limit(0), 0.6).count() == 0
    pair = df.where("vec_id = 0").select(F.col("embedding").alias("x")).crossJoin(df.where("vec_id = 2").select(F.col("embedding").alias("y")))
    assert pair.select(similarity.cosine("x", "y")).first()[0] == pytest.approx(cos(v[0][2], v[2][2]))


def test_assign_ladders(spark):
    r = spark.createDataFrame([(1, "X", 1.0), (2, "X", 5.0), (3, "X", 5.0), (9, "X", 0.0), (4, "Y", None), (5, None, 1.0)], "id long, c string, s double")
    e = spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")
    got = {x["ordinal"]: tuple(x)[1:] for x in ladders.assign_ladders(r, e, "id", "c", "s").collect()}
    assert got == {1: ("X", 1, "X_0000", 2), 2: ("X", 1, "X_0000", 2), 3: ("X", 1, "X_0000", 2), 9: ("X", 9, "X_0001", 9), 4: ("Y", 4, "Y_0000", 4), 5: (None, 5, None, 5)}


def test_gaps_and_pivot(spark):
    r = spark.createDataFrame([(1, "L", "Safe", "a"), (2, "L", "low risk", "b"), (3, "L", "LOW_RISK", "c"), (4, "M", "nothing", "d"), (5, None, "safe", "e"), (6, "N", "high_risk", None), (7, "N", "high_risk", "z")], "o int, ladder_id string, target_severity string, p string")
    assert rows(ladders.gaps(r)) == sorted([("L", "mid_risk", 2), ("L", "high_risk", 3), ("M", "safe", 0), ("M", "low_risk", 1), ("M", "mid_risk", 2), ("M", "high_risk", 3), ("N", "safe", 0), ("N", "low_risk", 1), ("N", "mid_risk", 2)], key=repr)
    assert rows(ladders.pivot(r, "p", "o")) == sorted([("L", "a", "b", None, None), ("M", None, None, None, None), ("N", None, None, None, None)], key=repr)
    assert ladders.gaps(r.limit(0)).count() == 0 and ladders.pivot(r.limit(0), "p", "o").count() == 0


@pytest.mark.parametrize(("scores", "valid", "partial", "broken"), [
    ((0.0, 1.0, 1.4, 3.0), True, False, []), ((0.0, 0.3, 1.0, 2.0), False, False, [("safe", "low_risk")]),
    ((1.0, 1.0, 1.0, 1.0), False, False, list(zip(LEVELS, LEVELS[1:], strict=False))), ((0.0, None, 1.0, 1.1), False, True, [("mid_risk", "high_risk")]),
    ((0.0, float("nan"), 1.0, 2.0), False, True, []),
])
def test_monotonic(spark, scores, valid, partial, broken):
    df = spark.createDataFrame([scores], ", ".join(f"mllm_score_{x} double" for x in LEVELS))
    r = verify.monotonic(df).first()
    assert (r["valid"], r["partial"], [tuple(x) for x in r["broken"]]) == (valid, partial, broken)


def test_quota(spark):
    seen = spark.createDataFrame([("Violence",)] * 3 + [("Minors",)] * 5 + [("Other",), (None,)], "category string")
    plan = quota.needed(seen, 5, ["Violence", "Minors", "Self_Harm"])
    assert rows(plan) == [("Self_Harm", 0, 5), ("Violence", 3, 2)]
    with pytest.raises(ValueError, match="A, Z"):
        quota.needed(seen, 5, ["Z", "Violence", "A"])
    c = spark.createDataFrame([(k, "Violence", 1) for k in range(9)] + [(20, "Minors", 1), (21, "Self_Harm", 1), (22, None, 1)], "o int, category string, needed int")
    assert rows(quota.take(c, plan, 5, "o")) == [(0, "Violence", 1), (1, "Violence", 1), (21, "Self_Harm", 1)]
    assert rows(quota.unknown_categories(seen)) == [("Other",)] and quota.dry_run(spark, 5).count() == 11


def test_rules_and_verdicts(spark):
    rules = spark.createDataFrame([("Violence", "safe", "r1"), ("Violence", "safe", "r0"), ("Minors", "low_risk", "r2"), (None, "safe", "r3")], "category string, level string, rule string")
    r = spark.createDataFrame([(1, "VIOLENCE ", "safe", "old"), (2, "Minors", "Low-Risk", None), (3, None, "safe", None), (4, "Minors", None, None)], "c int, category string, target_severity string, rule string")
    assert [(x["c"], x["rule"]) for x in judge.with_rules(r, rules).orderBy("c").collect()] == [(1, "r0"), (2, "r2"), (3, None), (4, None)]
    lad = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "ladder_id string")
    assert rows(judge.drop_poisoned(lad, spark.createDataFrame([("b",), (None,)], "ladder_id string"))) == sorted([("a",), ("a",), (None,)], key=repr)
    done = spark.createDataFrame([("a", None), (None, "x")], "k string, m string")
    todo = spark.createDataFrame([("a", None), ("a", "x"), (None, "x"), (None, None)], "k string, m string")
    assert rows(judge.remaining(todo, done, ["k", "m"])) == sorted([("a", "x"), (None, None)], key=repr)
    score = judge.scorer(judge.length_stub)
    assert [x[0] for x in spark.createDataFrame([("x" * 50,), (None,)], "t string").select(score("t")).collect()] == [0.5, 0.0]


def test_export(spark):
    import json

    lines = [
        {"ladder_id": "L", "category": "C", "seed": None, "secret": 1, "rung_safe": {"prompt": None, "verdict": "x", "image_path": "p"}, "rung_low_risk": "text", "rung_mid_risk": None, "rung_high_risk": {"explanation": "e", "source_id": 4}},
        {"ladder_id": "M"},
    ]
    df = spark.createDataFrame([(json.dumps(x),) for x in lines], "t string").select(F.parse_json("t").alias("record"))
    out = export.public_open(df)
    got = {(x := json.loads(r[0]))["ladder_id"]: x for r in out.select(F.to_json("record", {"ignoreNullFields": "false"})).collect()}
    none = {"explanation": None}
    assert got["L"] == {"ladder_id": "L", "category": "C", "seed": None, "rung_safe": {"prompt": None, "image_path": "p", "explanation": None}, "rung_low_risk": none, "rung_mid_risk": none, "rung_high_risk": {"explanation": "e"}}
    assert got["M"] == {"ladder_id": "M"} | {f"rung_{x}": none for x in LEVELS}
    again = export.public_open(out.select(F.parse_json(F.to_json("record", {"ignoreNullFields": "false"})).alias("record")))
    assert sorted(r[0] for r in again.select(F.to_json("record")).collect()) == sorted(r[0] for r in out.select(F.to_json("record")).collect())


def test_export_declared(spark):
    rung = "struct<prompt string, image_path string, explanation string, verdict string>"
    df = spark.createDataFrame([("L", "C", "g", "r", 1, ("p", "i", "e", "v"), None, None, None, "x")], "ladder_id string, category string, generator_model string, red_team_model string, seed long, " + ", ".join(f"rung_{x} {rung}" for x in LEVELS) + ", secret string")
    r = export.public(df).first()
    assert r["rung_safe"].asDict() == {"prompt": "p", "image_path": "i", "explanation": "e"} and r["rung_low_risk"].asDict() == dict.fromkeys(export.KEPT_RUNG)
    assert export.removed_columns(df) == ["secret"] and export.removed_rung_fields(df) == ["verdict"]


def test_keep_valid_and_mismatched(spark):
    nan = float("nan")
    rows = [(1, 0.0, 1.0, 2.0, 3.0), (2, 0.0, 0.4, 0.8, 1.2), (3, 0.0, 0.3, 2.0, 3.0), (4, None, 1.0, 2.0, 3.0), (5, nan, 1.0, 2.0, 3.0), (6, 0.5, 1.5, 2.0, 3.4)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "id int, mllm_score_safe double, mllm_score_low_risk double, mllm_score_mid_risk double, mllm_score_high_risk double, ok string")
    kept = verify.keep_valid(df)
    assert kept.columns == df.columns and sorted(r["id"] for r in kept.collect()) == [1, 2, 6]
    got = {r["id"]: r["mismatched"] for r in verify.mismatched_levels(df).collect()}
    assert got == {1: [], 2: ["low_risk", "mid_risk", "high_risk"], 3: ["low_risk"], 4: [], 5: [], 6: ["safe", "low_risk"]}
    assert verify.keep_valid(df.limit(0)).count() == 0


def test_judge_tries_again(spark, tmp_path):
    flag = str(tmp_path / "failed")

    def once(texts, rules):
        import os

        if not os.path.exists(flag):
            open(flag, "w").close()
            raise ValueError("not now")
        return judge.word_stub(texts, rules)

    df = spark.createDataFrame([("a" * 150, "r"), (None, None), ("", "r")], "t string, r string").coalesce(1)
    got = [tuple(r["v"]) for r in df.select(judge.severity_judge(once)("t", "r").alias("v")).collect()]
    assert got == [("low_risk", "ok"), ("safe", "ambiguous"), ("safe", "ok")]

    def never(texts, rules):
        raise ValueError("never")

    with pytest.raises(Exception, match="never"):
        df.select(judge.severity_judge(never, tries=2)("t", "r").alias("v")).collect()


def test_lookup(spark):
    df = spark.createDataFrame([(1, "a", "k0"), (2, "b", "k0"), (3, None, "k0")], "id int, c string, v string")
    t = spark.createDataFrame([("a", "y"), ("a", "x"), (None, "z")], "c string, text string")
    got = judge.lookup(df, "c", t, "c", "text", "none for %s", "said")
    assert got.columns == ["id", "c", "v", "said"] and {r["id"]: r["said"] for r in got.collect()} == {1: "x", 2: "none for b", 3: "none for "}
    assert {r["said"] for r in judge.lookup(df, "c", t.limit(0), "c", "text", "-%s", "said").collect()} == {"-a", "-b", "-"}


def test_components_of_a_long_chain(spark):
    """Rounds go on until nothing changes."""
    n = 600
    order = list(range(n))
    random.Random(3).shuffle(order)
    df = spark.createDataFrame(list(zip(order, order[1:], strict=False)) + [(5, 5), (None, 1)], "a long, b long")
    got = {r["node"]: r["component"] for r in components.components(df).collect()}
    assert got == dict.fromkeys(range(n), 0)
