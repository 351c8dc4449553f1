from __future__ import annotations

import hashlib
from fractions import Fraction

from hypothesis import given, settings
from hypothesis import strategies as st

from rungmill.llm import quota_sampling as qs

cells = st.lists(st.tuples(st.floats(0, 1), st.integers(0, 20), st.integers(0, 60)), min_size=1, max_size=12)


def test_largest_remainder():
    assert qs.largest_remainder([Fraction(1), Fraction(1), Fraction(1)], 10) == [4, 3, 3]
    assert qs.largest_remainder([Fraction(0)], 5) == [0] and qs.largest_remainder([Fraction(1)], 0) == [0]


@settings(max_examples=200, deadline=None)
@given(cells, st.integers(0, 300))
def test_quotas_keep_their_bounds(rows, total):
    shares, floors, caps = (list(x) for x in zip(*rows, strict=True))
    got = qs.allocate(shares, floors, caps, total)
    low = [min(f, c) for f, c in zip(floors, caps, strict=True)]
    assert all(0 <= q <= c for q, c in zip(got, caps, strict=True))
    if sum(low) >= total:
        assert sum(got) == total
        return
    assert all(q >= x for q, x in zip(got, low, strict=True))
    most = sum(c if s > 0 else x for s, c, x in zip(shares, caps, low, strict=True))
    assert sum(got) == min(total, most)
    # Between two cells off their bounds the shares decide, up to rounding.
    free = [i for i, q in enumerate(got) if low[i] < q < caps[i]]
    for i in free:
        for j in free:
            assert Fraction(got[i]) * Fraction(shares[j]) - Fraction(got[j]) * Fraction(shares[i]) <= Fraction(shares[i]) + Fraction(shares[j])


def tables(spark, n=400):
    rows = [(k, ["Violence", "violence ", "Self_Harm", None][k % 4], ["sdxl", "SDXL", "flux1"][k % 3], "x") for k in range(n)]
    t = [("p", "Violence", "sdxl", 0.5, 0, 100), ("p", "Self_Harm", "sdxl", 0.3, 0, 100), ("p", "Self_Harm", "flux1", 0.15, 5, 100), ("p", "Minors", "sdxl", 0.05, 3, 100), ("q", "Violence", "flux1", 1.0, 0, 900)]
    return spark.createDataFrame(rows, "record_ordinal long, category string, generator_model string, key string"), spark.createDataFrame(t, "plan_id string, category string, generator_model string, target_share double, min_rows long, sample_rows_per_mille long"), rows, t


def test_sample(spark):
    records, targets, rows, t = tables(spark)
    quota = {(r["plan_id"], r["category"], r["generator_model"]): r for r in qs.quotas(records, targets).collect()}
    got = {}
    for r in qs.sample(records, targets).collect():
        got.setdefault((r["plan_id"], r["category"], r["generator_model"]), set()).add(r["record_ordinal"])
    norm = lambda s: "".join(c for c in (s or "\0").lower() if c.isalnum())
    for key, q in quota.items():
        plan, c, g = key
        have = [k for k, x, y, _ in rows if norm(x) == norm(c) and norm(y) == norm(g)]
        assert q["available"] == len(have)
        first = sorted(have, key=lambda k: (hashlib.md5(f"{plan}|42|{k}".encode()).hexdigest(), k))[: q["drawn"]]
        assert got.get(key, set()) == set(first)
    assert sum(q["drawn"] for k, q in quota.items() if k[0] == "p") == 40
    short = {tuple(r)[:3]: (r["missing"], r["reason"]) for r in qs.shortfalls(records, targets).collect()}
    assert short[("p", "Minors", "sdxl")] == (3, "unavailable") and short[("q", "Violence", "flux1")][1] == "unavailable"
    again = qs.sample(records.repartition(5), targets)
    assert sorted(map(repr, again.collect())) == sorted(map(repr, qs.sample(records, targets).collect()))


def test_empty(spark):
    records, targets, *_ = tables(spark)
    assert qs.sample(records.limit(0), targets).count() == 0 and qs.sample(records, targets.limit(0)).count() == 0
