from __future__ import annotations

import random

import pytest

from rungmill.llm import containers


def run(spark, sizes, capacity):
    df = spark.createDataFrame([(k, s, "x") for k, s in sizes.items()], "doc_id long, n_tokens long, uid string")
    return containers.fill_containers(df, capacity).collect()


def check(rows, sizes, capacity):
    """Everything is placed once, nothing overflows or is split without need; returns the number of containers."""
    whole, room, places = {}, {}, {}
    for r in rows:
        whole[r["doc_id"]] = whole.get(r["doc_id"], 0) + r["n_tokens"]
        if r["container"] is not None:
            room[r["container"]] = room.get(r["container"], 0) + r["n_tokens"]
            places.setdefault(r["container"], []).append(r["place"])
    assert whole == {k: s or 0 for k, s in sizes.items()}
    assert all(n <= capacity for n in room.values()) and all(sorted(p) == list(range(len(p))) for p in places.values())
    pieces = [(r["doc_id"], r["piece"]) for r in rows]
    assert len(pieces) == len(set(pieces))
    assert all(n == max(1, -(-(sizes[k] or 0) // capacity)) for k in sizes for n in [sum(1 for d, _ in pieces if d == k)])
    return len(room)


def best_fit_decreasing(sizes, capacity):
    gaps = []
    for s in sorted((x for n in sizes.values() if n for x in [capacity] * (n // capacity) + [n % capacity] if x), reverse=True):
        fit = [g for g in gaps if g >= s]
        if fit:
            gaps.remove(min(fit))
            gaps.append(min(fit) - s)
        else:
            gaps.append(capacity - s)
    return len(gaps)


@pytest.mark.parametrize("seed", [1, 2])
def test_about_as_tight_as_best_fit_decreasing(spark, seed):
    rnd = random.Random(seed)
    sizes = {k: rnd.choice([rnd.randrange(1, 30), rnd.randrange(1, 90), rnd.randrange(1, 250)]) for k in range(150)}
    n = check(run(spark, sizes, 100), sizes, 100)
    assert n <= best_fit_decreasing(sizes, 100) * 1.04 + 1


def test_one_size_of_most_items(spark):
    sizes = dict.fromkeys(range(120), 33) | {200: 67, 201: 1}
    assert check(run(spark, sizes, 100), sizes, 100) == 41


def test_edges(spark):
    sizes = {1: None, 2: 0, 3: 100, 4: 201, 5: 100_000, 6: 1}
    rows = run(spark, sizes, 100)
    check(rows, sizes, 100)
    assert all(r["container"] is None and r["place"] is None for r in rows if r["doc_id"] in (1, 2))
    assert run(spark, {}, 100) == []


def test_ids_at_both_ends(spark):
    """Ids need no room for a piece number."""
    sizes = {5: 60, 5 + 2**44: 70, 2**63 - 1: 10, -(2**63): 20, -1: 240, 5 + 2**45: -3}
    rows = run(spark, sizes, 100)
    check(rows, sizes | {5 + 2**45: 0}, 100)


def test_a_hot_size_is_spread(spark, monkeypatch):
    """Tasks that rank a size grow with its number of pieces; results stay whole."""
    monkeypatch.setattr(containers, "PER_TASK", 10)
    sizes = dict.fromkeys(range(300), 40) | {300 + k: 1 + k % 90 for k in range(600)}
    rows = run(spark, sizes, 100)
    n = check(rows, sizes, 100)
    monkeypatch.setattr(containers, "PER_TASK", 10**6)
    assert n == check(run(spark, sizes, 100), sizes, 100) <= best_fit_decreasing(sizes, 100) * 1.04 + 1


def test_few_jobs(spark):
    sizes = {k: 1 + k * 7 % 90 for k in range(400)}
    df = spark.createDataFrame(list(sizes.items()), "doc_id long, n_tokens long")
    spark.sparkContext.setJobGroup("few", "few")
    containers.fill_containers(df, 100).collect()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("few"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs < 20


@pytest.mark.parametrize("capacity", [0, -1, 1 << 30])
def test_capacity_bounds(spark, capacity):
    with pytest.raises(ValueError, match="capacity"):
        run(spark, {1: 1}, capacity)


def test_token_counts(spark):
    tiktoken = pytest.importorskip("tiktoken")
    import base64

    with open(containers.TOKENIZER, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    code = tiktoken.Encoding("x", pat_str=containers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["It's <|endoftext|> a täst  \n", "", None, "汉字" * 50]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["n_tokens"] for r in containers.token_counts(df).collect()} == {k: len(code.encode_ordinary(t or "")) for k, t in enumerate(texts)}
