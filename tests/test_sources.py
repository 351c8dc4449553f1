from __future__ import annotations

import json

import pytest

from rungmill.sources import images, jsonl

LINES = ['{"a": 1, "t": "día"}', "", "   ", '{"a": null}']


def test_strict(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text("\n".join(LINES))
    rows = jsonl.read_strict(spark, str(tmp_path / "x.jsonl")).selectExpr("to_json(record) r").collect()
    assert sorted(r["r"] for r in rows) == sorted(['{"a":1,"t":"día"}', '{"a":null}'])


@pytest.mark.parametrize("bad", ['{"a": ', "[1, 2]", "7"])
def test_bad_lines(spark, tmp_path, bad):
    (tmp_path / "x.jsonl").write_text("\n".join([*LINES, bad]))
    with pytest.raises(Exception):  # noqa: B017
        jsonl.read_strict(spark, str(tmp_path / "x.jsonl")).collect()
    assert jsonl.read_tolerant(spark, str(tmp_path / "x.jsonl")).count() == 2


def test_missing_file(spark, tmp_path):
    assert jsonl.read_tolerant(spark, str(tmp_path / "none.jsonl")).count() == 0


def test_write_keeps_nulls_and_appends(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "ñ")], "a int, b string")
    for append in (False, True):
        jsonl.write(df, str(tmp_path / "deep/out"), append)
    lines = [json.loads(x) for p in (tmp_path / "deep/out").glob("*.json") for x in p.read_text().splitlines()]
    assert len(lines) == 4 and {"a": 1, "b": None} in lines
    assert jsonl.read_typed(spark, str(tmp_path / "deep/out"), "a int, b string").count() == 4


def test_images(spark, tmp_path):
    for root, names in (("r1", ["c/a.png"]), ("r2", ["c/a.png", "c/b.png"])):
        for n in names:
            (tmp_path / root / n).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / root / n).write_bytes(root.encode())
    lists = [images.listing(spark, str(tmp_path / r)) for r in ("r1", "r2")]
    refs = spark.createDataFrame([("c/a.png", 1), ("c/b.png", 2), ("c/b.png", 3), ("no.png", 4), ("", 5), (None, 6), ("/c/a.png", 7), ("../r1/c/a.png", 8)], "image_path string, clean int")
    assert images.found_and_missing(refs, lists).first().asDict() == {"found": 3, "missing": 3}
    resolved = images.resolve(refs, lists)
    assert {(r["image_path"], r["root"]) for r in resolved.where("root is not null").collect()} == {("c/a.png", 0), ("c/b.png", 1)}
    done = images.copy_missing(resolved, [str(tmp_path / r) for r in ("r1", "r2")], str(tmp_path / "out")).collect()
    assert sorted((r["image_path"], r["copied"]) for r in done) == [("c/a.png", True), ("c/b.png", True)]
    assert (tmp_path / "out/c/a.png").read_bytes() == b"r1"
    assert not any(r["copied"] for r in images.copy_missing(resolved, [str(tmp_path / r) for r in ("r1", "r2")], str(tmp_path / "out")).collect())


def test_copy_counts(spark, tmp_path):
    """Counted for each reference; what is already there counts as copied. Signs in a folder's name are no pattern."""
    roots = [tmp_path / "r+1 (a)", tmp_path / "r2"]
    for root, names in zip(roots, (["c/a.png"], ["c/a.png", "c/b.png"]), strict=True):
        for n in names:
            (root / n).parent.mkdir(parents=True, exist_ok=True)
            (root / n).write_bytes(root.name.encode())
    refs = spark.createDataFrame([("c/a.png", 1), ("c/a.png", 1), ("c/b.png", 2), ("no.png", 4), ("", 5), (None, 6), ("../r2/c/a.png", 8)], "image_path string, n int")
    for _ in range(2):
        assert images.copy_counts(refs, [str(r) for r in roots], str(tmp_path / "out")).first().asDict() == {"copied": 3, "missing": 2}
    assert (tmp_path / "out/c/b.png").read_bytes() == b"r2" and not list((tmp_path / "out").rglob("*.part"))
    assert images.copy_counts(refs.limit(0), [str(r) for r in roots], str(tmp_path / "out")).first().asDict() == {"copied": 0, "missing": 0}
