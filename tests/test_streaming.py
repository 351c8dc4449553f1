from __future__ import annotations

import json

from pyspark.sql import functions as F

from rungmill.streaming import resume


def test_runs_go_on_where_the_last_stopped(spark, tmp_path):
    (tmp_path / "in").mkdir()
    args = (spark, str(tmp_path / "in"), "id long", str(tmp_path / "out"), str(tmp_path / "check"), lambda x: x.where("id > 0"))
    for k, ids in enumerate(([0, 1], [2], [])):
        if ids:
            (tmp_path / f"in/{k}.json").write_text("\n".join(json.dumps({"id": i}) for i in ids))
        resume.run_available(*args)
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2]


def test_windowed_counts_of_a_stream_and_a_table(spark, tmp_path):
    rows = [(1, "2024-01-01 00:10:00", "a", 1.0), (1, "2024-01-01 00:10:00", "a", 1.0), (2, "2024-01-01 00:50:00", "a", 2.0), (3, "2024-01-01 01:00:00", "b", 4.0)]
    df = spark.createDataFrame(rows, "event_id long, ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    want = [(0, "a", 2, 3.0), (1, "b", 1, 4.0)]
    got = resume.windowed_counts(df)
    assert sorted((r[0].hour, *tuple(r)[1:]) for r in got.collect()) == want
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = resume.windowed_counts(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("windows").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r[0].hour, *tuple(r)[1:]) for r in spark.table("windows").collect()) == want
