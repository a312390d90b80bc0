"""Readers, writers, contracts and streams."""

import json

from pyspark.sql import functions as F

from courtflow.operators import segments
from courtflow.sources import tables
from courtflow.streaming import sessions


def test_csv(spark, tmp_path):
    assert tables.read_csv(spark, str(tmp_path / "none.csv"), ["a", "b"]).count() == 0
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    tables.write_csv(df, str(tmp_path / "t"), ["b", "a", "c"])
    back = tables.read_csv(spark, str(tmp_path / "t"), ["b", "a", "c"])
    assert back.columns == ["b", "a", "c"] and sorted(map(tuple, back.collect()), key=str) == [("x", "2", None), (None, "1", None)]
    try:
        tables.write_csv(df, str(tmp_path / "u"), ["a"])
        raise AssertionError("an undeclared column passed")
    except ValueError:
        pass


def test_documents(spark, tmp_path):
    doc = {"segments": [{"segment_id": None, "label": "main_view", "start": 0.0, "end": 4.0}, {"segment_id": "x", "label": "MAIN_VIEW", "start": 5.0, "end": 5.0}, {"segment_id": "y", "label": "other", "start": 1.0, "end": 2.0}]}
    (tmp_path / "t.json").write_text(json.dumps(doc, indent=2))
    d = tables.read_json(spark, str(tmp_path / "t.json"), "segments array<struct<segment_id:string,label:string,start:double,end:double>>")
    assert [tuple(r) for r in tables.main_view_intervals(d).collect()] == [("001", 0.0, 4.0)]
    (tmp_path / "p.jsonl").write_text('{"frame": 1, "players": {"upper": {"court": [1.0, 2.0]}, "lower": null}}\n{"frame": 2, "players": {"upper": {"court": null}, "lower": {"court": [3, 4]}}}\n')
    assert sorted(map(tuple, tables.read_positions(spark, str(tmp_path / "p.jsonl")).collect())) == [(1, 1.0, 2.0, None, None), (2, None, None, 3.0, 4.0)]


def test_calibrations_and_contracts(spark, tmp_path):
    square = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]]
    c = spark.createDataFrame([("a", "metre", [[0.0, 0.0]] * 4, square), ("b", "metre", [[0.0, 0.0]] * 4, square[:2]), ("c", "foot", [[0.0, 0.0]] * 4, square)], tables.CALIBRATION)
    assert [r["video_stem"] for r in tables.valid_calibrations(c).collect()] == ["a"]
    rows = spark.createDataFrame([("a", 1), ("z", 2)], "video_stem string, n int")
    assert {r["video_stem"]: r["homography"] is None for r in tables.with_calibration(rows, c).collect()} == {"a": False, "z": True}
    p = str(tmp_path / "c.csv")
    assert tables.inspect_table(spark, "t", p, ["a"]).status == "MISSING"
    (tmp_path / "c.csv").write_text("a,b\n")
    assert tables.inspect_table(spark, "t", p, ["a"]).status == "EMPTY" and tables.inspect_table(spark, "t", p, ["q"]).status == "INVALID"
    (tmp_path / "d.csv").write_text("a,b\n1,2\n")
    assert tables.inspect_table(spark, "t", str(tmp_path / "d.csv"), ["a"]).status == "VALID" and tables.inspect_table(spark, "t", str(tmp_path / "d.csv"), ["a"], 2).status == "INVALID"


def test_hysteresis_stream_equals_the_batch(spark, tmp_path):
    rows = [(k, f, (f * 7 + k) % 5 < 3 or 10 < f < 20) for k in range(3) for f in range(40)]
    schema = "k bigint, frame_id bigint, flag boolean"
    df = spark.createDataFrame(rows, schema)
    for part in range(4):  # frames of a key come in order from file to file
        df.where((F.col("frame_id") >= part * 10) & (F.col("frame_id") < part * 10 + 10)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = sessions.drain(sessions.hysteresis_stream(stream, hold=4), "hysteresis", str(tmp_path / "cp"))
    want = segments.hysteresis(df, ["k"], F.col("flag"), 4).select("k", "frame_id", "is_open", "session")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.where("is_open").count()


def test_windows_of_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([("a", "2024-01-01 00:00:00", 1.0), ("a", "2024-01-01 00:10:00", 3.0), ("a", "2024-01-01 05:00:00", 5.0), ("b", "2024-01-02 00:00:00", 0.0)], "k string, ts string, v double")
    rows.select("k", F.to_timestamp("ts").alias("ts"), "v").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, ts timestamp, v double").parquet(str(tmp_path / "in"))
    s = sessions.drain(sessions.session_counts(stream, "k"), "sessions", str(tmp_path / "c1"))
    assert sorted(r["events"] for r in s.where("k = 'a'").collect()) == [1, 2]  # the last one stays open until the watermark passes it
    t = sessions.drain(sessions.tumbling_stats(stream, "k", "v"), "stats", str(tmp_path / "c2"))
    assert {(r["k"], r["rows"], r["mean"]) for r in t.collect()} == {("a", 2, 2.0), ("a", 1, 5.0)}
