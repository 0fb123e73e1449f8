"""Streaming queries and sinks."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lodestone.sources import sinks
from lodestone.sources.code import parse
from lodestone.streaming import runs


def test_acknowledged_once(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    for k, rows in enumerate([[("a", t), ("a", t + dt.timedelta(minutes=5)), ("b", t)], [("a", t + dt.timedelta(minutes=30)), ("c", t + dt.timedelta(minutes=31))]]):
        spark.createDataFrame(rows, "key string, at timestamp").coalesce(1).write.parquet(str(tmp_path / "in" / f"p={k}"))
    stream = spark.readStream.schema("key string, at timestamp, p int").parquet(str(tmp_path / "in"))
    got = runs.run_once(runs.acknowledged_once(stream.drop("p"), "key", "at"), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted(r.key for r in got.collect()) == ["a", "b", "c"]


def test_windowed_counts(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").select("ts", "event_type")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    if dict(stream.dtypes)["ts"] != "timestamp":
        stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    got = runs.run_once(runs.windowed_counts(stream, "ts", "event_type"), str(tmp_path / "out"), str(tmp_path / "cp"))
    day = events.groupBy(F.to_date("ts").alias("d"), "event_type").count()
    want = {(str(r.d), r.event_type): r["count"] for r in day.collect()}
    assert got.count() and all(want[str(r.start.date()), r.event_type] == r.n for r in got.collect())


def test_incremental_facts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.rs").write_text("fn a() {}\n")
    one = runs.incremental(spark, str(tmp_path / "in"), parse, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert one.where("table = 'defns'").count() == 1
    (tmp_path / "in" / "b.rs").write_text("fn b() {}\n")
    two = runs.incremental(spark, str(tmp_path / "in"), parse, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert two.where("table = 'defns'").count() == 2


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 0.748, ["x", "y"], None)], "n string, s double, l array<string>, z string")
    assert sinks.rendered(df).first()[0] == "a\t0.75\tx,y\t"
    assert sinks.json_rows(df, "c").first()["json"] == '{"n":"a","s":0.748,"l":["x","y"],"z":null}'
    lines = spark.createDataFrame([("f", k, str(k)) for k in range(1, 9)], "file string, line int, text string")
    hit = spark.createDataFrame([("f", 1), ("f", 5)], "file string, line int")
    assert sinks.snippets(hit, lines, 1).count() == 5
    f = spark.createDataFrame([("c", "fp", "l", "s", 0.5)], "check string, fp string, label string, site string, score double")
    sinks.write_baseline(f, str(tmp_path / "b"))
    assert sinks.read_baseline(spark, str(tmp_path / "b")).count() == 1
    f.withColumn("version", F.lit(99)).write.parquet(str(tmp_path / "c"))
    with pytest.raises(ValueError, match="version 99"):
        sinks.read_baseline(spark, str(tmp_path / "c"))
