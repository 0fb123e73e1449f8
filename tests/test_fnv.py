"""Fingerprints of many rows, nulls and slices."""

from pyspark.sql import functions as F

from lodestone.functions import fingerprint

from .test_functions import fnv


def test_nulls_and_texts_of_all_lengths(spark):
    some = [None, "", "é" * 9, None, "a"] + ["x y" * k for k in range(40)]
    df = spark.createDataFrame([(k, s) for k, s in enumerate(some)], "k int, s string").coalesce(1)
    assert [r[1] for r in sorted(df.select("k", fingerprint.fnv1a(F.col("s"))).collect())] == [s if s is None else fnv(s) for s in some]
    assert df.where("k < 0").select(fingerprint.fnv1a(F.col("s"))).collect() == []
    assert df.where("s IS NULL").select(fingerprint.fnv1a(F.col("s"))).distinct().collect() == [(None,)]


def test_no_bytes_of_a_text_are_passed_as_rows_of_hex(spark):
    plan = spark.range(1).select(fingerprint.fnv1a(F.col("id").cast("string")))._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in plan and "Arrow" in plan
