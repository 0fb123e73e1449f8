"""Waivers and findings in order of their lines."""

import random

from pyspark.sql import functions as F

from lodestone.operators import battery


def covers(w, f):
    file, lo, hi, check, key = w
    if None in (file, lo, hi, f[0], f[1]) or file != f[0] or not lo <= f[1] <= hi or check not in (None, f[2]):
        return False
    return key is None or f[3] is not None and (f[3] == key or f[3].rsplit("::", 1)[-1] == key or f[3].startswith(key + "::"))


def some(r):
    keys = [None, "a", "b", "a::b", "a::b::c", "c", "a:::b", "::a", ""]
    waivers = [(r.choice(["x", "y", None]), r.choice([None, *range(9)]), r.choice([None, *range(12)]), r.choice([None, "p", "q"]), r.choice(keys)) for _ in range(60)]
    found = [(r.choice(["x", "y", None]), r.choice([None, *range(12)]), r.choice([None, "p", "q", "z"]), r.choice(keys)) for _ in range(80)]
    return waivers + waivers[:5], found + found[:30]


def test_as_pair_by_pair(spark):
    waivers, found = some(random.Random(2))
    w = spark.createDataFrame([(k, *x) for k, x in enumerate(waivers)], "w long, file string, lo long, hi long, check string, key string").withColumn("date", F.lit(None).cast("date"))
    f = spark.createDataFrame([(k, *x) for k, x in enumerate(found)], "f long, file string, line long, check string, key string")
    got = {r.w: r.suppresses for r in battery.ledger(w, f, F.current_date()).collect()}
    assert got == {k: sum(covers(x, y) for y in found) for k, x in enumerate(waivers)} and len(set(got.values())) > 4
    left = sorted(r.f for r in battery.waive(f, w.limit(12)).collect())
    first = {r.w for r in w.limit(12).collect()}
    assert left == [k for k, y in enumerate(found) if not any(covers(waivers[x], y) for x in first)]


def test_rows_that_are_there_again_each_count(spark):
    w = spark.createDataFrame([("x", 1, 3, None, None)] * 2, "file string, lo int, hi int, check string, key string").withColumn("date", F.lit(None).cast("date"))
    f = spark.createDataFrame([("x", 2, "p", None)] * 3, "file string, line int, check string, key string")
    assert [r.suppresses for r in battery.ledger(w, f, F.current_date()).collect()] == [3, 3]


def test_waivers_do_not_meet_findings_pair_by_pair(spark):
    w = spark.range(10).select(F.lit("x").alias("file"), F.lit(1).alias("lo"), F.lit(2).alias("hi"), F.lit("p").alias("check"), F.lit("k").alias("key"), F.current_date().alias("date"))
    f = w.select("file", F.col("lo").alias("line"), "check", "key")
    for df in (battery.ledger(w, f, F.current_date()), battery.waive(f, w)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        joins = [x for x in plan.splitlines() if "Join" in x]
        assert joins and not any(">=" in x or "<=" in x or "OR" in x for x in joins)
