"""The closure over customers against brute force."""

from lodestone.operators import graph
from lodestone.plans import bindings


def test_dead_customers(spark, sf):
    names = {r[0] for r in spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey").collect()}
    keys = [r[0] for r in spark.read.parquet(f"{sf}/orders.parquet").select("o_custkey").distinct().collect()]
    calls = {(None if c % 3 == 0 else c, (c**3 + 7 * c + 1) % len(names)) for c in keys}
    want = {}
    for k in range(len(names)):
        used = {t for c, t in calls if c not in want}
        want |= {n: k for n in names - used - set(want)}
    assert max(want.values()) >= 2
    assert {r["name"]: r["round"] for r in bindings.dead_customers(spark, sf).collect()} == want


def test_closure_runs_to_its_fixpoint(spark):
    d = spark.createDataFrame([(k,) for k in range(19)], "name long")
    c = spark.createDataFrame([(k, k + 1) for k in range(18)], "caller long, target long")
    assert {r["name"]: r["round"] for r in graph.transitively_unused(d, c, None).collect()} == {k: k for k in range(19)}
