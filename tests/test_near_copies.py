"""Near copies of many rows with the same leaves."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import pairs


def forest(data, most=2):
    """Kruskal's over all pairs: (skeleton, a, b, diffs, family). data: key, skeleton, leaves."""
    edges = sorted({(sum(p != q for p, q in zip(x[2:], y[2:], strict=True)), x[0], y[0], x[1]) for x in data for y in data if x[0] is not None and y[0] is not None and x[0] < y[0] and x[1] == y[1]})
    root, kept = {(x[1], x[0]): (x[1], x[0]) for x in data}, []
    for diffs, a, b, sk in edges:
        p, q = root[sk, a], root[sk, b]
        if 1 <= diffs <= most and p != q:
            kept.append((sk, a, b, diffs))
            root = {k: p if v == q else v for k, v in root.items()}
    every = list(root.values())
    return sorted((*e, every.count(root[e[0], e[1]])) for e in kept)


@pytest.mark.parametrize("sets", [64, 0])
def test_classes_and_keys_that_are_there_again(spark, monkeypatch, sets):
    monkeypatch.setattr(pairs, "SETS", sets)
    r = random.Random(5)
    data = [(r.choice([k, k, k, k % 7, None]), r.choice(["s", "s", "t"]), r.choice(["x", "y", None]), r.choice(["x", ""]), r.choice("uvwxy")) for k in range(70)] + [(900 + k, "far", str(k), str(k), str(k % 2)) for k in range(12)]
    got = pairs.near_copies_all(spark.createDataFrame(data, "k long, sk string, a string, b string, c string"), ["sk"], ["a", "b", "c"], "k").collect()
    assert sorted(map(tuple, got)) == forest(data)


def test_links_grow_with_the_rows(spark, monkeypatch):
    """2000 rows of one skeleton with eight different leaves: some two million pairs."""
    written, old = [], pairs.materialize

    def counted(df):
        out = old(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(pairs, "materialize", counted)
    df = spark.range(2000).select("id", F.lit("s").alias("sk"), *[F.expr(f"shiftright(id, {k}) & 1").alias(f"l{k}") for k in range(3)])
    got = pairs.near_copies_all(df, ["sk"], ["l0", "l1", "l2"], "id")
    assert got.count() == 1999 and max(written) <= 2000 and got.where("family <> 2000").isEmpty()
