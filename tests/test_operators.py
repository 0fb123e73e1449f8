"""Operators on small hand-made tables: the cases that are easy to get wrong."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import battery, drift, graph, groups, pairs, sets


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_reach_takes_first_depth_and_survives_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("c", "d")], "src string, dst string")
    s = spark.createDataFrame([("a",)], "node string")
    assert rows(graph.reach(e, s), "node", "depth") == [("a", 0), ("b", 1), ("c", 1), ("d", 2)]
    assert rows(graph.reach(e, s, 1), "node") == [("a",), ("b",), ("c",)]


def test_dead_code_fixpoint(spark):
    d = spark.createDataFrame([(x,) for x in "abcd"], "name string")
    c = spark.createDataFrame([("a", "b"), ("b", "c"), (None, "d")], "caller string, target string")
    assert rows(graph.transitively_unused(d, c), "name", "round") == [("a", 0), ("b", 1), ("c", 2)]


def test_synonyms(spark):
    a = spark.createDataFrame([("A", "B"), ("B", "C"), ("X", "C"), ("C", "A"), ("Q", "R")], "alias string, target string")
    assert rows(graph.synonyms(a, "B"), "node") == [("A",), ("B",), ("C",), ("X",)]


def test_test_support_needs_roots(spark):
    p = spark.createDataFrame([("app",), ("lib",), ("helpers",)], "name string")
    e = spark.createDataFrame([("app", "lib", "normal"), ("app", "helpers", "dev")], "src string, dst string, kind string")
    assert rows(graph.test_support(p, e), "name") == [("helpers",)]
    ring = spark.createDataFrame([("app", "lib", "normal"), ("lib", "app", "normal"), ("lib", "helpers", "dev")], "src string, dst string, kind string")
    assert graph.test_support(p.where("name <> 'helpers'"), ring).count() == 0


def test_near_copies_compare_nulls_and_skip_large_buckets(spark):
    df = spark.createDataFrame([(1, "s", "x", None), (2, "s", "x", "y"), (3, "s", "x", None), (4, "s", "q", "r")] + [(k, "big", "x", str(k)) for k in range(10, 30)], "k long, sk string, a string, b string")
    got = pairs.near_copies(df, ["sk"], ["a", "b"], "k")
    assert rows(got, "a", "b", "diffs", "family") == [(1, 2, 1, 4), (1, 4, 2, 4), (2, 3, 1, 4)]
    assert rows(pairs.oversized(df, ["sk"]), "sk", "size") == [("big", 20)]


def test_near_copies_of_large_buckets_are_those_of_all_pairs(spark):
    r = random.Random(3)
    data = [(k, r.choice(["big", "big", "s", "t"]), *(r.choice([None, *"uvwxyz"]) for _ in range(4))) for k in range(90)]
    df = spark.createDataFrame(data, "k long, sk string, a string, b string, c string, d string")
    edges = sorted((sum(p != q for p, q in zip(x[2:], y[2:], strict=True)), x[0], y[0], x[1]) for x in data for y in data if x[0] < y[0] and x[1] == y[1])
    root, kept = {x[0]: x[0] for x in data}, []
    for diffs, a, b, sk in edges:
        if 1 <= diffs <= 2 and root[a] != root[b]:
            kept.append((sk, a, b, diffs))
            root = {k: root[a] if v == root[b] else v for k, v in root.items()}
    want = sorted((*e, list(root.values()).count(root[e[1]])) for e in kept)
    assert rows(pairs.near_copies_all(df, ["sk"], ["a", "b", "c", "d"], "k"), "sk", "a", "b", "diffs", "family") == want
    assert sum(e[0] == "big" for e in want) > 12


def test_config_drift_abstentions(spark):
    df = spark.createDataFrame([("t", "a", "x", 1), ("t", "a", "y", 1), ("t", None, "y", 2), ("u", "a", None, 1), ("u", "b", None, 1)], "o string, f string, g string, m int")
    got = {r.owner: r for r in drift.config_drift(df, "o", ["f", "g"], F.col("m"), least=0.0).collect()}
    assert (got["t"].configs, got["t"].agreed, got["t"].differs) == (3, 1, "g")
    assert (got["u"].agreed, got["u"].differs) == (0, "f")
    assert drift.config_drift(df, "o", ["f", "g"], F.col("m"), frozenset(["f", "g"]), 0.0).count() == 0


def test_ratio_needs_two_checked(spark):
    df = spark.createDataFrame([("a", True)] * 3 + [("a", False)] + [("b", True), ("b", False)], "s string, c boolean")
    assert rows(drift.ratio_groups(df, ["s"], F.col("c")), "s", "score") == [("a", 0.75)]


def test_equal_word_groups_keep_the_first(spark):
    df = spark.createDataFrame([(1, "t", "red_big"), (2, "t", "red_big"), (3, "t", "red")], "k long, i string, n string")
    assert rows(groups.word_concepts(df, ["i"], F.col("n"), "k", F.lit(True), F.lit(1), 0.0), "word") == [("red",)]
    same = spark.createDataFrame([(1, "t", "red_big"), (2, "t", "red_big")], "k long, i string, n string")
    assert rows(groups.word_concepts(same, ["i"], F.col("n"), "k", F.lit(True), F.lit(1), 0.0), "word") == [("big",)]


def test_coverage_uses_the_own_definition(spark):
    s = spark.createDataFrame([("E", 1, ["A", "B"]), ("E", 2, ["X"]), ("E", 3, ["A", "X"])], "enum string, site int, variants array<string>")
    d = spark.createDataFrame([("E", "one", ["A", "B"]), ("E", "two", ["X", "Y", "Z"])], "enum string, def_id string, variants array<string>")
    assert rows(sets.coverage(s, d), "site", "missing") == [(2, "Y,Z"), (3, "B,Y,Z")]


def test_multiset_diff(spark):
    a, b = (spark.createDataFrame([(x,) for x in s], "k string") for s in ("aab", "abbc"))
    assert rows(sets.multiset_diff(a, b, ["k"]), "k", "unchanged", "new", "gone") == [("a", 1, 1, 0), ("b", 1, 0, 1), ("c", 0, 0, 1)]


def test_nearest_prefers_the_earlier(spark):
    left = spark.createDataFrame([("g", 10, 1), ("g", 1, 2), ("h", 1, 3)], "g string, at long, id long")
    right = spark.createDataFrame([("g", 8, 5), ("g", 12, 6), ("g", 8, 4)], "g string, at long, id long")
    assert rows(pairs.nearest(left, right, ["g"], "at", "id"), "id", "near_at", "near_id") == [(1, 8, 4), (2, 8, 4)]


def test_caps_spare_what_gates_as_printed(spark):
    part = spark.createDataFrame([(str(k), str(k), s) for k, s in enumerate([0.9, 0.76, 0.748, 0.7])], "label string, site string, score double")
    f = battery.findings({"clones": part})
    assert rows(battery.rank_cap(f, 1), "score") == [(0.748,), (0.76,), (0.9,)]
    assert rows(battery.totals(f), "gating", "advisory") == [(2, 2)]
    assert battery.rank_cap(f, 0).count() == 4
    with pytest.raises(ValueError, match="no such check"):
        battery.findings({"clones": part}, only=["nope"])
    with pytest.raises(ValueError, match="leaves no check"):
        battery.findings({"clones": part}, skip=["clones"])


def test_waivers_cover_lines_checks_and_keys(spark):
    f = spark.createDataFrame([("f", 5, "panics", None), ("f", 5, "panics", "a::b"), ("f", 9, "panics", None)], "file string, line int, check string, key string")
    w = spark.createDataFrame([("f", 1, 6, "panics", "b")], "file string, lo int, hi int, check string, key string")
    assert rows(battery.waive(f, w).fillna("-"), "line", "key") == [(5, "-"), (9, "-")]
    assert battery.waive(f, w.withColumn("key", F.lit(None).cast("string")).withColumn("check", F.lit(None).cast("string"))).count() == 1


def test_spans_in_bins(spark):
    p = spark.createDataFrame([("u", 5.0), ("u", 130.0), ("u", 131.0), ("v", 5.0)], "u string, t double")
    s = spark.createDataFrame([("u", 100.0, 130.0)], "u string, a double, b double")
    assert rows(pairs.range_hits(p, s, "u", F.col("t"), F.col("a"), F.col("b"), 10.0), "t") == [(130.0,)]
