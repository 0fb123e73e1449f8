"""Scalar functions and scores against plain Python."""

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import fingerprint, scores, similarity, text


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column.alias("x")).first()["x"]


def test_words(spark):
    assert one(spark, text.words_of(F.col("n")), n="parseHTTPServer_file-name2Go_a") == ["parse", "httpserver", "file", "name2", "go"]
    assert one(spark, text.label_words(F.col("n")), n="m::handle_io_new_error") == ["handle", "error"]
    assert one(spark, text.normalize_doc(F.col("n")), n=" The, (old)\nÉtat! ") == "the old état"
    assert one(spark, text.sanitize(F.col("n")), n="a b(c)") == "a_b_c_"


def test_paths(spark):
    assert one(spark, text.module_of(F.col("n")), n="a::b::c") == "a::b" and one(spark, text.module_of(F.col("n")), n="c") == ""
    assert one(spark, text.top_module(F.col("n")), n="a::b::c") == "a" and one(spark, text.last_segment(F.col("n")), n="a::b::c") == "c"
    assert one(spark, text.dir_of(F.col("n")), n="x/y/z.rs") == "x/y"
    assert one(spark, text.move_key(F.lit("k"), F.col("n")), n="a::b | c::d") == "k\x01b | d"


@pytest.mark.parametrize(("name", "pattern", "hit"), [("a::b::parse_it", "parse*", True), ("a::b::parse_it", "b::parse*", True), ("a::xb::parse_it", "b::parse*", False), ("a::Parse", "parse", True), ("a::parse", "Parse", False), ("a::b", "*", True)])
def test_glob(spark, name, pattern, hit):
    assert one(spark, text.glob_like(F.col("n"), pattern), n=name) is hit


@pytest.mark.parametrize(("waiver", "key", "hit"), [(None, None, True), (None, "a", True), ("a", None, False), ("a", "a", True), ("b", "a::b", True), ("a", "a::b", True), ("a", "ab", False)])
def test_key_matches(spark, waiver, key, hit):
    df = spark.createDataFrame([(waiver, key)], "w string, k string")
    assert df.select(text.key_matches(F.col("w"), F.col("k"))).first()[0] is hit


def test_kleene(spark):
    rows = spark.createDataFrame([(True, None), (False, None), (None, None)], "a boolean, b boolean")
    assert [r[0] for r in rows.select(text.not_stripped(text.kleene_all([F.col("a"), F.col("b")]))).collect()] == [True, False, True]
    assert [r[0] for r in rows.select(text.kleene_any([F.col("a"), F.col("b")])).collect()] == [True, None, None]


def fnv(s):
    h = 0xCBF29CE484222325
    for b in s.encode():
        h = (h ^ b) * 0x100000001B3 % (1 << 64)
    return f"{h:016x}"


def test_fnv(spark):
    some = ["", "a", "hello world", "é😀", "x" * 500]
    df = spark.createDataFrame([(s,) for s in some], "s string")
    assert [r[0] for r in df.select(fingerprint.fnv1a(F.col("s"))).collect()] == [fnv(s) for s in some]


def test_fingerprint_ignores_place(spark):
    df = spark.createDataFrame([("f  g@1-9:12",), ("f g",), ("f g:7",), ("f h",)], "s string")
    got = [r[0] for r in df.select(fingerprint.fingerprint(F.lit("c"), [F.lit("x")], F.col("s"))).collect()]
    assert got[0] == got[1] == got[2] != got[3] and len(got[0]) == 12


@given(st.text("abc", max_size=6), st.text("abc", max_size=6))
def test_osa_is_symmetric_and_bounded(a, b):
    d = similarity.osa(a, b)
    assert d == similarity.osa(b, a) <= max(len(a), len(b)) and (d == 0) == (a == b)


def test_osa_is_restricted(spark):
    assert similarity.osa("ab", "ba") == 1 and similarity.osa("ca", "abc") == 3
    df = spark.createDataFrame([("ab", "ba"), (None, "x")], "a string, b string")
    assert [r[0] for r in df.select(similarity.osa_distance("a", "b")).collect()] == [1, None]


def test_scores(spark):
    def num(c):
        return round(one(spark, c), 6)

    assert num(scores.clones(F.lit(40), F.lit(2), F.lit(True), F.lit(True))) == 0.7
    assert num(scores.ratio_drift(F.lit(3), F.lit(1))) == 0.75
    assert num(scores.error_swallows(F.lit("let-_"), F.lit("mutation"), F.lit(False), F.lit(True))) == 1.0
    assert num(scores.error_swallows(F.lit(".ok"), F.lit("io"), F.lit(True), F.lit(True))) == 0.2
    assert num(scores.panics(F.lit("unwrap"), F.lit("decode"), F.lit(False), F.lit(True))) == 0.45
    assert num(scores.validation_drift(F.lit(3), F.lit(3))) == round(0.25 + 0.225 + 0.2 - 0.25, 6)
    assert num(scores.divergence(F.lit(2), F.lit(4), F.lit(2), F.lit(1.0), F.lit(True))) == 0.375
