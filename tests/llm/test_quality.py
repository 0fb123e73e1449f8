"""Operator 3 against brute force."""

import re
from collections import Counter

import pytest

from lodestone.llm import _util, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    w = WORD.findall(text or "")
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(tri)
    covered = {i + k for i, t in enumerate(tri) if n[t] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def texts(spark, sf):
    odd = [None, "", " ", "a", "a b", "a b c a b c", "x " * 60, "a\x0bb\x0cc\rd\te", "\n\na\n\na\n b\n", "\x1ca\x1c b\xa0c", "é#*$ $%&|<>", "a b c d a b c x b c d", "w " * 40_000, "\n".join(["same line here"] * 9)]
    return odd + [r.text for r in _util.table(spark, sf, "documents").collect()]


def test_statistics(spark, sf):
    t = texts(spark, sf)
    df = spark.createDataFrame(list(enumerate(t)), "doc_id long, text string").withColumn("n_words", _util.F.lit("clash"))
    got = {r.doc_id: tuple(r)[1:] for r in quality.statistics(df).collect()}
    for k, x in enumerate(t):
        assert got[k] == brute(x), (k, x and x[:50])


def test_learned_list():
    rows = [(k, {f: 0.0 for f in quality.FEATURES} | {"symbols_a_word": k % 7 * 0.1, "repeated_share": k % 5 * 0.1}, k % 7 > 4 or k % 5 == 4) for k in range(900)]
    rules = quality.learn(rows)
    assert len(rules) == 2
    assert all(any(all(c.holds(x) for c in r) for r in rules) == bad for _, x, bad in rows)
    assert quality.learn([]) == [] and quality.learn([(1, rows[0][1], True)]) == []


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = _util.table(spark, d, "documents"), _util.table(spark, d, "labels")
    rules = quality.fit(docs, labels.where("doc_id % 2 = 0"))
    seen = quality.judge(docs, rules).join(labels.where("doc_id % 2 = 1"), "doc_id").where("not base_failed").selectExpr("count(*) n", "count_if(kept = (quality = 1)) good").collect()[0]
    assert rules and seen.n > 100 and seen.good / seen.n > 0.95


@pytest.mark.parametrize("empty", ["documents", "labels", "both"])
def test_empty(spark, sf, empty):
    docs, labels = _util.table(spark, sf, "documents"), _util.table(spark, sf, "labels")
    docs, labels = (docs.limit(0) if empty != "labels" else docs), (labels.limit(0) if empty != "documents" else labels)
    out = quality.judge(docs, quality.fit(docs, labels))
    assert out.count() == docs.count()
    assert out.where("kept = base_failed").count() == 0 or labels.count()


def test_repeated_doc_ids_make_one_row_each(spark, sf, monkeypatch):
    """The rules are the same in whatever order rows come, and labels of repeated rows count once."""
    docs, labels = (_util.table(spark, sf, t) for t in ("documents", "labels"))
    seen = []
    monkeypatch.setattr(quality, "learn", lambda rows: seen.append(rows) or [])
    quality.fit(docs, labels)
    quality.fit(docs.unionByName(docs).unionByName(docs).repartition(7), labels)
    assert seen[0] == seen[1] and len(seen[0]) == len({r[0] for r in seen[0]}) > 50
