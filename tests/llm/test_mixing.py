"""Operators 7 and 9: hand-made cases."""

from lodestone.llm import licenses, mixing


def docs(spark, rows):
    return spark.createDataFrame([(k, t, la, s, 0, "x") for k, t, la, s in rows], "doc_id long, text string, lang string, source string, n_chars long, domain string")


def test_budgets_go_to_siblings_first(spark):
    # src0 web, src1 books; English of web has two leaves, one of them short
    leaves = spark.createDataFrame([("web", "en", "src0", 10), ("web", "en", "src4", 1000), ("web", "de", "src0", 1000), ("books", "en", "src1", 1000)], "domain string, lang string, source string, tokens long")
    leaves.createOrReplaceTempView("leaves_for_test")
    got = {(r.domain, r.lang, r.source): r for r in spark.sql(mixing.plan_sql("leaves_for_test", 0.5, 2)).collect()}
    total = 0.5 * 3010
    web = total * 0.4 / 0.7
    en = web * 0.5 / 0.7
    assert got["web", "en", "src0"].budget == 20 and got["web", "en", "src0"].whole == 2
    assert abs(got["web", "en", "src4"].budget - (en - 20)) <= 1
    assert abs(got["web", "de", "src0"].budget - (web - en)) <= 1
    assert abs(got["books", "en", "src1"].budget - (total - web)) <= 1


def test_prefixes_and_odd_rows(spark):
    rows = [(k, "w " * (k % 9), "en", "src0") for k in range(200)] + [(500, None, None, None), (501, "", "xx", "src1"), (None, "a b c", "en", "src1"), (502, "a b", "en", "src1"), (502, "a b", "en", "src1")]
    got = mixing.mix(docs(spark, rows), share=0.7).collect()
    chosen = sum(r.n_tokens for r in got)
    total = sum(len((t or "").split()) for _, t, _, _ in rows)
    assert 0.5 * total < chosen <= 0.7 * total + 1
    by_leaf = {}
    for r in got:
        by_leaf.setdefault((r.domain, r.lang, r.source), []).append(r)
    assert all(sum(r.n_tokens for r in v) <= v[0].budget for v in by_leaf.values())
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(docs(spark, rows).repartition(7), share=0.7).collect()), key=str)
    assert mixing.mix(docs(spark, rows).limit(0)).count() == 0


def test_licences(spark):
    rows = [
        (1, "a/LICENSE", "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software"),
        (2, "a/x.py", "code here"),
        (3, "a/b/x.py", "# Licensed under the Apache License, Version 2.0."),
        (4, "a/c/LICENSE.txt", "This work is licensed under the GNU General Public License, version 3."),
        (5, "a/c/d/y.py", "code"),
        (6, "z/y.py", None),
        (7, None, "Released under the MIT License."),
        (8, "a/c/LICENSE", ""),
        (9, "a/q.py", "we met with the work of that program and use it in the version of the law " * 500),
        (2, "a/x.py", "code here"),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], "id long, path string, text string, word int")
    got = {r.id: (r.licence, r.origin, r.from_path) for r in licenses.scan(df).collect()}
    assert got[1] == ("MIT", "file", "a/LICENSE")
    assert got[2] == ("MIT", "inherited", "a/LICENSE") == got[9]
    assert got[3] == ("Apache-2.0", "header", "a/b/x.py")
    assert got[4][:2] == ("GPL-3.0", "file")
    assert got[5] == ("GPL-3.0", "inherited", "a/c/LICENSE.txt") == got[8]
    assert got[6] == (None, "none", None)
    assert got[7] == ("MIT", "header", None)
    assert licenses.scan(df).count() == len(rows) and licenses.scan(df.limit(0)).count() == 0
