"""Operator 10 against brute force."""

import hashlib
import random

from lodestone.llm import _util, repeats


def brute(rows):
    seen, out = set(), []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1] is not None, r[1])):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - 99):
            s = data[p : p + 100]
            if s in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(s)
        runs = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(gone)))
        out.append((doc, len(data), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(data, gone) if not g)).hexdigest()))
    return out


def check(spark, rows):
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, sub int").repartition(5)
    got = repeats.remove_repeats(df).collect()
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in got]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)


def test_documents(spark, sf):
    check(spark, [(r.doc_id, r.text) for r in _util.table(spark, sf, "documents").collect()])


def test_odd_texts(spark):
    r = random.Random(2)
    line = "".join(r.choice("abcdefé ") for _ in range(130))
    rows = [(0, None), (1, ""), (2, "x" * 99), (3, "x" * 100), (4, "x" * 101), (5, "x" * 500), (6, "ab" * 300), (7, "abc" * 200), (8, line), (9, line + "tail"), (10, "head" + line), (11, "q" + line[:99]), (12, "q" + line[:100]), (13, "q" + line[1:101] + "z"), (14, line * 3), (None, line[:120]), (8, line), (8, "more" + line)]
    for k in range(40):
        a, b = sorted(r.sample(range(130), 2))
        rows.append((100 + k, "".join(r.choice("ab") for _ in range(r.randint(0, 60))) + (line * 2)[a : b + 100] + "".join(r.choice("ab") for _ in range(r.randint(0, 200)))))
    check(spark, rows)
    check(spark, rows[:1])
    assert repeats.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
