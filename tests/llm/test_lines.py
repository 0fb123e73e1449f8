"""Operator 8 against all pairs of lines."""

import random
from collections import Counter

import numpy as np

from lodestone.llm import _edits, _lines, _util, lines


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(rows):
    """Of each normalised line the first place of its group: all pairs of edit similarity 0.9 are linked."""
    first = {}
    for doc, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        for no, line in enumerate((text or "").split("\n")):
            if n := lines.normal_line(line):
                first[n] = min(first.get(n, (doc, no)), (doc, no))
    names = sorted(first, key=lambda n: (len(n), n))
    letters = {n: Counter(n) for n in names}
    root = {n: n for n in names}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for k, a in enumerate(names):
        for b in names[k + 1 :]:
            most = int(len(b) * 0.1 + 1e-9)
            if len(b) - len(a) > most:
                break
            if top(a) != top(b) and max((letters[a] - letters[b]).total(), (letters[b] - letters[a]).total()) <= most and distance(a, b) <= most:
                root[top(a)] = top(b)
    least = {}
    for n in names:
        least[top(n)] = min(least.get(top(n), first[n]), first[n])
    return {n: least[top(n)] for n in names}


def data(spark, sf):
    rows = [(r.doc_id, r.text) for r in _util.table(spark, sf, "documents").limit(40).collect()]
    base = "the quick brown fox jumps over the lazy dog and runs far away from here today while nobody is looking at it"
    words = base.split()
    rows += [(1000 + k, "\n".join([base.upper() + "!", " ".join(words[:k] + ["zz"] + words[k + 1 :]), "short line"])) for k in range(20)]
    rows += [(2000, None), (2001, ""), (2002, base), (2002, base), (2002, "other " + base), (None, base), (2003, "a b c d e\n\n , . ; : !\n" + "w " * 9000), (2004, "W " * 9000)]
    return rows


def test_against_brute_force(spark, sf):
    rows = data(spark, sf)
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, sim int")
    want = brute(rows)
    by_place = {(d, no): {lines.normal_line((x[1] or "").split("\n")[no]) for x in rows if x[0] == d and no < len((x[1] or "").split("\n"))} for d, t in rows for no in range(len((t or "").split("\n")))}
    got = lines.fuzzy_lines(df).collect()
    assert len(got) == sum(lines.normal_line(x) != "" for _, t in rows for x in (t or "").split("\n"))
    for r in got:
        if r.doc_id is None:
            assert r.kept
        else:
            assert (r.first_doc_id, r.first_line_no) in {want[n] for n in by_place[r.doc_id, r.line_no]}, r
            assert not r.kept or (r.doc_id, r.line_no) == (r.first_doc_id, r.first_line_no)
    # of each group one line is kept, also where rows repeat
    assert len([r for r in got if r.kept and r.doc_id is not None]) == len({want[n] for n in want})
    assert len({want[n] for n in want}) < len(want) - 5
    out = {}
    for r in lines.dedup_lines(df).collect():
        out.setdefault(r.doc_id, []).append(r.text)
    assert 1001 not in out and 2002 not in out
    assert out[2000] == [None] and out[2001] == [""] and 2004 not in out
    assert lines.fuzzy_lines(df.limit(0)).count() == 0 and lines.dedup_lines(df.limit(0)).count() == 0


def test_window_keys_are_the_least_of_all():
    r = np.random.default_rng(3)
    many = np.array([1, 2, 3, 5, 6, 7, 8, 13, 14, 15, 40, 33, 900, 3000])
    words = r.integers(1, 2**63, many.sum()).astype(np.uint64)
    starts = np.concatenate([[0], np.cumsum(many)])
    key, of = lines.window_keys(words, starts)
    for k, n in enumerate(many):
        w, found = words[starts[k] : starts[k + 1]], []
        for size in lines.window_sizes(int(n)):
            h = [sum(int(x) * int(m) for x, m in zip(w[i : i + size], lines._MUL, strict=False)) % 2**64 ^ size for i in range(n - size + 1)]
            found += lines.mix(np.array(h, np.uint64)).tolist()
        assert key[of == k].tolist() == sorted(set(found))[: lines.KEYS], n


def test_rows_of_one_doc_id(spark):
    """A row loses its own lines only; rows that repeat are one; a private-use letter is a letter like others."""
    line = "a line of some words that is found in several of these rows"
    private = "words with \ue0ff a letter of private use among several others of them here"
    rows = [(1, line), (5, line), (5, "another text with words of its own"), (7, line + " once"), (7, line + " once"), (8, "kept words\n" + private), (9, private.replace("several", "severel")), (10, private.replace("\ue0ff", "\ufffd"))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in lines.dedup_lines(df).collect()) == [(1, line), (5, rows[2][1]), (8, rows[5][1])]
    got = lines.fuzzy_lines(df).collect()
    assert len(got) == 9 and sum(r.kept for r in got) == 4
    seven = lines.dedup_lines(spark.createDataFrame([(7, "some words"), (7, "some words"), (7, "some other words")], "doc_id long, text string"))
    assert sorted(r.text for r in seven.collect()) == ["some other words", "some words"]


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "some words here", 1, 2, "x"), (2, "some words here\nmore words", 3, 4, "y")], "doc_id long, text string, gone int, h int, row string")
    assert [tuple(r) for r in lines.dedup_lines(df).orderBy("doc_id").collect()] == [(1, "some words here", 1, 2, "x"), (2, "more words", 3, 4, "y")]


def test_edits_against_the_whole_matrix(monkeypatch):
    r = random.Random(2)
    s, t = [], []
    for _ in range(200):
        a = "".join(r.choices("abcdé ", k=r.randint(0, 200)))
        b = list(a)
        for _ in range(r.randint(0, 30)):
            k = r.randrange(len(b) + 1)
            b[k : k + 1] = r.choice([[], ["x"], ["y", "z"]])
        s.append(a)
        t.append("".join(b))
    want = [distance(a, b) <= int(max(len(a), len(b)) * 0.1 + 1e-9) for a, b in zip(s, t, strict=True)]
    assert _edits.within(s, t, 0.1, True).tolist() == want
    assert _edits.within(s, t, 0.1).tolist() == want and 20 < sum(want) < 180
    monkeypatch.setattr(_edits, "WIDE", 0)
    assert _edits.within(s, t, 0.1).tolist() == want


def test_lines_over_bytes(monkeypatch):
    texts = [None, "", " ", "\n\n", "A b,\n«Été» x y ’z’\n!!\n", "İx Σ\n last", "-a- --\n\x85b c", "don't\n" * 40]
    want = [(k, no, n) for k, x in enumerate(texts) for no, line in enumerate((x or "").split("\n")) if (n := lines.normal_line(line))]
    for piece in (1, 1 << 20):
        monkeypatch.setattr(_lines, "PIECE", piece)
        got = []
        for part in _lines.pieces(texts):
            found = _lines.Lines([x for _, _, x in part])
            doc, no = lines._places(part, found.of)
            got += zip(doc.tolist(), no.tolist(), found.texts(np.arange(len(found.of))).to_pylist(), strict=True)
            assert found.chars.tolist() == [len(x[2]) for x in got[len(got) - len(found.of) :]]
        assert got == want
