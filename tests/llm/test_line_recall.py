"""Recall of operator 8 against all pairs of lines of edit similarity 0.9, with no condition on candidates."""

import random
import string

from lodestone.llm import lines

from .test_lines import distance


def typo(r, text):
    k = r.randrange(len(text))
    return text[:k] + r.choice(string.ascii_lowercase) + text[k + 1 :]


def pairs():
    """Lines of 4 to 120 words, each with copies of one word replaced, a typo, or several words replaced, that have edit similarity 0.9."""
    r = random.Random(5)
    vocabulary = ["".join(r.choices(string.ascii_lowercase, k=r.randint(2, 9))) for _ in range(4000)]
    out = []
    for n in [4, 5] * 60 + [6, 7, 8, 10, 12, 15, 20, 25, 30] * 14 + [60] * 6 + [120] * 2:
        words = r.choices(vocabulary, k=n)
        base = " ".join(words)
        for change in (1, 0, max(1, n // 14)):
            other = list(words)
            for k in r.sample(range(n), change):
                other[k] = r.choice(vocabulary)
            other = " ".join(other) if change else typo(r, base)
            if other != base and distance(base, other) <= int(max(len(base), len(other)) * 0.1 + 1e-9):
                out.append((base, other))
    return out


def test_recall(spark):
    made = pairs()
    rows = [(k, t) for k, t in enumerate(x for p in made for x in p)]
    got = {r.doc_id: r.first_doc_id for r in lines.fuzzy_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    short = [k for k, (a, b) in enumerate(made) if max(len(a), len(b)) <= lines.SHORT]
    found = [k for k in range(len(made)) if got[2 * k] == got[2 * k + 1]]
    assert len(short) > 60 and set(short) <= set(found)
    assert len(made) > 250 and len(found) >= 0.98 * len(made)
    # nothing else is linked: groups hold copies of one base
    assert all(made[d // 2][0] == made[f // 2][0] for d, f in got.items())


def test_short_lines_meet_exactly():
    r = random.Random(7)
    for _ in range(3000):
        a = "".join(r.choices("abc ", k=r.randint(10, lines.SHORT)))
        b = list(a)
        for _ in range(r.randint(1, lines.most_edits(len(a)) or 1)):
            k = r.randrange(len(b))
            b[k : k + 1] = r.choice([[], [r.choice("abc")], [b[k], r.choice("abc")]])
        b = "".join(b)
        if max(len(a), len(b)) <= lines.SHORT and distance(a, b) <= lines.most_edits(max(len(a), len(b))):
            assert a == b or lines.segment_keys(a) & lines.segment_keys(b)


def test_lines_of_few_words(spark):
    """Every line with a word has a row, and copies of the shortest go."""
    rows = [(1, "Les.\nAll rights reserved.\n\n. , ;\nOne two"), (2, "les\nall rights reserved\nChapter"), (3, "All rights reservd!\nother")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.line_no): (r.first_doc_id, r.first_line_no, r.kept) for r in lines.fuzzy_lines(df).collect()}
    alone = {k: (*k, True) for k in [(1, 0), (1, 1), (1, 4), (2, 2), (3, 1)]}
    assert got == alone | {(2, 0): (1, 0, False), (2, 1): (1, 1, False), (3, 0): (1, 1, False)}
    assert {r.doc_id: r.text for r in lines.dedup_lines(df).collect()} == {1: rows[0][1], 2: "Chapter", 3: "other"}
