"""Outsiders by blocks, components in one task, banded edits."""

import random

import numpy as np
import pyarrow as pa

from lodestone.llm import _edits, _graph, lines

from .test_lines import brute, distance


def test_one_passage_after_different_openings(spark, monkeypatch):
    """Lines that share their windows, of which some only are linked, in blocks of three."""
    monkeypatch.setattr(_graph, "BLOCK", 3)
    r = random.Random(11)

    def words(n):
        return " ".join("".join(r.choices("abcdefgh", k=r.randint(2, 8))) for _ in range(n))

    passage, far = words(18), words(9)
    texts = [f"{words(r.choice([1, 2, 4, 6]))} {passage}" for _ in range(24)] + [f"{far[: 40 + k]}{k} {passage}" for k in range(8)]
    rows = list(enumerate(texts))
    want = brute(rows)
    got = {g.doc_id: g.first_doc_id for g in lines.fuzzy_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: want[lines.normal_line(x)][0] for k, x in rows}
    assert 2 < len(set(got.values())) < 30


def test_joined_rows_are_not_compared_again():
    """An outsider that is linked with one of a component's 200 rows is not compared with the others, one that is not linked with all of them."""
    many = 202
    rows = pa.table({"bucket": np.ones(many, np.int64), "xs": np.zeros(many, np.int64), "ys": np.zeros(many, np.int64), "role": np.r_[0, 0, np.ones(200, np.int64)], "id": np.arange(many), "component": np.r_[0, 1, np.full(200, 2)], "out": np.arange(many) < 2, "buckets": pa.array([[1]] * many, pa.list_(pa.int64()))})
    compared = []

    def met(table, x, y):
        return np.repeat(x, len(y)), np.tile(y, len(x))

    def within(table, x, y):
        compared.extend(x.tolist())
        return x == 0

    found = pa.Table.from_batches(_graph.looked_for(iter(rows.to_batches()), met, within))
    assert 0 < compared.count(0) < 10 and compared.count(1) == 200
    assert set(found.column("a").to_pylist()) == {0}


def test_components_in_one_task_and_by_stars(spark, monkeypatch):
    r = random.Random(3)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(180)] + [(k, k + 1) for k in range(1000, 1100)] + [(-5, 7), (9, 9)]
    df = spark.createDataFrame(edges, "a long, b long")
    at_once = {c.id: c.component for c in _graph.components(df).collect()}
    monkeypatch.setattr(_graph, "ONE_TASK", 0)
    stars = {c.id: c.component for c in _graph.components(df).collect()}
    assert at_once == stars and at_once[1100] == 1000 and _graph.components(df.limit(0)).count() == 0


def test_bands_of_edits_against_the_whole_matrix():
    """Pairs of several words of 64 characters near the limit, ones with different ends, and ones far apart, together."""
    r = random.Random(6)
    s, t = [], []
    for k in range(90):
        a = r.choices("abcdefg ", k=r.randint(60, 420))
        b = list(a)
        for _ in range(int(len(a) * r.choice([0.02, 0.08, 0.1, 0.12, 0.3]))):
            at = r.randrange(len(b) + 1) if k % 3 else r.randrange(min(len(b), 60) + 1)
            b[at : at + 1] = r.choice([[], ["x"], ["y", "z"]])
        s.append("".join(a))
        t.append("".join(b))
    for share in (0.1, 0.25):
        want = [distance(a, b) <= int(max(len(a), len(b)) * share + 1e-9) for a, b in zip(s, t, strict=True)]
        assert _edits.within(s, t, share).tolist() == want and 15 < sum(want) < 85
