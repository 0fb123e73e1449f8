"""Operator 6 against all pairs."""

from collections import Counter

import numpy as np

from lodestone.llm import _graph, _util, minhash


def brute(rows):
    def bag(t):
        w = (t or "").split()
        return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()

    ids = sorted({r[0] for r in rows if r[0] is not None and (r[1] or "").split()})
    bags = {r[0]: bag(r[1]) for r in rows}
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = bags[a], bags[b]
            n, m = sum(x.values()), sum(y.values())
            if min(n, m) >= 0.8 * max(n, m):
                both = sum((x & y).values())
                if both >= 0.8 * (n + m - both):
                    p, q = sorted((root(a), root(b)))
                    parent[q] = p
    return {i: root(i) for i in ids}


def test_against_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in _util.table(spark, sf, "documents").collect()]
    base = rows[2][1].split()
    many = [(10_000 + k, " ".join(base[: 5 * k] + [f"w{k}"] + base[5 * k + 1 :])) for k in range(40)]
    odd = [(20_000, None), (20_001, ""), (20_002, " "), (20_003, "one"), (20_004, "one"), (20_005, "one two"), (20_006, "z " * 40_000), (20_007, "z " * 39_000), (20_008, rows[5][1]), (20_008, rows[5][1]), (None, "one"), (None, None)]
    rows += many + odd
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, weight int")
    got = minhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    want = brute(rows)
    for r in got:
        assert r.component_id == want.get(r.doc_id, r.doc_id), r
        assert r.kept == (r.doc_id is None or r.component_id == r.doc_id) or r.doc_id == 20_008
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_rows_of_one_doc_id(spark):
    """Rows of one doc_id with different texts each have their own links and fate; rows that repeat are one."""
    words = [f"w{k}" for k in range(60)]
    a, b, c, d = " ".join(words), " ".join(words[:-1] + ["other"]), " ".join(words[::-1]), "something else altogether that is kept"
    rows = [(1, a), (5, d), (5, b), (7, c), (5, c), (9, d), (9, d), (None, a), (11, None), (11, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in minhash.near_duplicates(df).collect())
    assert got == [(0, 0, True), (1, 1, True), (5, 1, False), (5, 5, True), (5, 5, True), (7, 5, False), (9, 5, False), (9, 5, False), (11, 11, True), (11, 11, True)]
    left = sorted(((r.doc_id or 0), r.text or "") for r in minhash.keep_one(df).collect())
    assert left == sorted([(0, a), (1, a), (5, d), (5, c), (11, "")])


def test_outsiders_meet_without_their_leaders(spark):
    """Links that no leader has are found: chains, and groups that share a passage only."""
    r = np.random.default_rng(9)
    base = [f"w{x}" for x in r.integers(0, 10**6, 400)]
    rows = []
    for k in range(60):
        other = list(base)
        for j in range(k):  # neighbours in the chain are alike, the ends are not
            other[(j * 7) % 400] = f"x{j}"
        rows.append((k, " ".join(other)))
    shared = " ".join(f"s{k}" for k in range(60))
    rows += [(100 + k, f"{shared} " + " ".join(f"t{k}_{j}" for j in range(20))) for k in range(30)]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute(rows)
    assert got == want and len(set(want.values())) < 35


def test_signature_estimates_similarity():
    r = np.random.default_rng(1)
    words = [f"w{x}" for x in r.integers(0, 9000, 3000)]
    a, b = " ".join(words), " ".join(words[200:] + [f"v{x}" for x in range(250)])
    x, y = minhash.layers_of(a), minhash.layers_of(b)
    w, s, _ = minhash._flat([a, b])
    sig = minhash.signatures(*minhash.layered(*minhash.shingles(w, s)), 2, 2000)
    assert abs((sig[0] == sig[1]).mean() - minhash.similarity(x, y)) < 0.04


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, 90), (90, 95), (95, 100), (7, 7)]
    got = {r.id: r.component for r in _graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(61)} | {90: 90, 95: 90, 100: 90}
    assert _graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
