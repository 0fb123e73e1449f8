"""Operator 4 against all pairs."""

import math

import numpy as np

from lodestone.llm import embeddings
from lodestone.llm._hnsw import Graph


def brute(rows):
    def fine(e):
        return bool(e) and all(x is not None and math.isfinite(x) for x in e) and any(e)

    unit = {k: np.array(e) / np.abs(e).max() for k, (i, e, la) in enumerate(rows) if la is not None and i is not None and fine(e)}
    unit = {k: x / np.linalg.norm(x) for k, x in unit.items()}
    near = {k: [j for j in unit if j != k and rows[j][2] == rows[k][2] and len(unit[j]) == len(unit[k]) and unit[j] @ unit[k] >= 0.93] for k in unit}
    out = []
    for k, (i, _, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for j in near.get(todo.pop(), []):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        c = i if i is None else min(rows[j][0] for j in seen)
        out.append((i, len(near.get(k, [])), c, i == c))
    return sorted(map(str, out))


def test_against_brute_force(spark):
    r = np.random.default_rng(4)
    rows = []
    for c in range(12):
        base = r.normal(size=16)
        for k in range(12 if c else 90):
            rows.append((len(rows) * 7 % 3001, [float(x) for x in np.float32(base + r.normal(size=16) * 0.16)], c % 3))
    rows += [(4000, rows[0][1], 0), (4001, rows[0][1], 0), (4002, rows[0][1], 1), (4003, rows[0][1], None), (4001, rows[0][1], 0), (4004, [0.0] * 16, 0), (4005, None, 0), (4006, [], 0), (4007, [1.0, None], 0), (4008, [math.nan] * 16, 0), (4009, [math.inf] + [0.0] * 15, 0), (4010, [1e-30] * 16, 2), (4011, [3e38] * 16, 2), (4012, [1.0, 1.0], 2), (4013, [2.0, 2.0], 2), (None, rows[0][1], 0)]
    df = spark.createDataFrame([(*x, 1) for x in rows], "vec_id long, embedding array<float>, label int, n int")
    want = brute(rows)
    assert sorted(str(tuple(x)) for x in embeddings.near_vectors(df).collect()) == want
    assert sorted(str(tuple(x)) for x in embeddings.near_vectors(df, shard=20).collect()) == want
    assert embeddings.near_vectors(df.limit(0)).count() == 0


def test_recall():
    r = np.random.default_rng(1)
    x = np.repeat(r.normal(size=(700, 32)), 5, 0) + r.normal(size=(3500, 32)) * 0.2
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    a, b = Graph(x).within(x, 0.93)
    true = set(zip(*map(np.ndarray.tolist, np.nonzero(x @ x.T >= 0.93)), strict=True))
    found = set(zip(a.tolist(), b.tolist(), strict=True))
    assert found <= true and len(found) >= 0.97 * len(true)


def test_repeated_vec_ids_and_several_shards(spark):
    """Different vectors of one vec_id are linked; several shards of more than 64 vectors, searched by graph, give all pairs."""
    two = [(5, [1.0, 0.0], 1), (5, [1.0, 0.04], 1), (7, [0.0, 1.0], 1)]
    got = embeddings.near_vectors(spark.createDataFrame(two, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(5, 1, 5), (5, 1, 5), (7, 0, 7)]
    r = np.random.default_rng(4)
    base = r.normal(size=(150, 16))
    x = np.concatenate([base, base[r.integers(0, 150, 450)] + r.normal(size=(450, 16)) * 0.2])
    rows = [(k, v.tolist(), 1) for k, v in enumerate(x)]
    got = {g.vec_id: g.n_links for g in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), shard=200).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = ((u @ u.T >= embeddings.COSINE).sum(1) - 1).tolist()
    assert sum(want) > 300 and sum(got.values()) >= 0.98 * sum(want) and all(got[k] <= w for k, w in enumerate(want))


def test_shards_hold_more_than_a_few_thousand_vectors(spark, monkeypatch):
    """A label of 9000 short vectors is one shard, so that each is searched once; blocks of all cosines are bounded."""
    built = []
    write = embeddings._util.materialize
    monkeypatch.setattr(embeddings._util, "materialize", lambda df: built.append(write(df)) or built[-1])
    r = np.random.default_rng(2)
    rows = [(k, v.tolist(), 1) for k, v in enumerate(r.normal(size=(9000, 8)))]
    embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    assert [b.count() for b in built if "blob" in b.columns] == [1]
    monkeypatch.setattr("lodestone.llm._hnsw.COSINES", 700)
    x = r.normal(size=(300, 4))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = Graph(x)
    a, b = got._all(x, 0.93)
    assert sorted(zip(a.tolist(), got.order[b].tolist(), strict=True)) == sorted(zip(*map(np.ndarray.tolist, np.nonzero(x @ x.T >= 0.93)), strict=True))
