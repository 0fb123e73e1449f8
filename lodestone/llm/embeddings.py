"""Operator 4: near-duplicate embeddings by HNSW graphs.

Equal vectors of one label are one class. The classes of a label are dealt over shards of a bounded size; a graph is built for each
shard and written to the shared folder. Every class is a query to every shard of its label; see _hnsw.py for how
beams widen. A task returns how many vectors each query is linked with in its shard and, instead of the pairs, a
forest that connects them, from which the components are made. So copies, however many, make no pairs of rows.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _graph, _util
from ._hnsw import QUERIES, Graph

COSINE = 0.93
#: Numbers in the vectors of a shard (32768 vectors of 64), and queries that one task puts to it, about.
VALUES, SPLIT = 1 << 21, 32_768


def _dump(arrays: list[np.ndarray]) -> bytes:
    out = io.BytesIO()
    for a in arrays:
        np.save(out, a, allow_pickle=False)
    return out.getvalue()


def _load(data: bytes) -> list[np.ndarray]:
    stream, out = io.BytesIO(data), []
    while stream.tell() < len(data):
        out.append(np.load(stream, allow_pickle=False))
    return out


def _unit(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows of length 1, safe from overflow."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = np.asarray(column.flatten(), np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(1, keepdims=True, initial=0.0) if len(x) else x
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _built(group: pa.Table) -> pa.Table:
    graph = Graph(_unit(group.column("embedding")))
    blob = _dump([group.column("id").to_numpy(), group.column("n").to_numpy(), *graph.dump()])
    return pa.table({c: group.column(c).slice(0, 1) for c in ("label", "dim", "shard")} | {"blob": pa.array([blob], pa.large_binary() if len(blob) >= 1 << 31 else pa.binary())})


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the pairs (a, b) connect: each node with the smallest it reaches."""
    nodes, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = where[: len(a)], where[len(a) :]
    least = np.arange(len(nodes))
    while len(x):
        old = least.copy()
        np.minimum.at(least, x, least[y])
        np.minimum.at(least, y, least[x])
        least = least[least]
        if (old == least).all():
            break
    apart = least != np.arange(len(nodes))
    return nodes[least[apart]], nodes[apart]


def _asked(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Batches come sorted: a shard's graph, then its queries."""
    key, graph, ids, counts = None, None, None, None
    for b in batches:
        names = [b.column(c).to_pylist() for c in ("label", "dim", "shard", "split")]
        keys = list(zip(*names, strict=True))
        k = 0
        while k < len(b):
            if b.column("blob")[k].is_valid:
                key = keys[k]
                ids, counts, order, exact, *links = _load(b.column("blob")[k].as_py())
                graph = Graph.loaded(order, exact, links)
                k += 1
                continue
            end = k
            while end < len(b) and end < k + QUERIES and keys[end] == key and not b.column("blob")[end].is_valid:
                end += 1
            assert end > k, "a query without its shard"
            part = b.slice(k, end - k)
            k = end
            own = part.column("id").to_numpy()
            q, v = graph.within(_unit(part.column("embedding")), least)
            apart = own[q] != ids[v]
            q, v = q[apart], v[apart]
            linked = np.bincount(q, counts[v], len(own)).astype(np.int64)
            some = linked > 0
            x, y = _forest(own[q], ids[v])
            none = pa.nulls(int(some.sum()), pa.int64())
            yield pa.record_batch([pa.concat_arrays([pa.array(own[some]), pa.array(x)]), pa.concat_arrays([none, pa.array(y)]), pa.concat_arrays([pa.array(linked[some]), pa.nulls(len(x), pa.int64())])], ["a", "b", "n"])


def near_vectors(df: DataFrame, least: float = COSINE, shard: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each row of df(vec_id, embedding, label, ...).

    Vectors of one label and length are linked if their cosine is at least `least`. A vector without label, or that is null,
    empty, zero or holds a null or non-finite component, links with nothing. n_links counts the other rows linked directly,
    component_id is the smallest vec_id reachable, and kept is whether that is the vector's own. Rows with one vec_id each count.
    A row without vec_id links with nothing. shard: vectors in a shard, or as many as make VALUES numbers; each vector is searched in every shard of its label.
    """
    spark = df.sparkSession
    _util.small_batches(spark, 2048)
    v = _util.only(df, "vec_id", "embedding", "label")
    fine = "label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL AND coalesce(forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')), false) AND exists(embedding, x -> x <> 0)"
    good = v.where(fine)
    classes = good.groupBy("label", "embedding").agg(F.min("vec_id").alias("first"), F.count("*").alias("n")).withColumn("dim", F.size("embedding"))
    # classes have ids of their own, as different vectors may have one vec_id
    classes = _util.materialize(classes.withColumn("id", F.monotonically_increasing_id()))
    sizes = classes.groupBy("label", "dim").agg(F.count("*").alias("size")).select("label", "dim", F.expr(f"CAST(ceil(size / {shard or f'greatest(1, {VALUES} div dim)'}) AS INT)").alias("shards"), F.expr(f"CAST(ceil(size / {SPLIT}) AS INT)").alias("splits"))
    dealt = classes.join(sizes, ["label", "dim"]).withColumn("own", F.expr("CAST(pmod(xxhash64(id), shards) AS INT)"))
    built = dealt.select("label", "dim", F.col("own").alias("shard"), "id", "n", "embedding").groupBy("label", "dim", "shard").applyInArrow(_built, f"label {df.schema['label'].dataType.simpleString()}, dim int, shard int, blob binary")
    built = _util.materialize(built)
    emb = df.schema["embedding"].dataType.simpleString()
    graphs = built.join(sizes, ["label", "dim"]).select("label", "dim", "shard", F.explode(F.expr("sequence(0, splits - 1)")).alias("split"), F.lit(None).cast("long").alias("id"), F.lit(None).cast(emb).alias("embedding"), "blob")
    asked = dealt.select("label", "dim", F.explode(F.expr("sequence(0, shards - 1)")).alias("shard"), F.expr("CAST(pmod(xxhash64(id, 7), splits) AS INT)").alias("split"), "id", "embedding", F.lit(None).cast("binary").alias("blob"))
    keys = ["label", "dim", "shard", "split"]
    met = graphs.unionByName(asked).repartition(*keys).sortWithinPartitions(*keys, F.col("id").asc_nulls_first())
    found = _util.materialize(met.mapInArrow(lambda it: _asked(it, least), "a long, b long, n long"))
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("links"))
    components = _graph.components(found.where("b IS NOT NULL").select("a", "b"))
    nodes = classes.join(counts, "id", "left").join(components, "id", "left").withColumn("node", F.coalesce("component", "id"))
    firsts = nodes.groupBy("node").agg(F.min("first").alias("component_id"))
    of = nodes.join(firsts, "node").select("label", "embedding", F.expr("coalesce(links, 0) + n - 1").alias("links"), F.col("component_id").alias("component"))
    # classes are met again by a hash of their vectors, and by these themselves
    hashed = F.xxhash64("label", "embedding")
    left = v.withColumn("h", F.when(F.expr(fine), hashed))
    right = of.select(hashed.alias("h"), F.col("label").alias("_l"), F.col("embedding").alias("_e"), "links", "component")
    out = left.join(right, (left.h == right.h) & (left.label == right._l) & (left.embedding == right._e), "left")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id")).withColumn("kept", F.expr("vec_id <=> component_id"))


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links among all embeddings."""
    return near_vectors(_util.table(spark, sf_dir, "embeddings"))


OP4_SQL = f"""
WITH v AS (SELECT vec_id, label, embedding FROM embeddings),
good AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM v WHERE label IS NOT NULL AND embedding IS NOT NULL
  AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0 AND len([x for x in embedding if x <> 0]) > 0),
edges AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= {COSINE}),
reach AS (WITH RECURSIVE r(id, to_id) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.id, e.b FROM r JOIN edges e ON r.to_id = e.a) SELECT id, min(to_id) AS component_id FROM r GROUP BY id),
links AS (SELECT a, count(*) AS n FROM edges GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN reach ON id = vec_id LEFT JOIN links ON a = vec_id
"""
