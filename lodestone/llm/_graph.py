"""Links within buckets and connected components, without gathering a bucket or a component anywhere."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import _util
from ._hash import mix

#: Edges up to which one task finds their components.
ONE_TASK = 1 << 21
#: Rows of a side of a block of pairs, rows whose blocks a task reads together, and pairs that it holds at a time, about.
BLOCK, TOGETHER, PAIRS = 1024, 1 << 14, 1 << 19
#: Rows that blocks are dealt at a time, at least, and times as many as the rows that they are made of.
ROWS, TIMES = 1 << 18, 2
#: Pairs for each entry of a bucket up to which no further leaders are taken, for links that blocks look for.
DENSE = 64
#: Members of a bucket that all others are compared with first.
LEADERS = 4
#: Entries of buckets that a task holds at a time, about.
ENTRIES = 1 << 19
#: Kinds of entry: the one of its bucket in a task, with no other id there or with some, and such another.
_ALONE, _HAS_MATES, _MATE = 0, 1, 2


def roots(a: np.ndarray, b: np.ndarray, many: int) -> np.ndarray:
    """Of each of the nodes 0, 1, ... the smallest that the edges (a, b) link it with."""
    least = np.arange(many)
    while len(a):
        x, y = least[a], least[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(least, np.maximum(x, y), np.minimum(x, y))
        while (least != least[least]).any():
            least = least[least]
    return least


def _at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, component of all edges (v, u)."""
    found = [np.zeros((2, 0), np.int64), *(np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in batches)]
    v, u = np.concatenate(found, axis=1)
    v, u = v[v != u], u[v != u]
    nodes, at = np.unique(np.concatenate([v, u]), return_inverse=True)
    component = nodes[roots(at[: len(v)], at[len(v) :], len(nodes))]
    for k in range(0, len(nodes), 1 << 16):
        yield pa.record_batch([pa.array(nodes[k : k + (1 << 16)]), pa.array(component[k : k + (1 << 16)])], ["id", "component"])


def components(edges: DataFrame) -> DataFrame:
    """id, component: of each node of edges(a, b) the smallest node that it is linked with.

    Up to ONE_TASK edges go to one task. More take large-star and small-star steps: each node's larger, then its smaller neighbours are linked with its smallest one, until every
    component is a star around its smallest node. A step is an aggregate and a join; its edges are written to the shared
    folder, and whether they changed is seen while they are written. Those of the step before are deleted.
    """
    pairs = edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct()
    last = before = None
    while True:
        pairs, seen = _util.materialize_seen(pairs, F.count("*").alias("n"), F.bit_xor(F.xxhash64("v", "u")).alias("x"))
        if before is not None:
            _util.discard(before)
        before = pairs
        if 0 < seen["n"] <= ONE_TASK:
            return pairs.coalesce(1).mapInArrow(_at_once, "id long, component long")
        if seen == last or not seen["n"]:
            break
        last = seen
        both = pairs.union(pairs.select("u", "v")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select("v", F.col("m").alias("u"))
        large = large.where("v <> u").distinct()
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v")
        pairs = small.select(F.col("u").alias("v"), F.col("m").alias("u")).union(small.select("v", F.col("m").alias("u"))).where("v <> u").distinct()
    return pairs.select(F.col("v").alias("id"), F.col("u").alias("component")).union(pairs.select(F.col("u").alias("id"), F.col("u").alias("component"))).groupBy("id").agg(F.min("component").alias("component"))


def _dealt(parts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of (id, buckets): for each part of the buckets, packed, one entry of each bucket met in this task, and apart from it the bucket's further ids here, which need no meeting."""

    def flush(ids: list[np.ndarray], keys: list[np.ndarray]) -> pa.RecordBatch:
        key, own = np.concatenate(keys), np.concatenate(ids)
        order = np.argsort(key, kind="stable")
        key, own = key[order], own[order]
        first = np.r_[True, key[1:] != key[:-1]]
        kind = np.where(first, np.where(np.r_[~first[1:], False], _HAS_MATES, _ALONE), _MATE).astype(np.uint8)
        # further ids of a bucket are spread, so that a hot one is in no single place
        part = (mix(np.where(first, key, key ^ mix(own.view(np.uint64)))) % np.uint64(parts)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        part, key, own, kind = part[order], key[order], own[order], kind[order]
        starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        blobs = [key[i:j].tobytes() + own[i:j].tobytes() + kind[i:j].tobytes() for i, j in zip(starts, np.r_[starts[1:], len(part)], strict=True)]
        return pa.record_batch([pa.array(part[starts]), pa.array(blobs, pa.binary())], ["part", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, keys, size = [], [], 0
        for b in batches:
            lists = b.column(1)
            flat = lists.flatten().to_numpy().view(np.uint64)
            keys.append(flat)
            ids.append(np.repeat(b.column(0).to_numpy(), lists.value_lengths().to_numpy()))
            size += len(flat)
            if size > ENTRIES:
                yield flush(ids, keys)
                ids, keys, size = [], [], 0
        if size:
            yield flush(ids, keys)

    return run


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """bucket, id of the entries of whole parts whose bucket has several ids."""
    found = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint8)]
    for b in batches:
        for blob in b.column(0):
            data = blob.as_buffer()
            n = data.size // 17
            for out, kind, at in zip(found, (np.uint64, np.int64, np.uint8), (0, 8 * n, 16 * n), strict=True):
                out.append(np.frombuffer(data, kind, n, at))
    key, own, kind = map(np.concatenate, found)
    del found
    order = np.argsort(key, kind="stable")
    key, own, kind = key[order], own[order], kind[order]
    apart = key[1:] != key[:-1]
    several = kind != _ALONE
    if len(key):
        several |= ~(np.r_[True, apart] & np.r_[apart, True])
    key, own = key[several], own[several]
    for k in range(0, len(key), 1 << 16):
        yield pa.record_batch([pa.array(key[k : k + (1 << 16)].view(np.int64)), pa.array(own[k : k + (1 << 16)])], ["bucket", "id"])


def shared_buckets(classes: DataFrame, entries: int) -> DataFrame:
    """bucket, id, size: of classes(id long, buckets array<long>, none twice in a list) the buckets that several ids share, and how many do. entries: those of all lists, or more.

    Entries go to their parts packed, one a bucket and task and its further ids spread over all parts, so that a task holds about ENTRIES, however many ids a bucket has.
    """
    parts = max(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-entries // ENTRIES))
    dealt = classes.select("id", "buckets").mapInArrow(_dealt(parts), "part int, blob binary").repartition(parts, "part").select("blob")
    rows = _util.materialize(dealt.mapInArrow(_met, "bucket long, id long"))
    return rows.join(rows.groupBy("bucket").agg(F.count("*").alias("size")), "bucket")


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups, of about TOGETHER rows, and the groups' bounds. Rows come sorted by the first so many columns, longs."""
    rest, many = [], 0
    for b in batches:
        rest.append(b)
        many += len(b)
        if many < TOGETHER:
            continue
        table = pa.Table.from_batches(rest).combine_chunks()
        bounds = _bounds(table, keys)
        if len(bounds) > 2:
            yield table.slice(0, bounds[-2]), bounds[:-1]
            table = table.slice(bounds[-2])
        rest, many = table.to_batches(), len(table)
    if many:
        table = pa.Table.from_batches(rest).combine_chunks()
        yield table, _bounds(table, keys)


def _bounds(table: pa.Table, keys: int) -> np.ndarray:
    new = np.zeros(len(table), bool)
    new[0] = True
    for k in range(keys):
        c = table.column(k).to_numpy()
        new[1:] |= c[1:] != c[:-1]
    return np.r_[np.flatnonzero(new), len(table)]


def _first_shared(lists: pa.ListArray, i: np.ndarray, j: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """Whether each pair of rows shares no bucket less than its own one."""
    starts, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    size = np.diff(starts)
    out = np.zeros(len(i), bool)
    step = max(1, (1 << 23) // max(1, int(size.max(initial=0)) ** 2))
    for k in range(0, len(i), step):
        a, b, own = i[k : k + step], j[k : k + step], bucket[k : k + step]
        x, y = (np.arange(size[r].max()) for r in (a, b))
        ours, theirs = (flat[np.minimum(starts[r][:, None] + c, len(flat) - 1)] for r, c in ((a, x), (b, y)))
        less = (ours < own[:, None]) & (x < size[a][:, None])
        theirs_less = (theirs < own[:, None]) & (y < size[b][:, None])
        out[k : k + step] = ~((ours[:, :, None] == theirs[:, None, :]) & less[:, :, None] & theirs_less[:, None, :]).any((1, 2))
    return out


def looked_for(batches: Iterator[pa.RecordBatch], met: Callable[[pa.Table, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], within: Callable[[pa.Table, np.ndarray, np.ndarray], np.ndarray]) -> Iterator[pa.RecordBatch]:
    """a, b: links that join what the links among all pairs of blocks (bucket, xs, ys, role, id, component, out, buckets, ...) join.

    A block pairs its rows of role 0, outsiders, with those of role 1. met gives the pairs that may be linked, those of one outsider together and the likeliest first; within says whether
    they are. Some of each outsider's pairs are compared at a time, and those left out whose rows were joined meanwhile, as their link would join nothing.
    """
    for table, bounds in _groups(batches, 3):
        role, ids, out = (table.column(c).to_numpy() for c in ("role", "id", "out"))
        buckets, lists = table.column("bucket").to_numpy(), table.column("buckets").combine_chunks()
        names, of = np.unique(table.column("component").to_numpy(), return_inverse=True)
        root, found, many = np.arange(len(names)), [], 0
        spans = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            middle = a + int(np.searchsorted(role[a:b], 1))
            step = max(1, PAIRS // 4 // max(1, b - middle))
            spans += [(k, min(k + step, middle), middle, b) for k in range(a, middle, step)]
        for k, (x, x_end, y, y_end) in enumerate(spans):
            i, j = met(table, np.arange(x, x_end), np.arange(y, y_end))
            on = (root[of[i]] != root[of[j]]) & (~out[j] | (ids[i] < ids[j]))
            found.append((i[on], j[on]))
            many += len(found[-1][0])
            if many < PAIRS and k + 1 < len(spans):
                continue
            i, j = (np.concatenate(x) for x in zip(*found, strict=True))
            found, many = [], 0
            on = _first_shared(lists, i, j, buckets[i])
            i, j, some = i[on], j[on], 4
            while len(i):
                # pairs of one outsider lie together
                first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
                now = np.arange(len(i)) - np.repeat(first, np.diff(np.r_[first, len(i)])) < some
                x, y = i[now], j[now]
                alike = within(table, x, y)
                x, y = x[alike], y[alike]
                if len(x):
                    yield pa.record_batch([pa.array(np.minimum(ids[x], ids[y])), pa.array(np.maximum(ids[x], ids[y]))], ["a", "b"])
                    root = roots(np.r_[root, of[x]], np.r_[np.arange(len(names)), of[y]], len(names))
                left = ~now & (root[of[i]] != root[of[j]])
                i, j, some = i[left], j[left], some * 2


def in_blocks(rest: DataFrame, what: DataFrame, schema: str, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """What run makes of the blocks of rest(bucket, id, component, out, ...) with the values of what(id, buckets, ...): each bucket's outsiders and its members, dealt over blocks of about BLOCK.

    A row is in as many blocks as its bucket has on the other side, so all of them at once would grow with the square of a bucket. Blocks are dealt in passes of about
    TIMES as many rows as rest has, and the shuffle files of a pass go before the next one's are many.
    """
    sizes = rest.groupBy("bucket").agg(F.expr(f"CAST(ceil(count_if(out) / {BLOCK}) AS INT)").alias("_xs"), F.expr(f"CAST(ceil(count(*) / {BLOCK}) AS INT)").alias("_ys")).where("_xs > 0")
    values = _util.materialize(what.join(rest.select("id").distinct(), "id", "left_semi"))
    own, seen = _util.materialize_seen(rest.join(sizes, "bucket").join(values, "id"), F.count("*").alias("n"), F.expr("sum(_xs + IF(out, _ys, 0))").alias("dealt"))
    _util.discard(values)
    passes = -(-(seen["dealt"] or 0) // max(ROWS, TIMES * seen["n"])) or 1
    keys = ["bucket", "xs", "ys", "role"]
    columns = [c for c in own.columns if c not in ("bucket", "_xs", "_ys")]

    def dealt(rows: DataFrame, role: int, mine: str, others: str, k: int) -> DataFrame:
        rows = rows.withColumn(mine, F.expr(f"pmod(xxhash64(id, {role}), _{mine})")).withColumn(others, F.explode(F.expr(f"sequence(0L, _{others} - 1L)"))).withColumn("role", F.lit(role).cast("long"))
        return rows.where(f"pmod(xxhash64(bucket, xs, ys), {passes}) = {k}").select(*keys, *columns)

    parts = int(rest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = []
    for k in range(passes):
        blocks = dealt(own.where("out"), 0, "xs", "ys", k).unionByName(dealt(own, 1, "ys", "xs", k))
        found.append(_util.materialize(blocks.repartition(parts, *keys[:3]).sortWithinPartitions(*keys).mapInArrow(run, schema)))
    _util.discard(own)
    return reduce(DataFrame.unionByName, found)


def _merged(of: DataFrame, links: DataFrame) -> DataFrame:
    """of(id, component) after further links(a, b): what they join are components already."""
    a, b = of.toDF("a", "_a"), of.toDF("b", "_b")
    joined = _util.materialize(components(links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b")))).toDF("component", "_merged")
    ends = links.select(F.col("a").alias("id")).union(links.select("b")).distinct().join(of, "id", "left_anti").select("id", F.col("id").alias("component"))
    return _util.materialize(of.unionByName(ends).join(joined, "component", "left").select("id", F.coalesce("_merged", "component").alias("component")))


def linked(members: DataFrame, buckets: DataFrame, alike: Callable[[str], str], cell: str, verify: Callable[[DataFrame], DataFrame], blocks: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """id, component: those of all links between two members of one bucket, for each id that has one; component is the smallest id.

    members: bucket, id, size and what `alike(prefix)` and `cell` need; buckets: id, and `buckets`, all of its buckets. alike gives SQL
    that must hold for a linked pair of rows, cell an integer that differs by 1 at most between linked rows, and verify keeps the linked
    ones of pairs (a, b). blocks, where given, finds links that join what the pairs left at the end join: of (bucket, id, component, out
    and the values), by in_blocks().

    In each bucket all are compared with the few members that share most buckets with others, the most central. Two members
    then are in one component already, or one of them is outside the bucket's largest component. While such outsiders would make many pairs,
    and rounds join many of them, the most central outsiders lead their buckets likewise; each one that is left is then
    compared with every member of another component in the first of the buckets that both share. No pair of a bucket is
    left out but those in one component, so the components are those of all pairs.
    """
    values = [c for c in members.columns if c not in ("bucket", "id", "size")]
    central = members.groupBy("id").agg(F.sum("size").alias("central"))
    now, seen = _util.materialize_seen(members.join(central, "id").select("bucket", "id", *values, "central", F.col("id").alias("component"), F.lit(True).alias("out")), F.count("*").alias("n"))
    all_members, of = seen["n"], None
    w = W.partitionBy("bucket").orderBy(F.desc("out"), F.desc("central"), "id")
    while True:
        # a limit by rank in its bucket is taken before the exchange already, so no bucket is gathered
        heads = now.withColumn("_rank", F.row_number().over(w)).where(f"_rank <= {LEADERS}")
        heads = _util.materialize(heads.select("bucket", F.col("id").alias("leader"), F.col("component").alias("y_component"), *[F.col(c).alias(f"y_{c}") for c in values]))
        star = now.join(heads, "bucket").where(f"component <> y_component AND ({alike('y_')})")
        pairs = _util.materialize(star.select(F.least("leader", "id").alias("a"), F.greatest("leader", "id").alias("b")).distinct())
        links, seen = _util.materialize_seen(verify(pairs), F.count("*").alias("n"))
        _util.discard(pairs)
        of = _merged(of, links) if of is not None else _util.materialize(components(links))
        found = seen["n"]
        now_of = now.drop("component", "out").join(of, "id", "left").withColumn("component", F.coalesce("component", "id"))
        main = now_of.groupBy("bucket", "component").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.max(F.struct("n", "component"))["component"].alias("main"), F.count("*").alias("parts"), F.sum("n").alias("size"), F.max("n").alias("largest")).where("parts > 1")
        main = _util.materialize(main.select("bucket", "main", F.expr("(size - largest) * size").alias("left")))
        # what has led its bucket has been compared with all of it
        rest = now_of.join(main.drop("left"), "bucket").join(heads.select("bucket", F.col("leader").alias("id")), ["bucket", "id"], "left_anti")
        rest, seen = _util.materialize_seen(rest.select("bucket", "id", *values, "central", "component", F.expr("component <> main").alias("out")), F.count_if("out").alias("n"))
        for old in (now, heads, links):
            _util.discard(old)
        now = rest
        if not seen["n"]:
            return of
        if found < seen["n"] / 20 or main.agg(F.sum("left")).first()[0] <= (DENSE if blocks else 2) * all_members:
            break
    if blocks:
        links, seen = _util.materialize_seen(blocks(now.select("bucket", "id", "component", "out", *values)), F.count("*").alias("n"))
        _util.discard(now)
        return _merged(of, links) if seen["n"] else of
    now = now.join(buckets, "id").select("bucket", "id", *values, "component", "buckets", F.expr(f"CAST({cell} AS INT)").alias("cell"), "out")
    now = _util.materialize(now)
    y = now.select("bucket", "cell", *[F.col(c).alias(f"y_{c}") for c in now.columns if c not in ("bucket", "cell")])
    rest = now.where("out").withColumn("cell", F.explode(F.expr("array(cell - 1, cell, cell + 1)"))).join(y, ["bucket", "cell"])
    rest = rest.where(f"component <> y_component AND (NOT y_out OR id < y_id) AND ({alike('y_')}) AND array_min(array_intersect(buckets, y_buckets)) = bucket")
    pairs, seen = _util.materialize_seen(rest.select(F.least("id", "y_id").alias("a"), F.greatest("id", "y_id").alias("b")), F.count("*").alias("n"))
    _util.discard(now)
    if not seen["n"]:
        return of
    return _merged(of, _util.materialize(verify(pairs)))
