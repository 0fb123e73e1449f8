"""Operator 6: near-duplicate documents by DartMinHash.

A document is the multiset of its five-word shingles, each a weighted element. An element's region of weight is cut into
unit layers; hashed darts fall on a layer as a Poisson process in rank, the same in every document. A document throws as many
ranks as fill all coordinates of its signature with the earliest dart of each, so two signatures agree in a
coordinate with the probability of the weighted Jaccard similarity, and the work goes with the number of shingles and
darts, not with their product. Bands of the signature are joined on, and candidates verified on the whole multisets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _graph, _util
from ._hash import Words, mix, uniform

SHINGLE, SIMILARITY = 5, 0.8
#: A pair at the similarity shares no band with a probability of (1 - 0.8^4)^20 = 0.00003.
BANDS, BAND_ROWS = 20, 4
#: Bits of an odd sketch, and shingles above which every second, fourth and so on is sketched.
SKETCH, SKETCHED = 512, 1024
_WORDS = Words()
_MUL = [mix(np.uint64([k]))[0] | np.uint64(1) for k in range(1, 40)]


def shingles(words: np.ndarray, starts: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of texts that lie end to end (starts: their bounds), and the text of each. A text of fewer words has one of all its words."""
    sizes = np.diff(starts)
    many = np.where(sizes == 0, 0, np.maximum(sizes - n + 1, 1))
    doc = np.repeat(np.arange(len(sizes)), many)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many) + starts[doc]
    padded = np.concatenate([words, np.zeros(n, np.uint64)])
    h = np.zeros(len(doc), np.uint64)
    for k in range(n):
        h += np.where(at + k < starts[doc + 1], padded[at + k], np.uint64(0)) * _MUL[k]
    return mix(h), doc


def layered(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit layers of weighted elements, in order of document and hash: the k-th equal shingle of a text is layer k."""
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])] if len(h) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    layer = np.arange(len(h)) - first[np.cumsum(new) - 1] if len(h) else np.zeros(0, np.int64)
    return np.where(layer == 0, h, mix(h + layer.astype(np.uint64) * _MUL[-1])), doc


def signatures(elements: np.ndarray, doc: np.ndarray, docs: int, k: int) -> np.ndarray:
    """docs x k coordinates; a document without elements has zeros."""
    sig = np.zeros((docs, k), np.uint64)
    weight = np.bincount(doc, minlength=docs)
    reach = (k * math.log(k) + 2 * k) / np.maximum(weight, 1)
    todo = weight > 0
    while todo.any():
        on = todo[doc]
        e, d = elements[on], doc[on]
        flat = np.zeros(docs * k, np.uint64)
        rank, darts, cells = [], [], []
        r, seed = np.zeros(len(e)), e
        while len(e):
            seed = mix(seed ^ _MUL[-2])
            r = r - np.log(uniform(seed))
            hit = r <= reach[d]
            e, d, r, seed = e[hit], d[hit], r[hit], seed[hit]
            dart = mix(seed ^ _MUL[-3])
            rank.append(r)
            darts.append(dart | np.uint64(1))
            cells.append(d * k + (mix(dart) % np.uint64(k)).astype(np.int64))
        order = np.argsort(-np.concatenate(rank), kind="stable")  # the earliest is written last
        flat[np.concatenate(cells)[order]] = np.concatenate(darts)[order]
        flat = flat.reshape(docs, k)
        full = todo & (flat != 0).all(axis=1)
        sig[full] = flat[full]
        todo &= ~full
        reach = reach * 2
    return sig


def bands(sig: np.ndarray, rows: int = BAND_ROWS) -> np.ndarray:
    """One hash for each band, as signed integers."""
    s = sig.reshape(len(sig), -1, rows)
    h = np.broadcast_to(mix(np.arange(s.shape[1], dtype=np.uint64)), s.shape[:2]).copy()
    for k in range(rows):
        h = mix(h ^ s[:, :, k])
    return h.view(np.int64)


def sketches(elements: np.ndarray, doc: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd sketches, as docs x 8 signed integers, and the power of two of which one element is sketched.

    A bit is the parity of the elements that hash to it, so two sketches differ where the sets do, and the number of bits
    that differ bounds the similarity from above.
    """
    level = np.maximum(0, np.floor(np.log2(np.maximum(np.bincount(doc, minlength=docs), 1) / SKETCHED))).astype(np.int64)
    h = mix(elements ^ _MUL[-4])
    on = (h >> np.uint64(40)) & ((np.uint64(1) << level[doc].astype(np.uint64)) - np.uint64(1)) == 0
    cell = doc[on] * SKETCH + (h[on] & np.uint64(SKETCH - 1)).astype(np.int64)
    bits = (np.bincount(cell, minlength=docs * SKETCH) & 1).astype(np.uint8)
    return np.packbits(bits.reshape(docs, SKETCH), axis=1).view(np.int64).reshape(docs, SKETCH // 64), level.astype(np.int32)


def may_reach(threshold: float, y: str) -> str:
    """SQL: false for pairs whose sizes rule the threshold out, or whose sketches differ in more bits than four standard deviations above what similar sets make."""
    most = f"((weight + {y}weight) * {(1 - threshold) / (1 + threshold)!r}D / pow(2D, level))"
    most = f"({most} + CASE WHEN level > 0 THEN 4 * sqrt({most}) ELSE 0D END)"
    apart = " + ".join(f"bit_count(sketch[{k}] ^ {y}sketch[{k}])" for k in range(SKETCH // 64))
    # mean and variance of the bits that differ when so many elements do
    one, two = (f"pow({1 - k / SKETCH!r}D, {most})" for k in (2, 4))
    bound = f"{SKETCH / 2}D * (1 - {one}) + 2 * sqrt(greatest(0D, {SKETCH}D + {SKETCH * (SKETCH - 1)}D * {two} - {SKETCH**2}D * {one} * {one})) + 1"
    return f"least(weight, {y}weight) >= {threshold} * greatest(weight, {y}weight) AND (level <> {y}level OR {apart} <= {bound})"


def _flat(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    split = [t.split() for t in texts]
    starts = np.concatenate([[0], np.cumsum([len(s) for s in split])]).astype(np.int64)
    return np.concatenate([_WORDS.array(s) for s in split] + [np.zeros(0, np.uint64)]), starts, [" ".join(s) for s in split]


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sorted arrays of layers."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def layers_of(text: str) -> np.ndarray:
    words, starts, _ = _flat([text])
    return np.sort(layered(*shingles(words, starts))[0])


def _word_hash(joined: list[str]) -> np.ndarray:
    """Both halves of a hash of each text's words in order."""
    return np.frombuffer(b"".join(xxhash.xxh3_128_digest(j.encode("utf-8", "surrogatepass")) for j in joined), np.int64).reshape(-1, 2)


def _signed(docs: DataFrame) -> DataFrame:
    """id, h, c1, c2 (hash of the words in order), weight (number of shingles), bands, sketch, level of each row of docs(doc_id, text, h)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, starts, joined = _flat([t or "" for t in b.column(1).to_pylist()])
            h, doc = layered(*shingles(words, starts))
            made = bands(signatures(h, doc, len(joined), BANDS * BAND_ROWS))
            c = _word_hash(joined)
            weight = np.bincount(doc, minlength=len(joined))
            sketch, level = sketches(h, doc, len(joined))

            def lists(x: np.ndarray) -> pa.Array:
                return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(np.ascontiguousarray(x).reshape(-1)))

            yield pa.record_batch([b.column(0), b.column(2), pa.array(c[:, 0]), pa.array(c[:, 1]), pa.array(weight.astype(np.int64)), lists(made), lists(sketch), pa.array(level)], ["id", "h", "c1", "c2", "weight", "bands", "sketch", "level"])

    return docs.mapInArrow(run, f"id {kind}, h long, c1 long, c2 long, weight long, bands array<long>, sketch array<long>, level int")


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """id, text (compressed): a text of each class of wanted(id, doc_id, c1, c2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for b in batches:
            # a doc_id may have rows with other texts
            found = _word_hash([" ".join(z.decompress(t.as_py()).decode("utf-8", "surrogatepass").split()) for t in b.column(3)])
            own = (found[:, 0] == b.column(1).to_numpy()) & (found[:, 1] == b.column(2).to_numpy()) if len(b) else np.zeros(0, bool)
            kept = b.filter(pa.array(own))
            yield pa.record_batch([kept.column(0), kept.column(3)], ["id", "text"])

    joined = _util.packed(docs.select("doc_id", "text")).join(wanted, "doc_id").select("id", "c1", "c2", "text")
    return joined.mapInArrow(run, "id long, text binary").dropDuplicates(["id"])


def _grouped(docs: DataFrame, threshold: float) -> DataFrame:
    """What near_duplicates() returns, with h, the hash of the row's text."""
    _util.small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    signed = _util.materialize(_signed(docs).withColumn("rid", F.monotonically_increasing_id()))
    first = [F.first(c).alias(c) for c in ("weight", "bands", "sketch", "level")]
    classes = signed.where("weight > 0 AND id IS NOT NULL").groupBy("c1", "c2").agg(F.min(F.struct("id", "rid")).alias("first"), *first)
    # classes have ids of their own, as a doc_id may have rows with different texts
    classes = classes.select(F.monotonically_increasing_id().alias("id"), "c1", "c2", "first", "weight", F.expr("transform(bands, (b, k) -> xxhash64(k, b))").alias("buckets"), "sketch", "level")
    classes, seen = _util.materialize_seen(classes, F.count("*").alias("n"))
    met = _util.materialize(_graph.shared_buckets(classes, seen["n"] * BANDS))
    wanted = met.select("id").distinct().join(classes, "id").select("id", F.col("first.id").alias("doc_id"), "c1", "c2")
    members = met.join(classes.select("id", "weight", "sketch", "level"), "id")
    texts = _util.materialize(_texts(docs, wanted))

    def verify(pairs: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            z = zstandard.ZstdDecompressor()
            last, mine = None, None
            for batch in batches:
                keep = []
                for a, s, t in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True):
                    if mine is None or a != last:
                        last, mine = a, layers_of(z.decompress(s.as_py()).decode("utf-8", "surrogatepass"))
                    keep.append(similarity(mine, layers_of(z.decompress(t.as_py()).decode("utf-8", "surrogatepass"))) >= threshold)
                kept = batch.filter(pa.array(keep, pa.bool_()))
                yield pa.record_batch([kept.column(0), kept.column(1)], ["a", "b"])

        with_b = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("t")), "b")
        return with_b.join(texts.select(F.col("id").alias("a"), F.col("text").alias("s")), "a").select("a", "b", "s", "t").mapInArrow(run, "a long, b long")

    cell = f"floor(ln(weight) / {-math.log(threshold - 1e-4)!r}D)"
    of = _graph.linked(members, classes.select("id", "buckets"), lambda y: may_reach(threshold, y), cell, verify)
    groups = classes.select("id", "c1", "c2", "first").join(of, "id", "left").withColumn("component", F.coalesce("component", "id"))
    heads = groups.groupBy("component").agg(F.min("first").alias("head"))
    named = groups.join(heads, "component").select("c1", "c2", F.col("first.id").alias("class_id"), F.col("head.id").alias("component_id"), F.col("head.rid").alias("_rid"))
    out = signed.select("id", "h", "rid", "c1", "c2", "weight").join(named, ["c1", "c2"], "left")
    alone = "weight = 0 OR id IS NULL"
    return out.selectExpr("id AS doc_id", "h", *[f"CASE WHEN {alone} THEN id ELSE {c} END AS {c}" for c in ("class_id", "component_id")], f"{alone} OR rid = _rid AS kept")


def near_duplicates(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id, component_id, kept: one row for each row of docs(doc_id, text, ...).

    class_id: the smallest doc_id of the same words in the same order; component_id: the smallest doc_id reachable by links, and
    kept is whether that is the row itself; where rows repeat a doc_id, one of a group is kept. Documents are linked if the multisets of their five-word shingles have a
    Jaccard similarity of at least the threshold. Texts without a word, null ones too, are linked with nothing; so are rows
    without doc_id. Copies are one class, whatever their number, and never paired.
    """
    return _grouped(docs, threshold).drop("h")


def keep_one(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """docs with one row of each group of near_duplicates(). Rows that repeat a doc_id and its text are one row; rows of one doc_id with different texts each have their own fate."""
    docs = _util.one_each(docs)
    gone = _grouped(docs, threshold).where("NOT kept").select("doc_id", "h").distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", F.xxhash64("text").alias("h"))
    return rows.join(gone, ["doc_id", "h"], "left_anti").select("row.*")


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups of near copies among all documents."""
    return near_duplicates(_util.table(spark, sf_dir, "documents"))


#: All pairs that share a shingle, by their exact similarity.
OP6_SQL = f"""
WITH RECURSIVE t AS (SELECT doc_id, [w for w in regexp_split_to_array(coalesce(text, ''), '\\s+') if w <> ''] AS ws FROM documents),
sh AS (SELECT doc_id, array_to_string(ws[i:i + {SHINGLE - 1}], ' ') AS s, count(*) AS c FROM t, LATERAL (SELECT unnest(range(1, greatest(len(ws) - {SHINGLE - 2}, 2))) AS i) WHERE len(ws) > 0 GROUP BY ALL),
size AS (SELECT doc_id, sum(c) AS n FROM sh GROUP BY 1),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.c, b.c)) AS m FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
edge AS (SELECT a, b FROM common JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE m >= {SIMILARITY} * (x.n + y.n - m)),
two AS (SELECT a, b FROM edge UNION ALL SELECT b, a FROM edge),
reach(id, to_id) AS (SELECT doc_id, doc_id FROM t UNION SELECT id, b FROM reach JOIN two ON a = to_id),
comp AS (SELECT id, min(to_id) AS component_id FROM reach GROUP BY id),
cls AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY ws) END AS class_id FROM t)
SELECT doc_id, class_id, component_id, doc_id = component_id AS kept FROM cls JOIN comp ON id = doc_id
"""
