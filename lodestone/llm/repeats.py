"""Operator 10: removal of repeated strings by prefix-free parsing.

Texts are bytes. Triggers of a rolling hash cut each text into phrases: a position is a trigger where the hash of its 32 bytes is the
least (the leftmost of equals) of a 100-byte string, so every 100-byte string has one trigger, at a place that its own bytes decide. The
phrase of a trigger is the run of 100-byte strings that have it. Equal phrases form the dictionary. A phrase that is not the first
of its kind in corpus order repeats an earlier one in all its 100-byte strings. Where one trigger string has several kinds of
phrase with the same bytes on one side of it, which may share some strings, the dictionary's suffixes are brought together: the 100-byte suffixes of the first
phrase of each kind, grouped by hash, give the order at depth 100 of which each but the first in the corpus is a repeat. So long
as equal strings need only be told apart from others, their groups serve for the suffix array's order at that depth.

Strings are compared by 128 bits of hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import _util
from ._hash import mix

LENGTH, GRAM = 100, 32
#: A 100-byte string that holds a trigger has at least so many bytes of it on one side.
SIDE = (LENGTH - GRAM) // 2
#: Bytes hashed at a time.
CHUNK = 1 << 20
_SPAN = LENGTH - GRAM + 1
_BASE = 0x9E6C63D0876A9A47
_TABLE = mix(np.arange(1, 257, dtype=np.uint64))


class _Powers:
    """Powers of the base and of its inverse modulo 2^64, as many as asked for so far."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, CHUNK + 200_000)
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                steps = np.full(size, np.uint64(base))
                steps[0] = 1
                setattr(cls, name, np.multiply.accumulate(steps))
        return cls.up, cls.down


class Hashed:
    """Hashes of any substring of some bytes, by sums of powers."""

    def __init__(self, data: np.ndarray):
        up, self.down = _Powers.of(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_TABLE[data] * up[: len(data)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])


def phrases(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of texts that lie end to end: first and last start of the strings of each phrase, hash of its trigger, hash of the phrase, and 16 bits each of hashes of the trigger with SIDE bytes to its left and to its right."""
    n = len(data)
    none = np.zeros(0, np.int64)
    nothing = none, none, none.view(np.uint64), none.view(np.uint64), none.astype(np.int32)
    if n < LENGTH:
        return nothing
    h = Hashed(data)
    g = mix((h.sums[GRAM:] - h.sums[:-GRAM]) * h.down[: n - GRAM + 1])
    v, a, span = g, np.arange(len(g), dtype=np.int32), 1
    while span < _SPAN:
        step = min(span, _SPAN - span)
        right = v[step:] < v[:-step]
        v, a, span = np.where(right, v[step:], v[:-step]), np.where(right, a[step:], a[:-step]), span + step
    text = np.repeat(np.arange(len(bounds) - 1, dtype=np.int32), np.diff(bounds))
    at = np.flatnonzero(text[: n - LENGTH + 1] == text[LENGTH - 1 :])
    if not len(at):
        return nothing
    trigger = a[at]
    new = np.flatnonzero(np.r_[True, trigger[1:] != trigger[:-1]])
    first, last, trigger = at[new], at[np.r_[new[1:], len(at)] - 1], trigger[new]
    shape = ((trigger - first) << 8 | (last - first)).astype(np.uint64)
    of = text[trigger]
    left = h(np.maximum(bounds[of], trigger - SIDE), trigger + GRAM) & np.uint64(0xFFFF)
    right = h(trigger, np.minimum(bounds[of + 1], trigger + GRAM + SIDE)) & np.uint64(0xFFFF)
    return first, last, g[trigger], mix(h(first, last + LENGTH) ^ mix(shape)), (left << np.uint64(16) | right).astype(np.uint32).view(np.int32)


def repeated_within(which: np.ndarray, first: np.ndarray, last: np.ndarray, trigger: np.ndarray, phrase: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether each phrase repeats an earlier one of its own text, and first and last place of the runs of such phrases."""
    key = mix(mix(trigger ^ mix(phrase)) + which.astype(np.uint64))
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(key), bool)
    again[order[1:]] = key[order[1:]] == key[order[:-1]]
    at = np.flatnonzero(again)
    new = np.r_[True, (at[1:] != at[:-1] + 1) | (which[at[1:]] != which[at[:-1]]) | (first[at[1:]] != last[at[:-1]] + 1)] if len(at) else np.zeros(0, bool)
    return again, at[new], at[np.r_[np.flatnonzero(new)[1:], len(at)] - 1] if len(at) else at


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _parsed(docs: DataFrame) -> DataFrame:
    """trigger, phrase, doc, sub, first, last, sides, settled: the parse of every text."""
    kind = docs.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(ids, subs, parts, like) -> pa.RecordBatch:
            bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            first, last, trigger, phrase, sides = phrases(np.frombuffer(b"".join(parts), np.uint8), bounds)
            which = np.searchsorted(bounds, first, side="right") - 1
            first, last = first - bounds[which], last - bounds[which]
            again, begin, end = repeated_within(which, first, last, trigger, phrase)
            # runs that repeat their own text are settled; they get keys of their own, so that no trigger gathers them
            own = mix(mix(np.arange(len(begin), dtype=np.uint64) + trigger[begin]) ^ mix(phrase[begin]))
            zero = np.zeros(len(begin), np.int64)
            new = ~again
            which = np.concatenate([which[new], which[begin]])
            return pa.record_batch(
                [
                    pa.array(np.concatenate([trigger[new], own]).view(np.int64)),
                    pa.array(np.concatenate([phrase[new].view(np.int64), zero])),
                    pa.array(ids, like).take(pa.array(which)),
                    pa.array(np.array(subs, np.int32)[which]),
                    pa.array(np.concatenate([first[new], first[begin]]).astype(np.int32)),
                    pa.array(np.concatenate([last[new], last[end]]).astype(np.int32)),
                    pa.array(np.concatenate([sides[new], zero.astype(np.int32)])),
                    pa.array(np.concatenate([np.zeros(new.sum(), bool), zero == 0])),
                ],
                ["trigger", "phrase", "doc", "sub", "first", "last", "sides", "settled"],
            )

        ids, subs, parts, size = [], [], [], 0
        for b in batches:
            like = b.schema.field(0).type
            for i, s, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                data = _bytes(t.as_py())
                if len(data) >= LENGTH:
                    ids.append(i)
                    subs.append(s)
                    parts.append(data)
                    size += len(data)
                if size >= CHUNK:
                    yield made(ids, subs, parts, like)
                    ids, subs, parts, size = [], [], [], 0
        if parts:
            yield made(ids, subs, parts, like)

    return docs.mapInArrow(run, f"trigger long, phrase long, doc {kind}, sub int, first int, last int, sides int, settled boolean")


def _packed(docs: DataFrame) -> DataFrame:
    """doc, sub, text: texts compressed, for the way to other rows of their document."""
    kind = docs.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        for b in batches:
            yield pa.record_batch([b.column(0), b.column(1), pa.array([z.compress(_bytes(t.as_py())) for t in b.column(2)], pa.binary())], ["doc", "sub", "text"])

    return docs.mapInArrow(run, f"doc {kind}, sub int, text binary")


def _suffixes(open_phrases: DataFrame, packed: DataFrame) -> DataFrame:
    """trigger, hash, doc, sub, at: the 100-byte suffixes of phrases(trigger, doc, sub, first, last)."""
    kind = packed.schema["doc"].dataType.simpleString()
    by_doc = open_phrases.groupBy("doc", "sub").agg(F.collect_list("trigger").alias("triggers"), F.collect_list("first").alias("firsts"), F.collect_list("last").alias("lasts"))
    with_text = by_doc.alias("p").join(packed.alias("t"), F.expr("p.doc <=> t.doc AND p.sub = t.sub")).select("p.doc", "p.sub", "triggers", "firsts", "lasts", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for b in batches:
            for k in range(len(b)):
                h = Hashed(np.frombuffer(z.decompress(b.column(5)[k].as_py()), np.uint8))
                trigger, first, last = (b.column(c)[k].values.to_numpy() for c in (2, 3, 4))
                many = last - first + 1
                at = np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())
                same = pa.array(np.zeros(len(at), np.int64))
                yield pa.record_batch([pa.array(np.repeat(trigger, many)), pa.array(h(at, at + LENGTH).view(np.int64)), b.column(0).slice(k, 1).take(same), b.column(1).slice(k, 1).take(same), pa.array(at.astype(np.int32))], ["trigger", "hash", "doc", "sub", "at"])

    return with_text.mapInArrow(run, f"trigger long, hash long, doc {kind}, sub int, at int")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary): of each text the bytes that no earlier 100-byte string covers.

    One row for each row of docs(doc_id, text, ...). A null text counts as empty; a null doc_id comes before all others, and rows
    of one doc_id follow each other by their text, so that of repeated rows all but one are repeats. Matches do not cross texts.
    Texts shorter than 100 bytes stay whole.
    """
    spark = docs.sparkSession
    _util.small_batches(spark)
    docs = docs.select(F.col("doc_id").alias("doc"), "text")
    if docs.groupBy("doc").count().where("count > 1").isEmpty():
        docs = docs.select("doc", F.lit(0).alias("sub"), "text")
    else:
        docs = docs.select("doc", (F.row_number().over(W.partitionBy("doc").orderBy("text")) - 1).alias("sub"), "text")
    kind = docs.schema["doc"].dataType.simpleString()
    order = [F.col("doc").asc_nulls_first(), F.col("sub"), F.col("first")]
    # one exchange by trigger serves all windows
    parsed = _parsed(docs).repartition("trigger")
    left, right = F.shiftright("sides", 16), F.col("sides").bitwiseAND(F.lit(0xFFFF))

    def several(side: Column) -> Column:
        w = W.partitionBy("trigger", side)
        return F.min("phrase").over(w) != F.max("phrase").over(w)

    # two kinds of phrase that share a string share one side of the trigger
    seen = parsed.withColumn("rank", F.row_number().over(W.partitionBy("trigger", "phrase").orderBy(*order))).withColumn("l", left).withColumn("r", right)
    seen = seen.withColumn("several", several(F.col("l")) | several(F.col("r"))).where("settled OR rank > 1 OR several")
    seen = _util.materialize(seen.select("trigger", "doc", "sub", "first", "last", F.expr("settled OR rank > 1").alias("again")))
    packed = _packed(docs)
    suffixes = _suffixes(seen.where("NOT again"), packed)
    later = suffixes.withColumn("rank", F.row_number().over(W.partitionBy("hash", "trigger").orderBy(F.col("doc").asc_nulls_first(), "sub", "at"))).where("rank > 1")
    spans = seen.where("again").select("doc", "sub", F.col("first").alias("start"), (F.col("last") + LENGTH).alias("end")).unionByName(later.select("doc", "sub", F.col("at").alias("start"), (F.col("at") + LENGTH).alias("end")))
    by_doc = spans.groupBy("doc", "sub").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for b in batches:
            out = []
            for k in range(len(b)):
                data = z.decompress(b.column(1)[k].as_py())
                n, removed, runs = len(data), 0, 0
                if b.column(2)[k].is_valid:
                    step = np.zeros(n + 1, np.int64)
                    np.add.at(step, b.column(2)[k].values.to_numpy(), 1)
                    np.add.at(step, b.column(3)[k].values.to_numpy(), -1)
                    gone = np.cumsum(step[:n]) > 0
                    removed, runs = int(gone.sum()), int(np.count_nonzero(gone & ~np.r_[False, gone[:-1]]))
                    data = np.frombuffer(data, np.uint8)[~gone].tobytes()
                out.append((n, removed, runs, data))
            n, removed, runs, data = zip(*out, strict=True) if out else ([],) * 4
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(data, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    joined = packed.alias("t").join(by_doc.alias("s"), F.expr("t.doc <=> s.doc AND t.sub = s.sub"), "left").select("t.doc", "text", "starts", "ends")
    return joined.mapInArrow(cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repeated bytes of all documents."""
    out = remove_repeats(_util.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
