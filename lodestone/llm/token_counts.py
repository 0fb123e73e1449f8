"""Operator 1: token counts from distinct pre-tokens.

The texts are read once, in blocks of a bounded size. A block sends each of its distinct pre-tokens once, with the
frequencies in its documents packed beside it. Where equal pre-tokens of all blocks meet, sorted, their pieces are counted
once, and each frequency is multiplied by that number; the products go back to their block packed by document and are
summed there. Ids are never made. A pre-token has one row for each block at most, however common it is.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _util
from .bpe import SEGMENTS, ByteBPE, load

#: Characters and documents in a block.
BLOCK_CHARS, BLOCK_DOCS = 16_000_000, 60_000
#: Products that a task holds before it packs them.
HELD = 4_000_000
#: A document's place in its block and a frequency, or a sum.
_PAIR, _SUM = np.dtype([("doc", "<u2"), ("n", "<u2")]), np.dtype([("doc", "<u2"), ("n", "<u4")])
DEFAULT = "byte_bpe_50k.json"


def _packed(rows: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Slices of a structured array as binary values; starts has their bounds."""
    offsets = (starts * rows.dtype.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def _unpacked(column: pa.Array, dtype: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """The structured array of binary values, and how many records each has."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if column.buffers()[2] else np.zeros(0, np.uint8)
    return np.frombuffer(data.tobytes(), dtype), np.diff(offsets) // dtype.itemsize


class _Block:
    """The documents of one block: pre-tokens by number, and frequencies by document."""

    def __init__(self, number: int):
        self.number, self.ids, self.sizes, self.chars = number, [], [], 0
        self.words: dict[str, int] = {}
        self.chunks: dict[str, tuple[int, ...]] = {}
        self.docs, self.which, self.freq = [], [], []

    def _of_chunk(self, chunk: str) -> tuple[int, ...]:
        words = self.words
        found = self.chunks[chunk] = tuple(words.setdefault(w, len(words)) for w in SEGMENTS.findall(chunk))
        return found

    def add(self, key, text: str, bpe: ByteBPE) -> None:
        place = len(self.ids)
        self.ids.append(key)
        self.sizes.append(len(text.encode("utf-8", "surrogatepass")))
        self.chars += len(text)
        total: dict[int, int] = {}
        for k, part in enumerate(bpe.parts(text)):
            if k % 2:
                w = self.words.setdefault(part, len(self.words))
                total[w] = total.get(w, 0) + 1
                continue
            known = self.chunks.get
            for chunk, n in Counter(bpe.chunks(part)).items():
                for w in known(chunk) or self._of_chunk(chunk):
                    total[w] = total.get(w, 0) + n
        for w, n in list(total.items()):
            while n > 65_535:  # more than a record holds goes into several
                self._put(place, [w], [65_535])
                n -= 65_535
            total[w] = n
        self._put(place, list(total), list(total.values()))

    def _put(self, place: int, words: list[int], freq: list[int]) -> None:
        self.docs.append(np.full(len(words), place, np.uint16))
        self.which.append(np.array(words, np.int32))
        self.freq.append(np.array(freq, np.uint16))

    def rows(self, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        """One row for each pre-token; before them one that lists the documents."""
        which = np.concatenate(self.which)
        order = np.argsort(which, kind="stable")
        pairs = np.empty(len(which), _PAIR)
        pairs["doc"], pairs["n"] = np.concatenate(self.docs)[order], np.concatenate(self.freq)[order]
        n = len(self.words)
        starts = np.concatenate([[0], np.cumsum(np.bincount(which, minlength=n))])
        none = [None]
        yield pa.record_batch(
            [pa.array(none, pa.string()), pa.array([self.number], pa.int64()), pa.array(none, pa.binary()), pa.array([self.ids], pa.list_(kind)), pa.array([self.sizes], pa.list_(pa.int64()))],
            ["word", "block", "freq", "ids", "sizes"],
        )
        words = list(self.words)
        for a in range(0, n, 20_000):
            b = min(n, a + 20_000)
            yield pa.record_batch(
                [pa.array(words[a:b], pa.string()), pa.array(np.full(b - a, self.number, np.int64)), _packed(pairs[starts[a] : starts[b]], starts[a : b + 1] - starts[a]), pa.nulls(b - a, pa.list_(kind)), pa.nulls(b - a, pa.list_(pa.int64()))],
                ["word", "block", "freq", "ids", "sizes"],
            )


def token_counts(df: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_bytes long (UTF-8), n_tokens long, over_limit boolean (n_tokens > limit): one row for each row of df.

    A null text counts as empty: no bytes, no tokens. Rows with equal or null ids are counted one by one. Other columns of
    df are not carried. The blocks follow the order in which df is read, so df should be a scan or a written table.
    """
    spark = df.sparkSession
    _util.small_batches(spark)
    kind = df.schema[id_col].dataType.simpleString()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, task = load(path), TaskContext.get().partitionId() << 24
        block, of = None, pa.int64()
        for b in batches:
            of = b.schema.field(0).type
            for key, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                block = block or _Block(task)
                block.add(key, text.as_py() or "", bpe)
                if block.chars >= BLOCK_CHARS or len(block.ids) >= BLOCK_DOCS:
                    yield from block.rows(of)
                    task, block = task + 1, None
        if block:
            yield from block.rows(of)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        last, pieces, of = None, 0, None
        keys, sums, held = [], [], 0

        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal keys, sums, held
            if held:
                key, where = np.unique(np.concatenate(keys), return_inverse=True)
                total = np.bincount(where, np.concatenate(sums)).astype(np.int64)
                rows = np.empty(len(key), _SUM)
                rows["doc"], rows["n"] = key & 65_535, total
                block = key >> 16
                first = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
                k = len(first)
                yield pa.record_batch([pa.array(block[first]), _packed(rows, np.r_[first, len(key)]), pa.nulls(k, of), pa.nulls(k, pa.list_(pa.int64()))], ["block", "sums", "ids", "sizes"])
                keys, sums, held = [], [], 0

        for b in batches:
            listing = b.filter(pa.compute.is_null(b.column("word")))
            if len(listing):
                yield pa.record_batch([listing.column("block"), pa.nulls(len(listing), pa.binary()), listing.column("ids"), listing.column("sizes")], ["block", "sums", "ids", "sizes"])
                b = b.filter(pa.compute.is_valid(b.column("word")))
            of = b.column("ids").type
            n = []
            for w in b.column("word").to_pylist():
                if w != last:
                    last, pieces = w, bpe.count(w)
                n.append(pieces)
            if n:
                pairs, many = _unpacked(b.column("freq"), _PAIR)
                keys.append(np.repeat(b.column("block").to_numpy() << 16, many) | pairs["doc"])
                sums.append(np.repeat(np.array(n, np.int64), many) * pairs["n"])
                held += len(pairs)
            if held >= HELD:
                yield from packed()
        yield from packed()

    def summed(of_block: pa.Table) -> pa.Table:
        listing = of_block.filter(pa.compute.is_valid(of_block.column("ids"))).combine_chunks()
        ids, sizes = listing.column("ids").chunk(0).flatten(), listing.column("sizes").chunk(0).flatten()
        total = np.zeros(len(ids), np.int64)
        for chunk in of_block.filter(pa.compute.is_valid(of_block.column("sums"))).column("sums").chunks:
            rows, _ = _unpacked(chunk, _SUM)
            np.add.at(total, rows["doc"], rows["n"])
        return pa.table([ids, sizes, pa.array(total), pa.array(total > limit)], ["id", "n_bytes", "n_tokens", "over_limit"])

    sent = _util.only(df, id_col, text_col).mapInArrow(blocks, f"word string, block long, freq binary, ids array<{kind}>, sizes array<long>")
    # A block's listing of documents goes along with the words, to the task that its number names.
    met = sent.repartition(F.coalesce(F.xxhash64("word"), F.col("block"))).sortWithinPartitions("word")
    back = met.mapInArrow(products, f"block long, sums binary, ids array<{kind}>, sizes array<long>")
    return back.groupBy("block").applyInArrow(summed, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of every whole text of documents."""
    return token_counts(_util.table(spark, sf_dir, "documents"), _util.tokenizer_path(DEFAULT))
