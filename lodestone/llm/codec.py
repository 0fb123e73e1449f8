"""Operator 5: BPE encoding and decoding of whole texts (see bpe.py for the method)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import _util
from .bpe import digest, load

DEFAULT = "byte_bpe_50k.json"


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """id_col, n_tokens long, ids array<int>: the ids of each whole text; with `decoded` also decoded_sha256, the digest of the text decoded from them.

    One row for each row of df, repeated rows too. A null text counts as empty and has no ids. Special strings inside a
    text become their own id, as the tokenizers library has it by default. Other columns of df are not carried.
    """
    _util.small_batches(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in _util.slices(batches, 64):
            ids, sums = [], []
            for t in b.column(1):
                ids.append(np.array(bpe.encode(t.as_py() or ""), np.int32))
                if decoded:
                    sums.append(digest(bpe.decode(ids[-1].tolist())))
            many = np.array([len(i) for i in ids], np.int64)
            of = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(many)].astype(np.int32)), pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))
            columns, names = [b.column(0), pa.array(many), of], ["id", "n_tokens", "ids"]
            yield pa.record_batch(columns + [pa.array(sums, pa.string())], [*names, "decoded_sha256"]) if decoded else pa.record_batch(columns, names)

    return _util.only(df, id_col, text_col).mapInArrow(run, f"id {kind}, n_tokens long, ids array<int>" + ", decoded_sha256 string" * decoded).withColumnRenamed("id", id_col)


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id_col, text: the text that ids stand for. Null or no ids give an empty text; bytes that are no UTF-8 become U+FFFD."""
    _util.small_batches(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([bpe.decode(i or []) for i in b.column(1).to_pylist()], pa.string())], ["id", "text"])

    return _util.only(df, id_col, ids_col).mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def round_trip(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_tokens, ids_sha256, decoded_sha256: digests of the ids and of the text decoded from them, without moving either.

    Rows, nulls and special strings as in encode().
    """
    _util.small_batches(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in batches:
            n, of_ids, of_text = [], [], []
            for t in b.column(1):
                ids = bpe.encode(t.as_py() or "")
                n.append(len(ids))
                of_ids.append(digest(",".join(map(bpe.names.__getitem__, ids))))
                of_text.append(digest(bpe.decode(ids)))
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _util.only(df, id_col, text_col).mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents, encoded and decoded."""
    return round_trip(_util.table(spark, sf_dir, "documents"), _util.tokenizer_path(DEFAULT))
