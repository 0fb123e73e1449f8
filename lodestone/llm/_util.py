"""Shared helpers: reading tables, bounded Arrow batches, tables that cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch handed to Python; a batch of the longest texts stays within some tens of MB.
BATCH_ROWS = 512


def tokenizer_path(name: str, home: str | None = None) -> str:
    """Place of a public tokenizer file: in the folder `home`, or where the package that holds them says."""
    return f"{home}/{name}" if home else public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound what one Arrow batch holds, for stages that hand whole texts to Python."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session, or where it is unset, a temporary one. A cluster must set it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, parts: int | None = None) -> DataFrame:
    """Write a table into the shared folder and read it back: its lineage ends there, and a lost executor costs a file read, not a recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestone-{uuid.uuid4().hex}"
    (df.coalesce(parts) if parts else df).write.parquet(path)
    release(spark)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that are done with: it does so where the driver finds them to be garbage, for which it would have to be short of memory."""
    spark._jvm.System.gc()


def materialize_seen(df: DataFrame, *what: Column) -> tuple[DataFrame, dict]:
    """materialize(), and aggregates of the rows, taken while they are written."""
    seen = Observation()
    return materialize(df.observe(seen, *what)), seen.get


def discard(df: DataFrame) -> None:
    """Delete the folder behind a table that materialize() made and nothing reads any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        folder = file.rsplit("/", 1)[0]
        if "/lodestone-" in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns and no others, so that extra columns can't clash with an operator's own."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def one_each(docs: DataFrame) -> DataFrame:
    """docs with rows that repeat a doc_id and its text taken as one row, any of them. Rows without doc_id stay."""
    again = docs.where("doc_id IS NOT NULL").groupBy("doc_id", F.xxhash64("text")).count().where("count > 1")
    if again.isEmpty():
        return docs
    return materialize(docs.where("doc_id IS NULL").unionByName(docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id", "text"])))


def packed(texts: DataFrame) -> DataFrame:
    """doc_id, text compressed, for the way to the documents it is compared with."""
    kind = texts.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([z.compress((t.as_py() or "").encode("utf-8", "surrogatepass")) for t in b.column(1)], pa.binary())], ["doc_id", "text"])

    return texts.mapInArrow(run, f"doc_id {kind}, text binary")


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches in parts of so many rows."""
    for b in batches:
        for k in range(0, len(b), rows):
            yield b.slice(k, rows)
