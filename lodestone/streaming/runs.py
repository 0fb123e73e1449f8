"""Stateful behaviours as Structured Streaming queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sets


def acknowledged_once(messages: DataFrame, key: str, at: str, hold: str = "1 hour") -> DataFrame:
    """Messages whose key was not seen in the last `hold`; a repeat does not prolong it. State older than the watermark is dropped."""
    return messages.withWatermark(at, hold).dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, at: str, by: str, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Counts by time window and key; events later than `late` are left out."""
    return events.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")


def compare_runs(findings: DataFrame, base_path: str, out_path: str, checkpoint: str) -> object:
    """Each batch of findings against the stored base: new, gone and unchanged by fingerprint, appended to out_path."""

    def each(batch: DataFrame, number: int) -> None:
        base = batch.sparkSession.read.parquet(base_path)
        sets.multiset_diff(batch, base, ["check", "fp"]).withColumn("batch", F.lit(number)).write.mode("append").parquet(out_path)

    return findings.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a streaming query over what there is now, and read its table."""
    stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def incremental(spark: SparkSession, folder: str, parse: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> DataFrame:
    """New source files of a folder, parsed as they come, appended to a facts table."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.rs").load(folder)
    files = raw.select(F.regexp_extract("path", "([^/]+)$", 1).alias("file"), F.decode("content", "UTF-8").alias("content"), F.sha2(F.col("content"), 256).alias("sha"))
    return run_once(parse(files), out, checkpoint)
