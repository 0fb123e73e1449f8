"""Sinks: tab-separated rows, JSON sections, snippets, baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASELINE_VERSION = 1


def rendered(df: DataFrame) -> DataFrame:
    """One text column `value`: floats with two decimals, lists joined by commas, nulls empty, cells by tabs in the order of df."""
    cells = []
    for f in df.schema.fields:
        c, kind = F.col(f"`{f.name}`"), f.dataType.simpleString()
        cells.append(F.format_string("%.2f", c) if kind in ("double", "float") else F.array_join(c, ",") if kind.startswith("array<string") else c.cast("string"))
    return df.select(F.concat_ws("\t", *[F.coalesce(c, F.lit("")) for c in cells]).alias("value"))


def write_tsv(df: DataFrame, path: str) -> None:
    rendered(df).write.text(path)


def json_rows(df: DataFrame, check: str) -> DataFrame:
    """check, json: each row with all its cells named."""
    return df.select(F.lit(check).alias("check"), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))


def snippets(findings: DataFrame, lines: DataFrame, around: int = 2) -> DataFrame:
    """findings(file, line) with the lines around them: an equi-join on file and line, as a finding names the few lines it needs."""
    near = findings.select("file", F.col("line").alias("finding"), F.explode(F.sequence(F.col("line") - around, F.col("line") + around)).alias("line")).distinct()
    return near.join(lines, ["file", "line"]).select("file", "finding", "line", "text")


def write_baseline(findings: DataFrame, path: str) -> None:
    findings.select("check", "fp", "label", "site", "score").withColumn("version", F.lit(BASELINE_VERSION)).write.parquet(path)


def read_baseline(spark, path: str) -> DataFrame:
    """A stored baseline; one of another version is an error."""
    df = spark.read.parquet(path)
    other = df.where(F.col("version") != BASELINE_VERSION).limit(1).collect()
    if other:
        raise ValueError(f"the baseline has version {other[0]['version']}, not {BASELINE_VERSION}")
    return df.drop("version")


def site(file: Column, line: Column) -> Column:
    return F.concat_ws(":", file, line.cast("string"))
