"""Fact tables of a Rust tree: files are read by Spark, parsed on executors file by file, and answered about with DataFrame plans.

A tree's facts are written once by content hash; scanning it again parses only files whose content is new.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import rust
from .tables import materialize

#: Written into each facts table; facts of another version are parsed anew.
SCHEME = 1
_S, _I, _B = T.StringType(), T.IntegerType(), T.BooleanType()
_L = T.ArrayType(_S)
_FIELD = T.ArrayType(T.StructType([T.StructField("name", _S), T.StructField("type", _S), T.StructField("vis", _S), T.StructField("line", _I)]))


def _table(**columns) -> T.StructType:
    return T.StructType([T.StructField("file", _S), *[T.StructField(k, v) for k, v in columns.items()]])


TABLES: dict[str, T.StructType] = {
    "defns": _table(kind=_S, name=_S, qpath=_S, line=_I, doc_start=_I, end=_I, doc=_S, depth=_I, vis=_S, module=_S, owner=_S, trait_name=_S, allow_dead=_B, is_test=_B, attrs=_L, sig=_S, params=_L, ret=_S, fields=_FIELD, variants=_L),
    "bodies": _table(name=_S, qpath=_S, line=_I, end=_I, tokens=_I, skeleton=_S, leaves=_L, in_trait_impl=_B, cyclo=_I, nesting=_I, params=_I, statements=_I, forwards=_S, idents=_L),
    "call_sites": _table(line=_I, caller=_S, target=_S, shadowed=_B, receiver_is_self=_B, as_value=_B),
    "dispatch_sites": _table(enum=_S, line=_I, context=_S, variants=_L, wildcard=_B),
    "literals": _table(line=_I, type=_S, context=_S, fields=T.MapType(_S, _S), computed=_L, has_rest=_B),
    "chains": _table(line=_I, root=_S, root_args=_S, methods=_L, context=_S),
    "arith_sites": _table(line=_I, scope=_S, op=_S, checked=_B, spelling=_S),
    "sites": _table(family=_S, kind=_S, line=_I, in_fn=_S, detail=_S),
    "casts": _table(line=_I, in_fn=_S, src=_S, dst=_S, cls=_S),
    "field_refs": _table(line=_I, in_fn=_S, field=_S, receiver=_S, kind=_S, via=_S, type=_S),
    "type_refs": _table(line=_I, in_fn=_S, type=_S, role=_S),
    "uses": _table(line=_I, alias=_S, path=_S, glob=_B),
    "waivers": _table(comment_line=_I, lo=_I, hi=_I, check=_S, key=_S, date=_S, reason=_S, trailing=_B),
    "bad": _table(reason=_S),
}


def read_files(spark: SparkSession, root: str, scope: str = "production", exclude: list[str] | None = None) -> DataFrame:
    """file, module, content, sha, reason of each `.rs` file below root; the scope ('production', 'tests' or 'all') is decided from paths before any file is opened by the parser."""
    base = root.rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.rs").load(base)
    # Spark gives full URIs; what follows the root is the file's name
    cut = F.regexp_replace("path", f"^.*?{base.split('://')[-1]}/", "")
    reason, module = F.udf(rust.scope_reason, "string"), F.udf(rust.module_of, "string")
    named = raw.withColumn("file", cut)
    for pattern in exclude or []:
        named = named.where(~F.col("file").rlike("^" + pattern.replace(".", r"\.").replace("**", "\0").replace("*", "[^/]*").replace("\0", ".*") + "$"))
    named = named.withColumn("reason", reason("file"))
    named = named.where({"production": "reason IS NULL", "tests": "reason IS NOT NULL", "all": "true"}[scope])
    return named.select("file", module("file").alias("module"), F.decode("content", "UTF-8").alias("content"), F.sha2(F.col("content"), 256).alias("sha"), "reason")


def parse(files: DataFrame) -> DataFrame:
    """sha, table, row (JSON), of each file's facts; a file is parsed whole by one call."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for file, content, sha in zip(b["file"], b["content"], b["sha"], strict=True):
                made = rust.facts(file, content or "")
                out += [(file, sha, "parsed", "{}")] + [(file, sha, t, json.dumps(r)) for t, rows in made.items() for r in rows]
            yield pd.DataFrame(out, columns=["file", "sha", "table", "row"])

    return files.select("file", "content", "sha").mapInPandas(run, "file string, sha string, table string, row string")


class Facts:
    """The fact tables of one scan."""

    def __init__(self, files: DataFrame, stored: DataFrame | None = None):
        """stored: facts of an earlier scan (see rows); files with the same path and content are not parsed again."""
        self.files = materialize(files)
        self.spark = files.sparkSession
        todo = self.files
        if stored is not None:
            hits = stored.where(F.col("scheme") == SCHEME).join(self.files.select("file", "sha"), ["file", "sha"], "left_semi")
            todo = self.files.join(hits.where("table = 'parsed'").select("file", "sha"), ["file", "sha"], "left_anti")
        fresh = parse(todo).withColumn("scheme", F.lit(SCHEME))
        self.rows = materialize(fresh if stored is None else fresh.unionByName(hits))
        self._tables: dict[str, DataFrame] = {}

    @classmethod
    def scan(cls, spark: SparkSession, root: str, scope: str = "production", stored: DataFrame | None = None, exclude: list[str] | None = None) -> Facts:
        return cls(read_files(spark, root, scope, exclude), stored)

    @classmethod
    def of(cls, spark: SparkSession, sources: dict[str, str]) -> Facts:
        """Facts of sources given as text by path."""
        df = spark.createDataFrame([(k, rust.module_of(k), v, rust.scope_reason(k)) for k, v in sources.items()], "file string, module string, content string, reason string")
        return cls(df.select("file", "module", "content", F.sha2("content", 256).alias("sha"), "reason"))

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        if name not in self._tables:
            rows = self.rows.where(F.col("table") == name).select(F.from_json("row", TABLES[name]).alias("r")).select("r.*")
            self._tables[name] = rows
        return self._tables[name]

    @property
    def lines(self) -> DataFrame:
        return self.files.select("file", F.posexplode(F.split("content", "\n")).alias("line", "text")).withColumn("line", F.col("line") + 1)
