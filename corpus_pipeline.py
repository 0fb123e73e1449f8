"""The corpus pipeline: documents in, token ids out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents. Empty tables pass through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import _util, codec, lines, minhash, mixing, quality


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: what the base conditions or the learned rules reject goes."""
    rules = quality.fit(docs, _util.table(spark, sf_dir, "labels"))
    rows = docs.select(F.struct(*docs.columns).alias("_row"), "text")
    return quality.judge(rows, rules, "_row").where("kept").select("_row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: of each fuzzy group of lines the first stays; documents with no other line go."""
    return lines.dedup_lines(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: of each group of near copies the document with the smallest doc_id stays."""
    return minhash.keep_one(docs).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents in the target weights; one row for each epoch that takes a document."""
    plan = mixing.plan(_util.materialize(mixing.sizes(docs)))
    rows = docs.select("doc_id", F.struct(*docs.columns).alias("_row"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).withColumn("domain", F.expr(mixing.DOMAIN))
    return mixing.select(rows, plan).select("_row.*")


def bpe_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: doc_id, n_tokens, ids, and the digest of the text that the ids decode to."""
    return codec.encode(docs, _util.tokenizer_path(codec.DEFAULT), decoded=True)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", minhash_dedup),
    ("mixing sources", mix_sources),
    ("BPE encoding", bpe_encode),
]

#: SQL can't express the learned rules, the fuzzy groups or the merges; tests/llm/test_pipeline.py has brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = _util.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = _util.materialize(docs)
            _util.discard(before)
    return docs
