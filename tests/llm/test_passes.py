"""Blocks dealt in passes, classes by halves."""

import pyarrow as pa
from pyspark.sql import functions as F

from lodestone.llm import _graph, _util, lines


def _rows(batches):
    for b in batches:
        yield pa.record_batch([b.column("id"), b.column("role")], ["a", "b"])


def test_blocks_of_a_large_bucket_are_not_on_disk_at_once(spark, monkeypatch):
    """200 rows, all outsiders, in 20 by 20 blocks: 8000 rows dealt, some 400 at a time."""
    for name, value in (("BLOCK", 10), ("ROWS", 1), ("TIMES", 2)):
        monkeypatch.setattr(_graph, name, value)
    written, old = [], _util.materialize

    def counted(df, parts=None):
        out = old(df, parts)
        if out.columns == ["a", "b"]:
            written.append(out.count())
        return out

    monkeypatch.setattr(_util, "materialize", counted)
    ids = spark.range(200)
    rest = ids.select(F.lit(1).cast("long").alias("bucket"), "id", F.col("id").alias("component"), F.lit(True).alias("out"))
    found = _graph.in_blocks(rest, ids.select("id", F.array(F.lit(1).cast("long")).alias("buckets")), "a long, b long", _rows)
    assert 7000 < found.count() == sum(written) < 9000 and len(written) > 15
    assert max(written) < 1000


def test_lines_are_grouped_alike_in_passes(spark, monkeypatch):
    passage = " ".join(f"{k * 7919:x}qz" for k in range(18))
    texts = [f"{' '.join(f'{k * 104729 + n:x}' for n in range(k % 5))} {passage}" for k in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted(map(tuple, lines.fuzzy_lines(df).collect()))
    for name, value in (("BLOCK", 8), ("ROWS", 1), ("TIMES", 4), ("PAIRS", 8), ("LEADERS", 1)):
        monkeypatch.setattr(_graph, name, value)
    assert sorted(map(tuple, lines.fuzzy_lines(df).collect())) == want and 1 < len({w[3] for w in want}) < 60
