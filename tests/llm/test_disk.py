"""What line dedup leaves on disk."""

import time
from pathlib import Path

from lodestone.llm import _util, lines


def _files(spark) -> int:
    return spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()


def test_shuffle_files_go_when_a_table_is_written(spark):
    _util.release(spark)
    time.sleep(2)
    before = _files(spark)
    _util.materialize(spark.range(1000).repartition(7, "id"))
    one = _files(spark) - before
    for _ in range(4):
        _util.materialize(spark.range(1000).repartition(7, "id"))
    for _ in range(50):
        if _files(spark) <= before + one:
            break
        time.sleep(0.1)
    # the last plan's may be in use yet
    assert 0 < one and _files(spark) <= before + one


def test_tables_that_the_result_does_not_read_go(spark):
    folder = Path(_util.shared_dir(spark).removeprefix("file://").removeprefix("file:"))
    before = set(folder.glob("lodestone-*"))
    rows = [(k, f"some line of {k % 5} words that is there again and once more\nanother {k * 7919} {k * 104729} one") for k in range(40)]
    got = lines.fuzzy_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    read = {f.rsplit("/", 2)[1] for f in got.inputFiles()}
    columns = {c for p in set(folder.glob("lodestone-*")) - before if p.name in read for c in spark.read.parquet(str(p)).columns}
    assert not columns & {"buckets", "line"} and got.count() == 80
    left = [spark.read.parquet(str(p)).columns for p in set(folder.glob("lodestone-*")) - before if any(p.glob("*.parquet"))]
    assert not any({"buckets", "line"} & set(c) for c in left)
