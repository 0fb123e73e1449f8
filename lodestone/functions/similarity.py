"""Name similarity. Spark has no edit distance with transpositions, so that one is an Arrow-batched pandas UDF; the rest is column arithmetic."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType


def osa(a: str, b: str) -> int:
    """Optimal string alignment: edits and swaps of neighbours, no substring edited twice."""
    two, one = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(one[j] + 1, row[j - 1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, two[j - 2] + 1)
            row.append(d)
        two, one = one, row
    return one[-1]


@F.pandas_udf(IntegerType())
def osa_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else osa(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")


def name_similarity(name: Column, query: Column) -> Column:
    """From 0 to 1: edit similarity, more for a shared beginning, and at least a half for containment."""
    longer, shorter = F.greatest(F.length(name), F.length(query)).cast("double"), F.least(F.length(name), F.length(query)).cast("double")
    sim = 1.0 - osa_distance(name, query) / longer
    prefix = sum((F.when(F.substring(name, 1, k) == F.substring(query, 1, k), 1).otherwise(0) * F.when(F.least(F.length(name), F.length(query)) >= k, 1).otherwise(0) for k in range(1, 5)), F.lit(0))
    near = sim + 0.1 * prefix * (1.0 - sim)
    return F.when(name.contains(query) | query.contains(name), F.greatest(near, 0.5 + 0.5 * shorter / longer)).otherwise(near)
