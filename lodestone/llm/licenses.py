"""Operator 9: licence scans, all in DataFrame operations.

Each line of a file, and each licence file as a whole, is compared with licence templates by the cosine of sparse TF-IDF vectors; the
weights come from the templates, and a word that none of them has weighs most. Vectors and products are computed within a line's row. A file without a licence of its own
inherits that of the licence file in its nearest ancestor directory, found by joins on directory paths.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _util

#: Least cosine of a match.
THRESHOLD = 0.6
#: Names of licence files.
FILE_NAMES = "(?i)^(licen[cs]e|copying|copyright|notice)([.-].*)?$"
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT license."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
]
#: Words of any text, commonest first.
EVERYDAY = "the of and to in a that it is for with on be as are you from or by at this have has not can use all any may under out work it met law 0 2 3 4".split()


def words_of(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def _weights() -> tuple[dict[str, float], float, list[tuple[int, str, dict[str, float]]]]:
    """Weight of each template word, of any other word, and the unit vector of each template."""
    bags = [Counter(words_of(t)) for _, t in TEMPLATES]
    n, df = len(bags), Counter(w for b in bags for w in b)
    idf = {w: round(math.log((1 + n) / (1 + k)) + 1, 9) for w, k in df.items()}
    out = []
    for k, (bag, (name, _)) in enumerate(zip(bags, TEMPLATES, strict=True)):
        norm = math.sqrt(sum((c * idf[w]) ** 2 for w, c in bag.items()))
        out.append((k, name, {w: round(c * idf[w] / norm, 9) for w, c in bag.items()}))
    return idf, round(math.log(1 + n) + 1, 9), out


IDF, OTHER, VECTORS = _weights()
#: Of these as many as no line can reach the threshold with alone, whatever the template: lines without other template words are not compared.
COMMON: set[str] = set()
for _w in EVERYDAY:
    if all(math.sqrt(sum(x * x for w, x in v.items() if w in COMMON or w == _w)) < THRESHOLD - 1e-6 for _, _, v in VECTORS):
        COMMON.add(_w)
#: Words of which a line needs one to be compared.
CUES = sorted(set(IDF) - COMMON)
_VALUES = ", ".join(f"({k}, '{name}', '{w}', CAST({x!r} AS DOUBLE), CAST({IDF[w]!r} AS DOUBLE))" for k, name, v in VECTORS for w, x in v.items())
_IDF_VALUES = ", ".join(f"('{w}', CAST({x!r} AS DOUBLE))" for w, x in sorted(IDF.items()))
_IN = ", ".join(f"'{w}'" for w in sorted(IDF))
#: What one occurrence of a word adds to the dot product with each template, and its weight.
_ADDS = "map(" + ", ".join(f"'{w}', array({', '.join(repr(v.get(w, 0.0) * IDF[w]) + 'D' for _, _, v in VECTORS)}, {IDF[w]!r}D)" for w in sorted(IDF)) + ")"
#: Whole words only; letters outside ASCII part words, as in words_of().
_CUE = "(?<![a-z0-9])(" + "|".join(CUES) + ")(?![a-z0-9])"


def _squares(words: str, weight: str) -> str:
    """SQL: the sum of squares of count times weight over the distinct words of an array."""
    return f"""aggregate(sort_array({words}), named_struct('w', '', 'k', 0D, 's', 0D),
      (a, w) -> CASE WHEN w = a.w THEN named_struct('w', w, 'k', a.k + 1D, 's', a.s) ELSE named_struct('w', w, 'k', 1D, 's', a.s + pow(a.k * ({weight}), 2D)) END,
      a -> a.s + pow(a.k * ({weight}), 2D))"""


def _scored(parts: DataFrame) -> DataFrame:
    """id, part, licence, cosine of the best template of each row of parts(id, part, line) that reaches the threshold; ties by template order. All within the row: no word is shuffled."""
    names = "array(" + ", ".join(f"'{n}'" for _, n, _ in VECTORS) + ")"
    return (
        parts.withColumn("_words", F.expr("regexp_extract_all(lower(line), '[a-z0-9]+', 0)"))
        .withColumn("_known", F.expr(f"filter(_words, w -> w IN ({_IN}))"))
        .withColumn("_other", F.expr(f"filter(_words, w -> NOT (w IN ({_IN})))"))
        .withColumn("_adds", F.expr(f"transform(_known, w -> element_at({_ADDS}, w))"))
        .withColumn("_square", F.expr(_squares("_other", f"{OTHER!r}D") + " + " + _squares("_known", f"coalesce(element_at({_ADDS}, a.w)[{len(VECTORS)}], 0D)")))
        .withColumn("_dots", F.expr(f"aggregate(_adds, array_repeat(0D, {len(VECTORS) + 1}), (a, x) -> zip_with(a, x, (p, q) -> p + q))"))
        .select("id", "part", F.inline(F.array(F.expr(f"array_max(transform(slice(_dots, 1, {len(VECTORS)}), (d, k) -> named_struct('cosine', round(d / sqrt(_square), 6), 't', -k, 'licence', {names}[k])))"))))
        .where(f"cosine >= {THRESHOLD}")
        .select("id", "part", "licence", "cosine")
    )


def scan(files: DataFrame) -> DataFrame:
    """id, path, licence, cosine, origin ('header', 'file', 'inherited', 'none'), from_path: one row for each row of files(id, path, text).

    A file's own licence is that of its best line (the earliest of equals), or for a licence file that of its best line or its whole
    text. Licence files cover the files of their directory and below that have none of their own; the nearest directory
    wins, in one directory the best cosine and then the smallest path and id. Null text has no lines, a null path no
    ancestors. Rows of one id and path share what any of them has.
    """
    files = files.select("id", "path", F.coalesce("text", F.lit("")).alias("text")).withColumn("is_file", F.coalesce(F.expr(f"regexp_extract(path, '[^/]*$', 0) RLIKE '{FILE_NAMES}'"), F.lit(False)))
    cued = files.where(F.expr(f"lower(text) RLIKE '{_CUE}'"))
    lines = cued.select("id", "path", F.posexplode(F.expr("split(lower(text), '\\n')")).alias("part", "line")).where(F.expr(f"line RLIKE '{_CUE}'")).select(F.struct("id", "path").alias("id"), "part", "line")
    whole = cued.where("is_file").select(F.struct("id", "path").alias("id"), F.lit(-1).alias("part"), F.col("text").alias("line"))
    scored = _scored(lines.unionByName(whole).distinct())
    own = scored.groupBy("id").agg(F.max(F.struct("cosine", (-F.col("part")).alias("_p"), "licence")).alias("m")).select("id.id", "id.path", F.col("m.licence").alias("own"), "m.cosine")
    own = _util.materialize(own)
    names = files.select("id", "path", "is_file")
    mine = names.join(own.toDF("_id", "_path", "own", "cosine"), F.expr("id <=> _id AND path <=> _path"), "left").drop("_id", "_path")
    given = own.where(F.expr(f"regexp_extract(path, '[^/]*$', 0) RLIKE '{FILE_NAMES}'")).withColumn("dir", F.regexp_replace("path", "/?[^/]*$", ""))
    given = given.groupBy("dir").agg(F.min(F.struct((-F.col("cosine")).alias("_c"), "path", "id", "own")).alias("g")).select("dir", F.col("g.own").alias("licence"), F.col("g.path").alias("from_path"))
    # directories, not files, are joined with their ancestors
    dirs = names.where("path IS NOT NULL").select(F.regexp_replace("path", "/?[^/]*$", "").alias("of")).distinct()
    ancestors = dirs.withColumn("_p", F.split("of", "/")).select("of", F.posexplode(F.expr("transform(sequence(0, size(_p)), i -> array_join(slice(_p, 1, i), '/'))")).alias("depth", "dir"))
    near = ancestors.join(given, "dir").groupBy("of").agg(F.max(F.struct("depth", "licence", "from_path")).alias("n")).select("of", F.col("n.licence").alias("above"), F.col("n.from_path").alias("above_path"))
    out = mine.withColumn("of", F.regexp_replace("path", "/?[^/]*$", "")).join(near, "of", "left")
    return out.select(
        "id",
        "path",
        F.coalesce("own", "above").alias("licence"),
        "cosine",
        F.expr("CASE WHEN own IS NOT NULL AND is_file THEN 'file' WHEN own IS NOT NULL THEN 'header' WHEN above IS NOT NULL THEN 'inherited' ELSE 'none' END").alias("origin"),
        F.expr("CASE WHEN own IS NOT NULL THEN path ELSE above_path END").alias("from_path"),
    )


#: Paths for documents, which have none: by source, language and runs of ids. A document whose first line names a licence by this pattern stands for a licence file, with an even id one directory up.
_OPENS = "(?i)^[^\\n]*(licen[cs]ed under|under the [a-z]+ licen[cs]e)"
_PATH = """concat(coalesce(source, ''), '/', coalesce(lang, ''), '/', CAST(floor(doc_id / 4096) AS BIGINT), '/',
  CASE WHEN {opens} AND doc_id % 2 = 0 THEN '' ELSE concat(CAST(floor(doc_id / 256) AS BIGINT), '/') END, CASE WHEN {opens} THEN concat('LICENSE-', doc_id) ELSE concat(doc_id, '.txt') END)"""


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence of every document."""
    docs = _util.table(spark, sf_dir, "documents")
    opens = "coalesce(text, '') RLIKE '" + _OPENS.replace("\\", "\\\\") + "'"
    files = docs.select(F.col("doc_id").alias("id"), F.expr(_PATH.format(opens=opens)).alias("path"), "text")
    return scan(files).withColumnRenamed("id", "doc_id")


_DUCK_OPENS = f"regexp_matches(coalesce(text, ''), '{_OPENS}')"
_DUCK_PATH = _PATH.format(opens=_DUCK_OPENS).replace("floor(doc_id / 4096)", "(doc_id // 4096)").replace("floor(doc_id / 256)", "(doc_id // 256)")
_DUCK_CUE = "(^|[^a-z0-9])(" + "|".join(CUES) + ")([^a-z0-9]|$)"
OP9_SQL = f"""
WITH files AS (SELECT doc_id AS id, {_DUCK_PATH} AS path, coalesce(text, '') AS text FROM documents),
named AS (SELECT *, regexp_matches(regexp_extract(path, '[^/]*$'), '{FILE_NAMES}') AS is_file, regexp_replace(path, '/?[^/]*$', '') AS dir FROM files),
lines AS (SELECT id, path, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS part, unnest(string_split(text, chr(10))) AS line FROM named),
parts AS (SELECT * FROM lines WHERE regexp_matches(lower(line), '{_DUCK_CUE}') UNION ALL SELECT id, path, -1, text FROM named WHERE is_file AND regexp_matches(lower(text), '{_DUCK_CUE}')),
words AS (SELECT id, path, part, word, count(*) AS tf FROM (SELECT id, path, part, unnest(regexp_extract_all(lower(line), '[a-z0-9]+')) AS word FROM parts) GROUP BY ALL),
idf(word, idf) AS (VALUES {_IDF_VALUES}),
terms(template, licence, word, weight, idf) AS (VALUES {_VALUES}),
weighted AS (SELECT w.*, tf * coalesce(idf, {OTHER!r}::DOUBLE) AS x FROM words w LEFT JOIN idf USING (word)),
norms AS (SELECT id, path, part, sqrt(sum(x * x)) AS norm FROM weighted GROUP BY ALL),
dots AS (SELECT id, path, part, template, licence, sum(x * weight) AS dot FROM weighted JOIN terms USING (word) GROUP BY ALL),
best AS (SELECT d.*, round(dot / norm, 6) AS cosine FROM dots d JOIN norms USING (id, path, part)),
own AS (SELECT * FROM best WHERE cosine >= {THRESHOLD} QUALIFY row_number() OVER (PARTITION BY id, path ORDER BY cosine DESC, part, template) = 1),
given AS (SELECT n.dir, o.licence, n.path AS from_path FROM named n JOIN own o USING (id, path) WHERE n.is_file QUALIFY row_number() OVER (PARTITION BY n.dir ORDER BY o.cosine DESC, n.path, n.id) = 1),
near AS (SELECT n.id, n.path, g.licence AS above, g.from_path AS above_path FROM named n JOIN given g ON n.dir = g.dir OR starts_with(n.dir, g.dir || '/') OR g.dir = '' QUALIFY row_number() OVER (PARTITION BY n.id, n.path ORDER BY length(g.dir) DESC) = 1)
SELECT n.id AS doc_id, n.path, coalesce(o.licence, r.above) AS licence, o.cosine,
  CASE WHEN o.licence IS NOT NULL AND n.is_file THEN 'file' WHEN o.licence IS NOT NULL THEN 'header' WHEN r.above IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
  CASE WHEN o.licence IS NOT NULL THEN n.path ELSE r.above_path END AS from_path
FROM named n LEFT JOIN own o USING (id, path) LEFT JOIN near r USING (id, path)
"""
