"""Closures over edges by rounds of joins. Each round's frontier is written to the shared folder, so lineage stays short and a lost executor costs a file read."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import materialize


def reach(edges: DataFrame, start: DataFrame, max_depth: int | None = None) -> DataFrame:
    """node, depth: what start(node) reaches along edges(src, dst), each node once at its first depth."""
    edges = materialize(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct())
    seen = frontier = materialize(start.select("node").distinct().withColumn("depth", F.lit(0)))
    depth = 0
    while (max_depth is None or depth < max_depth) and not frontier.isEmpty():
        depth += 1
        step = frontier.join(edges, frontier.node == edges.src).select(F.col("dst").alias("node")).distinct()
        frontier = materialize(step.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)))
        seen = materialize(seen.unionByName(frontier))
    return seen


def transitively_unused(defns: DataFrame, calls: DataFrame, rounds: int | None = 16) -> DataFrame:
    """name, round: definitions that nothing uses, and those used by such alone. calls: caller (null: from outside), target. Ends when a round finds none, or after `rounds` if given."""
    dead = None
    calls = materialize(calls.select("caller", "target").distinct())
    for k in itertools.count() if rounds is None else range(rounds):
        live = calls if dead is None else calls.join(dead.select(F.col("name").alias("caller")), "caller", "left_anti")
        found = defns.select("name").join(live.select(F.col("target").alias("name")), "name", "left_anti").distinct()
        found = found if dead is None else found.join(dead, "name", "left_anti")
        found = materialize(found.withColumn("round", F.lit(k)))
        if found.isEmpty():
            break
        dead = found if dead is None else materialize(dead.unionByName(found))
    return dead if dead is not None else defns.select("name").limit(0).withColumn("round", F.lit(0))


def synonyms(aliases: DataFrame, name: str) -> DataFrame:
    """node: every name that means the same as `name` through aliases(alias, target): what it leads to, and all that leads there. Cycles end."""
    start = aliases.sparkSession.createDataFrame([(name,)], "node string")
    ahead = reach(aliases.selectExpr("alias AS src", "target AS dst"), start)
    return reach(aliases.selectExpr("target AS src", "alias AS dst"), ahead.select("node")).select("node")


def test_support(packages: DataFrame, edges: DataFrame) -> DataFrame:
    """Packages that are only reached by development edges. packages: name; edges: src, dst, kind ('normal' or 'dev'). Roots are packages nobody depends on; without roots, or if all would be demoted, there is no answer and no row."""
    roots = packages.select(F.col("name").alias("node")).join(edges.select(F.col("dst").alias("node")), "node", "left_anti")
    if roots.isEmpty():
        return packages.limit(0).select("name")
    production = reach(edges.where("kind = 'normal'"), roots)
    rest = packages.select("name").join(production.select(F.col("node").alias("name")), "name", "left_anti")
    return rest
