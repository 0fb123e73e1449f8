"""Set operators: anti joins, coverage of definitions, multiset differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def unused(defns: DataFrame, used: DataFrame, name: str, exempt: Column | None = None) -> DataFrame:
    """Definitions whose name nothing uses; exempt ones are never unused."""
    out = defns.join(used.select(F.col(used.columns[0]).alias(name)).where(F.col(name).isNotNull()), name, "left_anti")
    return out if exempt is None else out.where(~F.coalesce(exempt, F.lit(False)))


def coverage(sites: DataFrame, definitions: DataFrame, min_variants: int = 2, max_missing: int | None = None) -> DataFrame:
    """Sites that cover part of their definition: enum, site, covered, variants, missing, gap.

    sites: enum, site, variants; definitions: enum, def_id, variants, several for one enum when names collide. A site is
    judged by the smallest definition that holds all it covers, or else by the union of all.
    """
    every = definitions.groupBy("enum").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("variants")))).alias("_all"))
    d = definitions.select("enum", "def_id", F.col("variants").alias("_def"))
    fits = sites.join(d, "enum").where(F.size(F.array_except("variants", "_def")) == 0).groupBy("enum", "site").agg(F.min(F.struct(F.size("_def"), F.col("def_id"), F.col("_def")))["_def"].alias("_own"))
    judged = sites.join(fits, ["enum", "site"], "left").join(every, "enum").withColumn("_def", F.coalesce("_own", "_all"))
    judged = judged.withColumn("missing", F.array_sort(F.array_except("_def", "variants"))).withColumn("covered", F.size("variants")).withColumn("total", F.size("_def"))
    out = judged.where(F.expr(f"size(missing) > 0 AND total >= {min_variants}" + (f" AND size(missing) <= {max_missing}" if max_missing is not None else "")))
    return out.select("enum", "site", "covered", F.col("total").alias("variants"), F.array_join("missing", ",").alias("missing"), F.round(F.col("covered") / F.col("total"), 6).alias("gap"))


def parallel_sets(sites: DataFrame) -> DataFrame:
    """Sites grouped by what they cover: enum, covers, wildcard, sites, first."""
    return sites.groupBy("enum", F.array_join(F.array_sort("variants"), ",").alias("covers"), "wildcard").agg(F.count("*").alias("sites"), F.min("site").alias("first"))


def worst_gaps(covered: DataFrame) -> DataFrame:
    """One row an enum: partial sites and the worst gap."""
    return covered.groupBy("enum").agg(F.count("*").alias("partial"), F.max("gap").alias("worst"))


def multiset_diff(now: DataFrame, base: DataFrame, key: list[str]) -> DataFrame:
    """key, unchanged, new, gone: of equal rows the lesser count is unchanged and the surplus new or gone. Counts are summed before they meet, so a hot key is two numbers."""
    each = now.groupBy(*key).agg(F.count("*").alias("now"), F.lit(0).cast("long").alias("base")).unionByName(base.groupBy(*key).agg(F.lit(0).cast("long").alias("now"), F.count("*").alias("base")))
    return each.groupBy(*key).agg(F.sum("now").alias("now"), F.sum("base").alias("base")).select(*key, F.least("now", "base").alias("unchanged"), F.greatest(F.col("now") - F.col("base"), F.lit(0)).alias("new"), F.greatest(F.col("base") - F.col("now"), F.lit(0)).alias("gone"))


def moved(new: DataFrame, gone: DataFrame, key: list[str], order: str) -> DataFrame:
    """New rows paired one to one with gone rows of the same key, in order: key, order, was."""
    a = new.withColumn("_rn", F.row_number().over(W.partitionBy(*key).orderBy(order)))
    b = gone.select(*key, F.col(order).alias("was"), F.row_number().over(W.partitionBy(*key).orderBy(order)).alias("_rn"))
    return a.join(b, [*key, "_rn"]).drop("_rn")


def declared_once(claims: DataFrame, members: DataFrame) -> DataFrame:
    """Members of a cluster that claim nothing while exactly one of them claims a concept: cluster, concept, item. claims: item, concept; members: cluster, item."""
    m = members.join(claims, "item", "left")
    one = m.groupBy("cluster").agg(F.count("concept").alias("_n"), F.max("concept").alias("_c")).where("_n = 1").select("cluster", "_c")
    return m.where("concept IS NULL").join(one, "cluster").select("cluster", F.col("_c").alias("concept"), "item")
