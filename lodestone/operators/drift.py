"""Drift between siblings: votes on fields, steps of chains, checked against raw, guarded against unguarded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import scores


def config_drift(df: DataFrame, owner: str, fields: list[str], module: Column, naming: frozenset[str] = frozenset(), least: float = 0.05) -> DataFrame:
    """Owners whose sites agree in some fields and differ in others: owner, sites, configs, agreed, differing, differs, score.

    A null field abstains: it is no vote, but counts as `?` among the configurations. A field is compared if at least two sites
    vote on it; fields that only name the site neither agree nor differ.
    """
    rows = df.select(F.col(owner).alias("owner"), module.alias("module"), *[F.col(f).cast("string").alias(f) for f in fields])
    rows = rows.withColumn("config", F.concat_ws("\u0001", *[F.coalesce(F.col(f), F.lit("?")) for f in fields]))
    per_field = [F.count(f).alias(f"n_{f}") for f in fields] + [F.min(f).alias(f"lo_{f}") for f in fields] + [F.max(f).alias(f"hi_{f}") for f in fields]
    g = rows.groupBy("owner").agg(F.count("*").alias("sites"), F.countDistinct("config").alias("configs"), F.countDistinct("module").alias("modules"), *per_field)
    judged = [f for f in fields if f not in naming]
    agree = sum((F.expr(f"CASE WHEN n_{f} >= 2 AND lo_{f} = hi_{f} THEN 1 ELSE 0 END") for f in judged), F.lit(0))
    names = F.filter(F.array(*[F.expr(f"CASE WHEN n_{f} >= 2 AND lo_{f} <> hi_{f} THEN '{f}' END") for f in judged]), lambda x: x.isNotNull())
    g = g.withColumn("agreed", agree).withColumn("_names", names).withColumn("differing", F.size("_names")).where("differing > 0 AND sites > 1")
    score = scores.config_drift(F.col("agreed"), F.col("differing"), F.col("configs"), F.col("modules"), F.col("sites"))
    return g.select("owner", "sites", "configs", "agreed", "differing", F.array_join("_names", ",").alias("differs"), F.round(score, 6).alias("score")).where(score >= least)


def builder_drift(chains: DataFrame, root: str, chain: str, least: float = 0.05, near: float = 0.35) -> DataFrame:
    """Roots whose chains all take some steps and only sometimes others: root, chains, shared, differs, leanest, richest, score. chains: root, chain, method."""
    per = chains.groupBy(root, chain).agg(F.collect_set("method").alias("methods"))
    total = per.groupBy(root).agg(F.count("*").alias("chains"), F.min(F.struct(F.size("methods"), F.col(chain)))[chain].alias("leanest"), F.max(F.struct(F.size("methods").alias("n"), (-F.unix_seconds(F.col(chain).cast("timestamp"))).alias("_t"), F.col(chain)))[chain].alias("richest")).where("chains > 1")
    steps = per.select(root, F.explode("methods").alias("method")).groupBy(root, "method").agg(F.count("*").alias("n"))
    g = steps.join(total, root).groupBy(root, "chains", "leanest", "richest").agg(F.count(F.when(F.expr("n = chains"), 1)).alias("shared"), F.array_sort(F.collect_set(F.when(F.expr("n < chains"), F.col("method")))).alias("_differs"))
    g = g.where("size(_differs) > 0")
    score = scores.builder_drift(F.col("shared"), F.size("_differs"), F.lit(near))
    return g.select(root, "chains", "shared", F.array_join("_differs", ",").alias("differs"), "leanest", "richest", F.round(score, 6).alias("score")).where(score >= least)


def ratio_groups(df: DataFrame, by: list[str], checked: Column, least: float = 0.5) -> DataFrame:
    """Groups with at least two checked and one raw site: by, checked, raw, score."""
    g = df.groupBy(*by).agg(F.count(F.when(checked, 1)).alias("checked"), F.count(F.when(~checked, 1)).alias("raw")).where("checked >= 2 AND raw >= 1")
    score = scores.ratio_drift(F.col("checked"), F.col("raw"))
    return g.withColumn("score", F.round(score, 6)).where(score >= least)


def validation_drift(df: DataFrame, cohorts: list[list[str]], key: str, checked: Column, least: float = 0.55) -> DataFrame:
    """Unchecked rows with checked siblings, each with its best cohort: key, cohort, checked_siblings, size, score."""
    names = [F.concat_ws("/", F.lit("+".join(c)), *[F.col(x).cast("string") for x in c]) for c in cohorts]
    each = df.select(F.col(key).alias("key"), checked.alias("checked"), F.explode(F.array(*names)).alias("cohort"))
    g = each.groupBy("cohort").agg(F.count(F.when(F.col("checked"), 1)).alias("c"), F.count(F.when(~F.col("checked"), 1)).alias("u")).where("c > 0 AND u > 0")
    g = g.withColumn("score", F.round(scores.validation_drift(F.col("c"), F.col("u")), 6)).where(F.col("score") >= least)
    best = each.where("NOT checked").join(g, "cohort").groupBy("key").agg(F.max_by(F.struct("cohort", "c", "u", "score"), F.struct(F.col("score"), F.col("cohort"))).alias("b"))
    return best.select("key", F.col("b.cohort").alias("cohort"), F.col("b.c").alias("checked_siblings"), (F.col("b.c") + F.col("b.u")).alias("size"), F.col("b.score").alias("score"))


def usage_facts(df: DataFrame, by: str, caller: str, facts: dict[str, Column], top: int = 3) -> DataFrame:
    """by, fact, sites, callers, detail: how often each fact holds at the sites of a callee, by how many callers, with its first few sites."""
    pairs = F.array(*[F.when(c, F.lit(k)) for k, c in facts.items()])
    each = df.select(F.col(by).alias(by), F.col(caller).alias("_caller"), F.explode(F.filter(pairs, lambda x: x.isNotNull())).alias("fact"))
    seen = each.groupBy(by, "fact", "_caller").agg(F.count("*").alias("_n")).withColumn("_rn", F.row_number().over(W.partitionBy(by, "fact").orderBy("_caller")))
    return seen.groupBy(by, "fact").agg(F.sum("_n").alias("sites"), F.count("*").alias("callers"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("_rn") <= top, F.col("_caller").cast("string")))), ",").alias("detail"))
