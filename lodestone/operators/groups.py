"""Grouping operators: exact copies, concepts, matrices, counts at several levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import scores, text


def copies(df: DataFrame, body: str, name: str, place: str, tokens: Column, key: str, min_tokens: int = 24) -> DataFrame:
    """Groups of rows with one body: score, n, tokens, label (names joined by `/`), first (least key). Bodies are met by digest, so no body crosses the network."""
    rows = df.select(F.sha2(F.col(body).cast("string"), 256).alias("digest"), F.col(name).alias("name"), F.col(place).alias("place"), F.col(key).alias("key"), tokens.cast("long").alias("tokens")).where(F.col("tokens") >= min_tokens)
    groups = rows.groupBy("digest").agg(F.count("*").alias("n"), F.first("tokens").alias("tokens"), F.min("name").alias("_a"), F.max("name").alias("_z"), F.min("place").alias("_b"), F.max("place").alias("_y"), F.collect_set("name").alias("_names"), F.min("key").alias("first"))
    groups = groups.where("n > 1")
    score = scores.clones(F.col("tokens"), F.col("n"), F.col("_a") == F.col("_z"), F.col("_b") == F.col("_y"))
    return groups.select("digest", F.round(score, 6).alias("score"), "n", "tokens", F.array_join(F.array_sort("_names"), "/").alias("label"), "first")


def word_concepts(df: DataFrame, inner: list[str], name: Column, key: str, public: Column, module: Column, floor: float = 0.35) -> DataFrame:
    """Rows that agree in `inner` and share a word of their names: inner, word, n, positional, score.

    Of the word groups within one inner value a group is dropped if it lies in one that comes before it by size (larger first) and
    word. As inclusion is transitive, looking at all earlier groups drops what a pass in order would, equal groups but
    the first included. Groups are compared through the members they share, counted by joins.
    """
    rows = df.select(*inner, F.col(key).alias("_key"), text.words_of(name).alias("_words"), public.alias("_public"), module.alias("_module"))
    each = rows.select(*inner, "_key", "_words", "_public", "_module", F.explode(F.array_distinct("_words")).alias("word"))
    groups = each.groupBy(*inner, "word").agg(
        F.count("*").alias("n"),
        F.avg(F.col("_public").cast("double")).alias("share"),
        F.countDistinct("_module").alias("modules"),
        (F.min((F.get("_words", F.lit(0)) == F.col("word")).cast("int")) + F.min((F.get("_words", F.size("_words") - 1) == F.col("word")).cast("int")) > 0).alias("positional"),
    )
    groups = groups.where("n >= 2")
    member = each.select(*inner, "_key", "word").join(groups.select(*inner, "word", "n"), [*inner, "word"])
    other = member.select(*inner, "_key", F.col("word").alias("_word2"), F.col("n").alias("_n2"))
    inside = member.join(other, [*inner, "_key"]).where("_word2 <> word AND (_n2 > n OR (_n2 = n AND _word2 < word))").groupBy(*inner, "word", "_word2", "n").agg(F.count("*").alias("_both")).where("_both = n").select(*inner, "word").distinct()
    kept = groups.join(inside, [*inner, "word"], "left_anti")
    score = scores.concepts(F.col("n"), F.col("share"), F.col("modules"), F.col("positional"), F.lit(1.0))
    return kept.select(*inner, "word", "n", "positional", F.round(score, 6).alias("score")).where(F.col("score") >= floor)


def shape_pairs(df: DataFrame, owner: str, member: Column, least: float = 0.6, min_size: int = 3) -> DataFrame:
    """Pairs of distinct member sets with a Jaccard similarity of at least `least`: set_a, set_b, owners_a, owners_b, similarity.

    Owners with one set are one class; classes are paired through shared members, counted, so sets without a common
    member are never compared.
    """
    sets = df.groupBy(owner).agg(F.array_sort(F.collect_set(member)).alias("members")).where(F.size("members") >= min_size)
    classes = sets.groupBy("members").agg(F.count("*").alias("owners")).withColumn("name", F.array_join("members", ","))
    one = classes.select("name", "owners", F.size("members").alias("size"), F.explode("members").alias("m"))
    two = one.toDF("name_b", "owners_b", "size_b", "m")
    met = one.join(two, "m").where("name < name_b").groupBy("name", "name_b", "owners", "owners_b", "size", "size_b").agg(F.count("*").alias("both"))
    sim = F.col("both") / (F.col("size") + F.col("size_b") - F.col("both"))
    return met.select(F.col("name").alias("set_a"), F.col("name_b").alias("set_b"), F.col("owners").alias("owners_a"), "owners_b", F.round(sim, 6).alias("similarity")).where(sim >= least)


def presence_matrix(df: DataFrame, member: str, callee: str) -> DataFrame:
    """callee, present, absent, diverges, missing: for each callee the members that lack it. It diverges if more have it than lack it and some lack it."""
    pairs = df.select(F.col(member).alias("member"), F.col(callee).alias("callee")).where("member IS NOT NULL AND callee IS NOT NULL").distinct()
    members = pairs.select("member").distinct()
    total = members.agg(F.count("*").alias("total"), F.array_sort(F.collect_set("member")).alias("all"))
    have = pairs.groupBy("callee").agg(F.count("*").alias("present"), F.collect_set("member").alias("has"))
    # one row: the cohort that was asked for
    out = have.join(F.broadcast(total)).withColumn("absent", F.col("total") - F.col("present"))
    return out.select("callee", "present", "absent", F.expr("present > absent AND absent > 0").alias("diverges"), F.array_join(F.array_except("all", "has"), ",").alias("missing"))


def grouped_counts(df: DataFrame, levels: list[str]) -> DataFrame:
    """Counts at each level of a hierarchy and in total, in one pass: the levels (null where summed over) and `n`."""
    return df.rollup(*levels).agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


def one_side_or_both(df: DataFrame, owner: str, a: Column, b: Column) -> DataFrame:
    """owner, side ('A-only', 'B-only', 'both'), hits of each: a conditional aggregate instead of an outer join of two filters."""
    hits = df.groupBy(owner).agg(F.count(F.when(a, 1)).alias("a_hits"), F.count(F.when(b, 1)).alias("b_hits"))
    return hits.where("a_hits + b_hits > 0").withColumn("side", F.expr("CASE WHEN b_hits = 0 THEN 'A-only' WHEN a_hits = 0 THEN 'B-only' ELSE 'both' END"))


def only_definition(df: DataFrame, name: str, value: str) -> DataFrame:
    """Names with one value in all their rows; ambiguous names, or those with an unknown value, are left out."""
    return df.groupBy(name).agg(F.min(value).alias(value), F.max(value).alias("_max"), F.count("*").alias("_n"), F.count(value).alias("_known")).where(F.expr(f"{value} = _max AND _n = _known")).select(name, value)


def distinct_per(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(key).orderBy(*order))).where("_rn = 1").drop("_rn")
