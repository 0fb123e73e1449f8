"""The findings battery: union, selection, gates, caps that spare gating rows, ledgers of waivers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import scores, text
from ..functions.fingerprint import fingerprint

COLUMNS = ["check", "label", "site", "score"]


def findings(parts: dict[str, DataFrame], only: list[str] | None = None, skip: list[str] | None = None) -> DataFrame:
    """Findings of several checks in one stream, with fingerprints: check, label, site, score, gate, gates, fp.

    parts: label, site, score by check. Unknown names in only or skip, or a selection of nothing, are errors. Scores gate raw.
    """
    unknown = sorted({*(only or []), *(skip or [])} - set(parts))
    if unknown:
        raise ValueError(f"no such check: {', '.join(unknown)}; there are {', '.join(sorted(parts))}")
    chosen = {k: v for k, v in parts.items() if (only is None or k in only) and k not in (skip or [])}
    if not chosen:
        raise ValueError("the selection leaves no check")
    rows = reduce(DataFrame.unionByName, [v.select(F.lit(k).alias("check"), F.col("label").cast("string"), F.col("site").cast("string"), F.col("score").cast("double")) for k, v in chosen.items()])
    gate = F.lit(None).cast("double")
    for k in chosen:
        gate = F.when(F.col("check") == k, F.lit(scores.GATES.get(k))).otherwise(gate)
    return rows.withColumn("gate", gate).withColumn("gates", F.coalesce(F.col("score") >= F.col("gate"), F.lit(False))).withColumn("fp", fingerprint(F.col("check"), [F.col("label")], F.col("site")))


def rank_cap(rows: DataFrame, top: int, by: list[str] | None = None, order: list[Column] | None = None) -> DataFrame:
    """The first `top` rows of each check, and beyond them those whose score as printed, with two decimals, reaches the gate. 0: all. `of` counts the rows before the cut."""
    by = by or ["check"]
    order = order or [F.desc("score"), F.asc("site"), F.asc("label")]
    w = W.partitionBy(*by)
    ranked = rows.withColumn("rank", F.row_number().over(w.orderBy(*order))).withColumn("of", F.count("*").over(w))
    return ranked if top == 0 else ranked.where(F.expr(f"rank <= {top}") | F.coalesce(F.round("score", 2) >= F.col("gate"), F.lit(False)))


def totals(rows: DataFrame) -> DataFrame:
    return rows.groupBy("check").agg(F.count(F.when(F.col("gates"), 1)).alias("gating"), F.count(F.when(~F.col("gates"), 1)).alias("advisory"))


def _kinds(rows: DataFrame) -> DataFrame:
    """rows(file, line, check, key, ...) once for each check and key (null: any) that a waiver which covers it may name: columns _c, _k."""
    cut = F.expr("filter(sequence(1, greatest(1, length(key) - 1)), i -> substring(key, i, 2) = '::')")
    before = F.transform(cut, lambda i: F.expr("key").substr(F.lit(1), i - 1))
    keys = F.when(F.col("key").isNull(), F.array(F.lit(None).cast("string"))).otherwise(F.array_distinct(F.concat(F.array(F.lit(None).cast("string"), F.col("key"), text.last_segment(F.col("key"))), before)))
    checks = F.array_distinct(F.array(F.lit(None).cast("string"), F.col("check")))
    return rows.where("file IS NOT NULL AND line IS NOT NULL").withColumn("_c", F.explode(checks)).withColumn("_k", F.explode(keys))


def _spans(waivers: DataFrame) -> DataFrame:
    """Both ends of the different spans of waivers, on the sides of a line (_side 1) that it covers: file, _c, _k, lo, hi, _at, _side."""
    spans = waivers.select("file", F.col("check").cast("string").alias("_c"), F.col("key").cast("string").alias("_k"), "lo", "hi").where("file IS NOT NULL AND lo <= hi").distinct()
    return spans.withColumn("_end", F.explode(F.array(F.struct(F.col("lo").alias("_at"), F.lit(0).alias("_side")), F.struct(F.col("hi").alias("_at"), F.lit(2).alias("_side"))))).select("*", "_end._at", "_end._side").drop("_end")


def _so_far(n: str) -> Column:
    """Sum of n up to here in the lines and ends of spans of one file, check and key."""
    return F.sum(n).over(W.partitionBy("file", "_c", "_k").orderBy("_at", "_side"))


def waive(rows: DataFrame, waivers: DataFrame) -> DataFrame:
    """Findings that no waiver covers. rows: file, line, check, key; waivers: file, lo, hi, check, key (null: any).

    Lines and the ends of spans are passed in order, with the spans open at each line counted, so that findings don't meet waivers pair by pair.
    """
    ends = _spans(waivers)
    lines = _kinds(rows.select("file", "line", "check", "key").distinct()).withColumn("_at", F.col("line")).withColumn("_side", F.lit(1)).withColumn("_n", F.lit(0))
    both = lines.unionByName(ends.drop("lo", "hi").withColumn("_n", F.expr("1 - _side")), allowMissingColumns=True)
    covered = both.withColumn("_open", _so_far("_n")).where("_side = 1 AND _open > 0").select(F.col("file").alias("_f"), F.col("line").alias("_l"), F.col("check").alias("_ch"), F.col("key").alias("_key")).distinct()
    same = (rows["file"] == covered["_f"]) & (rows["line"] == covered["_l"]) & rows["check"].eqNullSafe(covered["_ch"]) & rows["key"].eqNullSafe(covered["_key"])
    return rows.join(covered, same, "left_anti")


def ledger(waivers: DataFrame, rows: DataFrame, today: Column) -> DataFrame:
    """Each waiver with how many findings it covers and its age in days; without hits it is stale, without date undated.

    Findings are counted up to each end of a span, as in waive(); the difference of both ends is what the span covers.
    """
    ends = _spans(waivers)
    lines = _kinds(rows.groupBy("file", "line", "check", "key").agg(F.count("*").alias("_n"))).groupBy("file", "_c", "_k", F.col("line").alias("_at")).agg(F.sum("_n").alias("_n")).withColumn("_side", F.lit(1))
    both = ends.withColumn("_n", F.lit(0).cast("long")).unionByName(lines, allowMissingColumns=True)
    passed = both.withColumn("_passed", _so_far("_n")).where("_side <> 1")
    counts = passed.groupBy("file", "_c", "_k", "lo", "hi").agg(F.sum(F.expr("(_side - 1) * _passed")).alias("suppresses")).toDF("_f", "_c", "_k", "_lo", "_hi", "suppresses")
    w = waivers
    same = (w["file"] == counts["_f"]) & w["check"].eqNullSafe(counts["_c"]) & w["key"].eqNullSafe(counts["_k"]) & (w["lo"] == counts["_lo"]) & (w["hi"] == counts["_hi"])
    counts = w.join(counts, same, "left").select(*[w[c] for c in w.columns], F.coalesce("suppresses", F.lit(0)).cast("long").alias("suppresses"))
    return counts.withColumn("age", F.datediff(today, "date")).withColumn("state", F.expr("CASE WHEN suppresses = 0 THEN 'stale' WHEN date IS NULL THEN 'undated' ELSE 'live' END"))


def contract_candidates(fns: DataFrame, calls: DataFrame, min_callers: int = 3) -> DataFrame:
    """Functions worth a contract: name, callers, modules, score. fns: name, loc, ret, free, documented; calls: callee, caller, module. Names defined twice are ambiguous and left out."""
    single = fns.groupBy("name").agg(F.count("*").alias("_n"), *[F.first(c).alias(c) for c in ("loc", "ret", "free", "documented")]).where("_n = 1")
    used = calls.groupBy(F.col("callee").alias("name")).agg(F.countDistinct("caller").alias("callers"), F.countDistinct("module").alias("modules")).where(F.col("callers") >= min_callers)
    s = scores.contract_candidates(F.col("callers"), F.col("modules"), F.col("loc"), F.col("free"), F.col("ret").isin("Result", "Option"), ~F.col("documented"))
    return single.join(used, "name").select("name", "callers", "modules", F.round(s, 6).alias("score"))


def gate(proposals: DataFrame, corpus: DataFrame) -> DataFrame:
    """What a proposed item would repeat: proposed, why, verdict, existing. Both have name, shape, signature, doc, body; the proposals are few and held against the corpus by five equi-joins."""
    out = []
    for why, column, verdict in (("same name", "name", "collide"), ("same shape", "shape", "warn"), ("same signature", "signature", "warn"), ("same doc", "doc", "warn"), ("same body", "body", "collide")):
        p = proposals.where(F.col(column).isNotNull()).select(F.col("name").alias("proposed"), F.col(column).alias("_k"))
        c = corpus.where(F.col(column).isNotNull()).select(F.col("id").alias("existing"), F.col(column).alias("_k"))
        out.append(p.join(c, "_k").groupBy("proposed").agg(F.count("*").alias("hits"), F.min("existing").alias("existing")).select("proposed", F.lit(why).alias("why"), F.lit(verdict).alias("verdict"), "hits", "existing"))
    return reduce(DataFrame.unionByName, out)
