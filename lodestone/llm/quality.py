"""Operator 3: quality rules as a learned decision list, all in DataFrame operations.

Statistics of each whole text come from built-in functions. Sequential covering over the statistics of labelled texts grows
a conjunction of thresholds on two thirds of them by information gain and prunes it on the rest, takes away what it
covers and goes on; the rules become ordered CASE expressions.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _util

#: Labelled texts that the rules are learned from, at most: those whose ids have the smallest hashes.
SAMPLE = 8192
#: Thresholds tried for each statistic, conditions in a rule, rules; least precision of a rule on the pruning part and least texts it covers there.
CUTS, CONDITIONS, RULES, PRECISION, COVERED = 48, 3, 12, 0.95, 4
#: Statistics that conditions may use, as SQL over the base statistics.
FEATURES = {
    "n_words": "CAST(n_words AS DOUBLE)",
    "mean_word": "word_chars / greatest(n_words, 1L)",
    "symbols_a_word": "n_symbols / greatest(n_words, 1L)",
    "dup_lines_a_word": "n_dup_lines / greatest(n_words, 1L)",
    "repeated_share": "n_repeat_words / greatest(n_words, 1L)",
}
_WHITE = r"' \t\n\u000b\u000c\r'"


def _bind(value: str, name: str, body: str) -> str:
    """SQL with a value computed once and named."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


_COVERED = _bind(
    # windows by hash and place, sorted: equal ones are neighbours
    "sort_array(transform(_windows, (h, i) -> struct(h AS h, i AS i)))",
    "_s",
    _bind(
        "sort_array(transform(filter(_s, (x, i) -> coalesce(get(_s, i - 1).h = x.h, false) OR coalesce(get(_s, i + 1).h = x.h, false)), x -> x.i))",
        "_p",
        "3L * size(_p) - aggregate(transform(_p, (p, i) -> CAST(greatest(0, 3 - p + coalesce(get(_p, i - 1), p - 3)) AS BIGINT)), 0L, (a, b) -> a + b)",
    ),
)


def statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (all long): one row for each row of df.

    A null text has no words, so every statistic is 0. Windows are compared by 64-bit hashes within one text.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    words = f"CASE WHEN btrim(_text, {_WHITE}) = '' THEN CAST(array() AS ARRAY<STRING>) ELSE split(btrim(_text, {_WHITE}), '[ \\\\t-\\\\r]+') END"
    return (
        df.select(F.col(f"`{id_col}`").alias(id_col), text.alias("_text"))
        .withColumn("_words", F.expr(words))
        .withColumn("_windows", F.expr("CASE WHEN size(_words) < 3 THEN CAST(array() AS ARRAY<BIGINT>) ELSE transform(sequence(0, size(_words) - 3), i -> xxhash64(get(_words, i), get(_words, i + 1), get(_words, i + 2))) END"))
        .withColumn("_lines", F.expr(f"filter(split(_text, '\\n'), l -> btrim(l, {_WHITE}) <> '')"))
        # a generator of one row: filters on its columns can't be moved below, where they would compute the statistics again
        .select(
            id_col,
            F.inline(
                F.array(
                    F.struct(
                        F.expr("CAST(size(_words) AS BIGINT)").alias("n_words"),
                        F.expr("CAST(length(array_join(_words, '')) AS BIGINT)").alias("word_chars"),
                        F.expr("CAST(regexp_count(_text, '[#*$%&|<>]') AS BIGINT)").alias("n_symbols"),
                        F.expr("CAST(size(_lines) - size(array_distinct(_lines)) AS BIGINT)").alias("n_dup_lines"),
                        F.expr(f"CASE WHEN size(array_distinct(_windows)) = size(_windows) THEN 0L ELSE {_COVERED} END").alias("n_repeat_words"),
                    )
                )
            ),
        )
    )


def base_failed() -> Column:
    return F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def holds(self, x: dict[str, float]) -> bool:
        return (x[self.feature] > self.cut) == self.above

    def sql(self) -> str:
        return f"({FEATURES[self.feature]}) {'>' if self.above else '<='} {self.cut!r}D"


Rule = tuple[Condition, ...]


def _cuts(values: list[float]) -> list[float]:
    """Midpoints between neighbouring distinct values, thinned evenly."""
    v = sorted(set(values))
    mid = [(a + b) / 2 for a, b in zip(v, v[1:], strict=False)]
    step = max(1, math.ceil(len(mid) / CUTS))
    return mid[step // 2 :: step] if step > 1 else mid


def _grow(rows: list[tuple[dict[str, float], bool]]) -> Rule:
    """Conditions one by one, each with the largest gain, until none of the good is covered."""
    rule: list[Condition] = []
    while len(rule) < CONDITIONS:
        p, n = sum(bad for _, bad in rows), sum(not bad for _, bad in rows)
        if not p or not n:
            break
        base, best = math.log2(p / (p + n)), (1e-9, None)
        for f in FEATURES:
            values = [x[f] for x, _ in rows]
            for cut in _cuts(values):
                over_p = over_n = 0
                for v, (_, bad) in zip(values, rows, strict=True):
                    if v > cut:
                        if bad:
                            over_p += 1
                        else:
                            over_n += 1
                for above, a, b in ((True, over_p, over_n), (False, p - over_p, n - over_n)):
                    if a:
                        gain = a * (math.log2(a / (a + b)) - base)
                        if gain > best[0]:
                            best = (gain, Condition(f, above, cut))
        if best[1] is None:
            break
        rule.append(best[1])
        rows = [r for r in rows if best[1].holds(r[0])]
    return tuple(rule)


def _worth(rule: Rule, rows: list[tuple[dict[str, float], bool]]) -> tuple[float, int]:
    covered = [bad for x, bad in rows if all(c.holds(x) for c in rule)]
    bad = sum(covered)
    return ((2 * bad - len(covered)) / max(1, len(covered)), len(covered))


def learn(rows: list[tuple[int, dict[str, float], bool]]) -> list[Rule]:
    """Ordered rules that reject, from (id, statistics, whether it is bad). No rows, or rows of one kind, give no rules."""
    part = [(int(hashlib.md5(f"part {k}".encode()).hexdigest()[:8], 16) % 3, x, bad) for k, x, bad in rows]
    growing, pruning = [(x, b) for p, x, b in part if p], [(x, b) for p, x, b in part if not p]
    rules: list[Rule] = []
    while len(rules) < RULES and any(b for _, b in growing):
        rule = _grow(growing)
        while len(rule) > 1 and _worth(rule[:-1], pruning)[0] >= _worth(rule, pruning)[0]:
            rule = rule[:-1]
        worth, covered = _worth(rule, pruning) if rule else (0, 0)
        if not rule or covered < COVERED or (worth + 1) / 2 < PRECISION:
            break
        rules.append(rule)
        growing, pruning = ([r for r in s if not all(c.holds(r[0]) for c in rule)] for s in (growing, pruning))
    return rules


def verdict(rules: list[Rule]) -> Column:
    """Number of the first rule that rejects, or null."""
    if not rules:
        return F.lit(None).cast("int")
    return F.expr("CASE " + " ".join(f"WHEN {' AND '.join(c.sql() for c in rule)} THEN {k}" for k, rule in enumerate(rules, 1)) + " END")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> list[Rule]:
    """Rules from labelled rows of docs that pass the base conditions; label 0 is bad, 1 good, others and null are left out. At most SAMPLE labels are used, and so is the memory that learning takes; of rows that repeat a doc_id the one of the least statistics is."""
    chosen = labels.where(F.col(f"`{label_col}`").isin(0, 1) & F.col(f"`{id_col}`").isNotNull()).groupBy(F.col(f"`{id_col}`").alias("_key")).agg((F.min(f"`{label_col}`") == 0).alias("_bad"))
    chosen = chosen.orderBy(F.xxhash64(F.lit(17), "_key"), "_key").limit(SAMPLE)
    # SAMPLE rows of two small columns: a broadcast of a fixed bound
    some = docs.join(F.broadcast(chosen), docs[id_col] == chosen["_key"], "inner")
    stats = statistics(some.select(F.struct("_key", "_bad").alias("_of"), F.col(f"`{text_col}`").alias("text")), "_of", "text")
    features = F.struct(*[F.expr(f"CAST({v} AS DOUBLE)").alias(k) for k, v in FEATURES.items()])
    # a row for each label chosen, SAMPLE at most
    rows = stats.where(~base_failed()).groupBy("_of._key", "_of._bad").agg(F.min(features).alias("of")).collect()
    return learn(sorted(((r["_key"], r["of"].asDict(), r["_bad"]) for r in rows), key=lambda r: r[0]))


def judge(docs: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, the statistics, base_failed, rule (number of the rule that rejects, or null), kept."""
    return (
        statistics(docs, id_col, text_col)
        .withColumn("base_failed", base_failed())
        .withColumn("rule", F.when(~F.col("base_failed"), verdict(rules)))
        .withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
    )


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every whole text of documents."""
    docs, labels = _util.table(spark, sf_dir, "documents"), _util.table(spark, sf_dir, "labels")
    return judge(docs, fit(docs, labels))
