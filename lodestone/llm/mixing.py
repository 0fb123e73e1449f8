"""Operator 7: mixing sources to target weights by hierarchical budgeting, all in DataFrame operations.

Weights go down a tree of domain, language and source. At each node the budget is shared among the children in proportion
to their weights, none gets more than its subtree holds in all its epochs, and what one can't use goes to its siblings;
only what a whole subtree can't use goes to the siblings of its ancestors, as the node's own budget was cut to what it
holds. A leaf then takes whole epochs of its documents, and of one more epoch the longest prefix, in that epoch's seeded
order, whose tokens fit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _util

SEED, EPOCHS, SHARE = 11, 2, 1.0
DOMAIN = "coalesce(element_at(array('web', 'books', 'forums', 'reference'), CAST(try_cast(regexp_extract(source, '([0-9]+)$', 1) AS INT) % 4 + 1 AS INT)), 'other')"
DOMAIN_WEIGHTS = {"web": 0.4, "books": 0.3, "forums": 0.1, "reference": 0.2}
LANG_WEIGHTS = {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}
SOURCE_WEIGHTS: dict[str, float] = {}
#: Weight of what the tables above don't name.
OTHER = 0.1
OTHER_SOURCE = 1.0
#: Hash ranges in which a leaf's documents are summed before the range with the border is summed one by one.
DIGITS = 3
_WORDS = "CASE WHEN btrim(text, ' \\t\\n\\u000b\\f\\r') = '' THEN 0L ELSE CAST(size(split(btrim(text, ' \\t\\n\\u000b\\f\\r'), '[ \\\\t-\\\\r]+')) AS BIGINT) END"


def _weight(column: str, weights: dict[str, float], other: float) -> str:
    return "CASE " + " ".join(f"WHEN {column} = '{k}' THEN CAST({v!r} AS DOUBLE)" for k, v in weights.items()) + f" ELSE CAST({other!r} AS DOUBLE) END" if weights else f"CAST({other!r} AS DOUBLE)"


def _shared(nodes: str, parent: list[str], key: str) -> str:
    """SQL: each child's part `got` of its parent's budget `has`, from weight w and capacity c. The children sorted by c / w are full up to the first whose fullness would overrun the budget."""
    by = f"PARTITION BY {', '.join(parent)}" if parent else "PARTITION BY 1"
    frame = f"{by} ORDER BY c / w, {key} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    return f"""(SELECT *, CASE WHEN fits THEN c ELSE w * (has - sum(CASE WHEN fits THEN c ELSE 0.0 END) OVER ({by})) / sum(CASE WHEN fits THEN 0.0 ELSE w END) OVER ({by}) END AS got
      FROM (SELECT *, sum(c) OVER ({frame}) + (c / w) * (sum(w) OVER ({by}) - sum(w) OVER ({frame})) <= has + 1e-6 AS fits FROM {nodes}) AS n)"""


def plan_sql(leaves: str, share: float, epochs: int) -> str:
    """SQL for the leaves' plan from a relation of domain, lang, source, tokens: budget, whole epochs, and tokens of the last, partial epoch."""
    d, la, s = _weight("domain", DOMAIN_WEIGHTS, OTHER), _weight("lang", LANG_WEIGHTS, OTHER), _weight("source", SOURCE_WEIGHTS, OTHER_SOURCE)
    cap = f"CAST({epochs} AS DOUBLE) * CAST(sum(tokens) AS DOUBLE)"
    total = f"least(CAST({share!r} AS DOUBLE), CAST({epochs} AS DOUBLE)) * (SELECT CAST(sum(tokens) AS DOUBLE) FROM {leaves})"
    one = _shared(f"(SELECT domain, {d} AS w, {cap} AS c, {total} AS has FROM {leaves} GROUP BY domain)", [], "domain")
    two = _shared(f"(SELECT l.domain AS domain, l.lang AS lang, l.w AS w, l.c AS c, p.got AS has FROM (SELECT domain, lang, {la} AS w, {cap} AS c FROM {leaves} GROUP BY domain, lang) AS l JOIN {one} AS p ON l.domain = p.domain)", ["domain"], "lang")
    three = _shared(f"(SELECT l.domain AS domain, l.lang AS lang, l.source AS source, l.tokens AS tokens, {s.replace('source', 'l.source')} AS w, CAST({epochs} AS DOUBLE) * CAST(l.tokens AS DOUBLE) AS c, p.got AS has FROM {leaves} AS l JOIN {two} AS p ON l.domain = p.domain AND l.lang = p.lang)", ["domain", "lang"], "source")
    return f"""SELECT domain, lang, source, tokens, budget, CASE WHEN tokens = 0 THEN CAST({epochs} AS BIGINT) ELSE CAST(floor(budget / tokens) AS BIGINT) END AS whole,
      CASE WHEN tokens = 0 THEN 0 ELSE budget % tokens END AS rest
    FROM (SELECT domain, lang, source, tokens, CAST(floor(got + 1e-3) AS BIGINT) AS budget FROM {three} AS x) AS y"""


#: Leaves up to which a plan is broadcast; a larger one is joined by shuffles.
BROADCAST_LEAVES = 10_000


def _near(leaves: DataFrame) -> DataFrame:
    """A table of one row a leaf, broadcast if its counted rows are few: a hot leaf's documents then stay where they are."""
    return F.broadcast(leaves) if leaves.limit(BROADCAST_LEAVES + 1).count() <= BROADCAST_LEAVES else leaves


def sizes(docs: DataFrame, domain: str = DOMAIN) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens: whitespace-separated words of each whole text; null text counts as empty, null lang or source as ''."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"))
    return rows.select("doc_id", F.expr(domain).alias("domain"), "lang", "source", F.expr(_WORDS).alias("n_tokens"))


def _order(seed: int) -> str:
    """SQL: a document's place in the partial epoch of its leaf. Rows of one doc_id go together."""
    return f"md5(concat('{seed}:', CAST(whole AS STRING), ':', coalesce(CAST(doc_id AS STRING), 'null')))"


def plan(sized: DataFrame, share: float = SHARE, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """domain, lang, source, tokens, budget, whole, rest, upto: for each leaf the number of whole epochs and the last order key that the partial epoch takes (null: none).

    Its rows are as many as the tree has leaves. Within a leaf the prefix is found by the sums of hash ranges first and
    then inside a range, so no leaf is gathered in one task.
    """
    spark = sized.sparkSession
    leaves = sized.groupBy("domain", "lang", "source").agg(F.sum("n_tokens").alias("tokens"))
    leaf = _util.materialize(spark.sql(plan_sql("{leaves}", share, epochs), leaves=leaves), 1)
    keys = ["domain", "lang", "source"]
    ordered = sized.join(_near(leaf.where("rest > 0").select(*keys, "whole", "rest")), keys).withColumn("key", F.expr(_order(seed))).select(*keys, "rest", "key", "n_tokens", F.substring("key", 1, DIGITS).alias("range"))
    ranges = ordered.groupBy(*keys, "range").agg(F.sum("n_tokens").alias("n"))
    ranges = ranges.selectExpr(*keys, "range", f"sum(n) OVER (PARTITION BY {', '.join(keys)} ORDER BY range) - n AS before")
    summed = ordered.join(ranges, [*keys, "range"]).selectExpr(*keys, "key", "rest", f"before + sum(n_tokens) OVER (PARTITION BY {', '.join(keys)}, range ORDER BY key) AS upto_here")
    upto = summed.where("upto_here <= rest").groupBy(*keys).agg(F.max("key").alias("upto"))
    return _util.materialize(leaf.join(upto, keys, "left"), 1)


def select(rows: DataFrame, planned: DataFrame, seed: int = SEED) -> DataFrame:
    """Rows (with doc_id, domain, lang, source) that the plan takes, once for each epoch, with `epoch` and `budget`."""
    keys = ["domain", "lang", "source"]
    with_plan = rows.join(_near(planned.select(*keys, "budget", "whole", "upto")), keys)
    taken = with_plan.withColumn("_n", F.expr(f"CAST(whole AS INT) + CASE WHEN upto IS NOT NULL AND {_order(seed)} <= upto THEN 1 ELSE 0 END")).where("_n > 0")
    return taken.withColumn("epoch", F.explode(F.expr("sequence(0, _n - 1)"))).drop("_n", "whole", "upto")


def mix(docs: DataFrame, share: float = SHARE, epochs: int = EPOCHS, seed: int = SEED, domain: str = DOMAIN) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens, epoch, budget: the chosen documents, one row for each epoch that takes them.

    share: tokens to choose, of those there are; epochs: how often a document is taken at most. Repeated rows each count;
    texts without words are taken with every whole epoch and wherever the prefix passes them. Empty tables give no rows.
    """
    sized = _util.materialize(sizes(docs, domain))
    return select(sized, plan(sized, share, epochs, seed), seed).select("doc_id", "domain", "lang", "source", "n_tokens", "epoch", "budget")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, mixed to the target weights."""
    return mix(_util.table(spark, sf_dir, "documents"))


_DOMAIN_DUCK = "coalesce((['web', 'books', 'forums', 'reference'])[try_cast(regexp_extract(source, '([0-9]+)$', 1) AS INT) % 4 + 1], 'other')"
OP7_SQL = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
sized AS (SELECT doc_id, {_DOMAIN_DUCK} AS domain, lang, source, len(regexp_extract_all(text, '[^ \\t-\\r]+'))::BIGINT AS n_tokens FROM docs),
leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens FROM sized GROUP BY ALL),
planned AS ({plan_sql("leaves", SHARE, EPOCHS)}),
ordered AS (SELECT s.*, p.budget, p.whole, p.rest, md5('{SEED}:' || p.whole || ':' || coalesce(s.doc_id::VARCHAR, 'null')) AS key FROM sized s JOIN planned p USING (domain, lang, source)),
summed AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key) AS upto_here FROM ordered),
upto AS (SELECT domain, lang, source, max(key) AS upto FROM summed WHERE rest > 0 AND upto_here <= rest GROUP BY ALL),
taken AS (SELECT o.*, (o.whole + CASE WHEN u.upto IS NOT NULL AND o.key <= u.upto THEN 1 ELSE 0 END)::INT AS n FROM ordered o LEFT JOIN upto u USING (domain, lang, source))
SELECT doc_id, domain, lang, source, n_tokens, e.epoch::INT AS epoch, budget FROM taken, LATERAL (SELECT unnest(range(0, n)) AS epoch) e
"""
