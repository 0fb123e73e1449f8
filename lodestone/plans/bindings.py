
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores, text
from ..functions.fingerprint import fingerprint, fnv1a
from ..functions.similarity import name_similarity
from ..operators import battery, drift, graph, groups, pairs, sets
from ..sources.tables import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


_CLONES = "least(1.0::DOUBLE, 0.25 + 0.20 * least(tokens / 40.0, 1.0) + 0.175 * greatest(0.0, least(1.0, (n - 2) / 3.0)) + CASE WHEN same_name THEN 0.20 ELSE 0 END + CASE WHEN same_dir THEN 0.05 ELSE 0 END)::DOUBLE"
_WORDS = "len(regexp_extract_all(text, '\\S+'))"
_NORMAL = "trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g'))"


def _clones_sql(body: str) -> str:
    return f"""
WITH g AS (SELECT sha256({body}) AS digest, count(*) AS n, min({_WORDS})::BIGINT AS tokens, min(source) = max(source) AS same_name, min(lang) = max(lang) AS same_dir,
  array_to_string(list_sort(list(DISTINCT source)), '/') AS label, min(doc_id) AS first
  FROM documents WHERE {_WORDS} >= 24 GROUP BY {body} HAVING count(*) > 1)
SELECT digest, round({_CLONES}, 6) AS score, n, tokens, label, first FROM g"""


@query(_clones_sql("text"))
def clones_documents(spark: SparkSession, sf: str) -> DataFrame:
    """A2, T1."""
    return groups.copies(table(spark, sf, "documents"), "text", "source", "lang", F.expr("regexp_count(text, '\\\\S+')"), "doc_id")


@query(f"""
WITH g AS (SELECT {_NORMAL} AS body, count(*) AS n, min(doc_id) AS first, count(DISTINCT text) AS spellings FROM documents GROUP BY 1 HAVING count(*) > 1)
SELECT sha256(body) AS digest, n, first, spellings FROM g""")
def doc_cluster_documents(spark: SparkSession, sf: str) -> DataFrame:
    """A3 (doc view), X6."""
    d = table(spark, sf, "documents").select("doc_id", F.sha2(text.normalize_doc(F.col("text")), 256).alias("digest"), F.sha2("text", 256).alias("spelling"))
    return d.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.countDistinct("spelling").alias("spellings")).where("n > 1")


_NEAR_EDGES = """
part_x AS (SELECT p_type, p_size, p_partkey AS k, split_part(p_name, ' ', 1) AS l1, split_part(p_name, ' ', 2) AS l2, p_brand AS l3 FROM part),
bucket AS (SELECT p_type, p_size FROM part_x GROUP BY ALL HAVING count(*) BETWEEN 2 AND 12),
edge AS (SELECT a.p_type, a.p_size, a.k AS a, b.k AS b, ((a.l1 IS DISTINCT FROM b.l1)::INT + (a.l2 IS DISTINCT FROM b.l2)::INT + (a.l3 IS DISTINCT FROM b.l3)::INT) AS diffs
  FROM part_x a JOIN part_x b ON a.p_type = b.p_type AND a.p_size = b.p_size AND a.k < b.k JOIN bucket t ON t.p_type = a.p_type AND t.p_size = a.p_size),
e AS (SELECT *, row_number() OVER (ORDER BY diffs, a, b) AS r FROM edge WHERE diffs BETWEEN 1 AND 2)"""


@query(f"""
WITH RECURSIVE {_NEAR_EDGES},
two AS (SELECT r, a AS x, b AS y, p_type, p_size FROM e UNION ALL SELECT r, b, a, p_type, p_size FROM e),
walk(r, goal, node) AS (SELECT r, b, a FROM e UNION SELECT w.r, w.goal, t.y FROM walk w JOIN two t ON t.x = w.node AND t.r < w.r),
comp(start, node) AS (SELECT x, x FROM two UNION SELECT c.start, t.y FROM comp c JOIN two t ON t.x = c.node),
size AS (SELECT start, count(*) AS family FROM comp GROUP BY start)
SELECT e.p_type, e.p_size, e.a, e.b, e.diffs, s.family::INT AS family FROM e JOIN size s ON s.start = e.a WHERE NOT EXISTS (SELECT 1 FROM walk w WHERE w.r = e.r AND w.node = w.goal)""")
def near_clones_part(spark: SparkSession, sf: str) -> DataFrame:
    """J7, G4, W5."""
    p = table(spark, sf, "part").withColumn("l1", F.split_part("p_name", F.lit(" "), F.lit(1))).withColumn("l2", F.split_part("p_name", F.lit(" "), F.lit(2)))
    return pairs.near_copies(p, ["p_type", "p_size"], ["l1", "l2", "p_brand"], "p_partkey")


@query()
def near_clones_all_part(spark: SparkSession, sf: str) -> DataFrame:
    """J7, G4 over buckets of any size, also those that near_clones_part leaves out by W5. The SQL walks every path below an edge, too slow there, so a test has brute force."""
    p = table(spark, sf, "part").withColumn("l1", F.split_part("p_name", F.lit(" "), F.lit(1))).withColumn("l2", F.split_part("p_name", F.lit(" "), F.lit(2)))
    return pairs.near_copies_all(p, ["p_type", "p_size"], ["l1", "l2", "p_brand"], "p_partkey")


@query("SELECT p_type, p_size, count(*) AS size FROM part GROUP BY ALL HAVING count(*) > 12")
def near_clones_oversized(spark: SparkSession, sf: str) -> DataFrame:
    """The buckets that the comparison reports instead."""
    return pairs.oversized(table(spark, sf, "part"), ["p_type", "p_size"])


@query("""
WITH x AS (SELECT p_type, p_brand, p_partkey AS k, string_split(lower(replace(p_name, ' ', '_')), '_') AS words, p_size > 25 AS pub, p_size % 5 AS m FROM part),
each AS (SELECT p_type, p_brand, k, words, pub, m, unnest(list_distinct([w for w in words if length(w) > 1])) AS word FROM x),
g AS (SELECT p_type, p_brand, word, count(*) AS n, avg(pub::INT) AS share, count(DISTINCT m) AS mods, bool_and(words[1] = word) OR bool_and(words[len(words)] = word) AS "positional", list_sort(list(k)) AS ks FROM each GROUP BY ALL HAVING count(*) >= 2),
kept AS (SELECT * FROM g WHERE NOT EXISTS (SELECT 1 FROM g h WHERE h.p_type = g.p_type AND h.p_brand = g.p_brand AND h.word <> g.word AND (h.n > g.n OR (h.n = g.n AND h.word < g.word)) AND list_has_all(h.ks, g.ks)))
SELECT p_type, p_brand, word, n, "positional", round(greatest(0.0, least(1.0, 0.28 + 0.22 * greatest(0, least(1, (n - 2) / 3.0)) + 0.14 * share + 0.16 * greatest(0, least(1, (mods - 1) / 2.0)) + CASE WHEN "positional" THEN 0.10 ELSE 0 END + 0.15 - CASE WHEN n >= 6 THEN 0.25 ELSE 0 END)), 6)::DOUBLE AS score FROM kept""")
def newtype_concepts_part(spark: SparkSession, sf: str) -> DataFrame:
    """A3, C10, G6, X1, X5."""
    return groups.word_concepts(table(spark, sf, "part"), ["p_type", "p_brand"], F.replace("p_name", F.lit(" "), F.lit("_")), "p_partkey", F.expr("p_size > 25"), F.expr("p_size % 5"))


@query("""
WITH s AS (SELECT user_id, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS name, list_sort(list(DISTINCT event_type)) AS m FROM events WHERE value > 150 GROUP BY user_id HAVING count(DISTINCT event_type) >= 3),
c AS (SELECT name, m, count(*) AS owners FROM s GROUP BY ALL)
SELECT a.name AS set_a, b.name AS set_b, a.owners AS owners_a, b.owners AS owners_b, round(len(list_intersect(a.m, b.m)) / (len(a.m) + len(b.m) - len(list_intersect(a.m, b.m)))::DOUBLE, 6) AS similarity
FROM c a JOIN c b ON a.name < b.name WHERE len(list_intersect(a.m, b.m)) / (len(a.m) + len(b.m) - len(list_intersect(a.m, b.m)))::DOUBLE >= 0.6""")
def enum_shape_users(spark: SparkSession, sf: str) -> DataFrame:
    """J10, U3."""
    return groups.shape_pairs(table(spark, sf, "events").where("value > 150"), "user_id", F.col("event_type"))


@query("""
WITH p AS (SELECT DISTINCT p_type, p_brand FROM part WHERE p_size < 5), t AS (SELECT DISTINCT p_type FROM p), n AS (SELECT count(*) AS total FROM t), h AS (SELECT p_brand, count(*) AS present FROM p GROUP BY 1)
SELECT p_brand AS callee, present, total - present AS absent, present > total - present AND total > present AS diverges, coalesce((SELECT string_agg(p_type, ',' ORDER BY p_type) FROM t WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.p_type = t.p_type AND p.p_brand = h.p_brand)), '') AS missing FROM h, n""")
def cohort_matrix_brand(spark: SparkSession, sf: str) -> DataFrame:
    """A9."""
    return groups.presence_matrix(table(spark, sf, "part").where("p_size < 5"), "p_type", "p_brand")


@query("""
SELECT user_id, count(*) FILTER (event_type = 'error' AND value > 120) AS a_hits, count(*) FILTER (event_type = 'purchase' AND value > 120) AS b_hits,
  CASE WHEN count(*) FILTER (event_type = 'purchase' AND value > 120) = 0 THEN 'A-only' WHEN count(*) FILTER (event_type = 'error' AND value > 120) = 0 THEN 'B-only' ELSE 'both' END AS side
FROM events GROUP BY user_id HAVING count(*) FILTER (event_type IN ('error', 'purchase') AND value > 120) > 0""")
def co_call_users(spark: SparkSession, sf: str) -> DataFrame:
    """J16."""
    return groups.one_side_or_both(table(spark, sf, "events"), "user_id", F.expr("event_type = 'error' AND value > 120"), F.expr("event_type = 'purchase' AND value > 120"))


@query("""
WITH x AS (SELECT o_custkey AS owner, CASE WHEN o_totalprice > 1000 THEN o_orderstatus END AS status, o_orderpriority AS priority, year(o_orderdate) AS y FROM orders),
g AS (SELECT owner, count(*) AS sites, count(DISTINCT coalesce(status, '?') || chr(1) || coalesce(priority, '?')) AS configs, count(DISTINCT y) AS mods,
  count(status) >= 2 AND min(status) = max(status) AS a1, count(status) >= 2 AND min(status) <> max(status) AS d1, count(priority) >= 2 AND min(priority) = max(priority) AS a2, count(priority) >= 2 AND min(priority) <> max(priority) AS d2 FROM x GROUP BY owner),
h AS (SELECT *, a1::INT + a2::INT AS agreed, d1::INT + d2::INT AS differing FROM g WHERE sites > 1 AND (d1 OR d2)),
s AS (SELECT *, (0.4 + 0.6 * agreed / (agreed + differing)::DOUBLE) / sqrt(differing) / greatest(configs - 1, 1) * mods / sites AS sc FROM h)
SELECT owner, sites, configs, agreed, differing, array_to_string([f for f in [CASE WHEN d1 THEN 'status' END, CASE WHEN d2 THEN 'priority' END] if f IS NOT NULL], ',') AS differs, round(sc, 6) AS score FROM s WHERE sc >= 0.05""")
def config_drift_orders(spark: SparkSession, sf: str) -> DataFrame:
    """A5: a status below a price abstains."""
    o = table(spark, sf, "orders").select("o_custkey", F.expr("CASE WHEN o_totalprice > 1000 THEN o_orderstatus END").alias("status"), F.col("o_orderpriority").alias("priority"), "o_orderdate")
    return drift.config_drift(o, "o_custkey", ["status", "priority"], F.year("o_orderdate"))


@query("""
WITH c AS (SELECT user_id, date_trunc('day', ts)::DATE AS day, list(DISTINCT event_type) AS m FROM events GROUP BY ALL),
t AS (SELECT user_id, count(*) AS chains, arg_min(day, (len(m), day)) AS leanest, arg_max(day, (len(m), -epoch(day))) AS richest FROM c GROUP BY 1 HAVING count(*) > 1),
st AS (SELECT user_id, method, count(*) AS n FROM (SELECT user_id, unnest(m) AS method FROM c) GROUP BY ALL),
g AS (SELECT t.user_id, chains, leanest, richest, count(*) FILTER (n = chains) AS shared, count(*) FILTER (n < chains) AS diff, coalesce(string_agg(method, ',' ORDER BY method) FILTER (n < chains), '') AS differs FROM st JOIN t USING (user_id) GROUP BY ALL)
SELECT user_id, chains, shared, differs, leanest, richest, round((0.4 + 0.6 * shared / (shared + diff)::DOUBLE) / sqrt(diff) * 0.35, 6) AS score FROM g WHERE diff > 0""")
def builder_drift_users(spark: SparkSession, sf: str) -> DataFrame:
    """A user's days are chains of event types."""
    e = table(spark, sf, "events").select("user_id", F.to_date("ts").alias("day"), F.col("event_type").alias("method"))
    return drift.builder_drift(e, "user_id", "day")


@query("""
SELECT l_suppkey, l_returnflag, count(*) FILTER (l_discount > 0) AS checked, count(*) FILTER (NOT l_discount > 0) AS raw, round(count(*) FILTER (l_discount > 0) / count(*)::DOUBLE, 6) AS score
FROM lineitem GROUP BY ALL HAVING count(*) FILTER (l_discount > 0) >= 2 AND count(*) FILTER (NOT l_discount > 0) >= 1 AND count(*) FILTER (l_discount > 0) / count(*)::DOUBLE >= 0.6""")
def arith_drift_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    """A7."""
    return drift.ratio_groups(table(spark, sf, "lineitem"), ["l_suppkey", "l_returnflag"], F.expr("l_discount > 0"), 0.6)


@query("""
WITH s AS (SELECT l_suppkey, l_returnflag, l_discount > 0 AS ok, l_orderkey * 10 + l_linenumber AS id, epoch(l_shipdate)::BIGINT AS "at" FROM lineitem),
r AS (SELECT * FROM s WHERE NOT ok), c AS (SELECT l_suppkey, l_returnflag, "at", min(id) AS id FROM s WHERE ok GROUP BY ALL),
p AS (SELECT r.l_suppkey, r.l_returnflag, r.id, r."at", c."at" AS near_at, c.id AS near_id FROM r ASOF JOIN c ON r.l_suppkey = c.l_suppkey AND r.l_returnflag = c.l_returnflag AND r."at" >= c."at"),
q AS (SELECT r.l_suppkey, r.l_returnflag, r.id, r."at", c."at" AS near_at, c.id AS near_id FROM r ASOF JOIN c ON r.l_suppkey = c.l_suppkey AND r.l_returnflag = c.l_returnflag AND r."at" <= c."at"),
u AS (SELECT * FROM p UNION ALL SELECT * FROM q)
SELECT l_suppkey, l_returnflag, id, "at", near_at, near_id FROM u QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_returnflag, id, "at" ORDER BY abs("at" - near_at), near_at) = 1""")
def nearest_witness_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    """For each raw site the nearest checked one of its group by ship date, either way."""
    s = table(spark, sf, "lineitem").select("l_suppkey", "l_returnflag", F.expr("l_discount > 0").alias("ok"), F.expr("l_orderkey * 10 + l_linenumber").alias("id"), F.unix_seconds(F.col("l_shipdate").cast("timestamp")).alias("at"))
    return pairs.nearest(s.where("NOT ok"), s.where("ok"), ["l_suppkey", "l_returnflag"], "at", "id")


_URGENT = "o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'"


@query(f"""
WITH x AS (SELECT c_custkey, c_nationkey, c_mktsegment, c_custkey IN (SELECT o_custkey FROM orders WHERE {_URGENT} AND o_totalprice > 200000) AS ok FROM customer),
e AS (SELECT c_custkey AS key, ok, 'c_nationkey+c_mktsegment/' || c_nationkey || '/' || c_mktsegment AS cohort FROM x UNION ALL SELECT c_custkey, ok, 'c_nationkey/' || c_nationkey FROM x),
g AS (SELECT cohort, count(*) FILTER (ok) AS c, count(*) FILTER (NOT ok) AS u FROM e GROUP BY 1 HAVING bool_or(ok) AND NOT bool_and(ok)),
s AS (SELECT *, round(greatest(0.0, least(1.0, 0.25 + 0.45 * c / (c + u)::DOUBLE + 0.30 * greatest(0, least(1, (c - 1) / 3.0)) - CASE WHEN c + u >= 6 THEN 0.25 ELSE 0 END)), 6)::DOUBLE AS score FROM g)
SELECT key, cohort, c AS checked_siblings, c + u AS size, score FROM e JOIN s USING (cohort) WHERE NOT ok AND score >= 0.1 QUALIFY row_number() OVER (PARTITION BY key ORDER BY score DESC, cohort DESC) = 1""")
def validation_drift_customers(spark: SparkSession, sf: str) -> DataFrame:
    """A8, W3."""
    ok = table(spark, sf, "orders").where(f"{_URGENT} AND o_totalprice > 200000").select("o_custkey").distinct().withColumn("_ok", F.lit(True))
    c = table(spark, sf, "customer").join(ok, F.col("c_custkey") == F.col("o_custkey"), "left")
    return drift.validation_drift(c, [["c_nationkey", "c_mktsegment"], ["c_nationkey"]], "c_custkey", F.coalesce("_ok", F.lit(False)), 0.1)


@query(f"SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE {_URGENT}) AND c_acctbal >= 0")
def dead_anti(spark: SparkSession, sf: str) -> DataFrame:
    """Customers without an urgent finished order; those in debt are exempt."""
    return sets.unused(table(spark, sf, "customer"), table(spark, sf, "orders").where(_URGENT).select("o_custkey"), "c_custkey", F.expr("c_acctbal < 0")).select("c_custkey", "c_mktsegment")


_NATION_EDGES = """flow AS (SELECT s_nationkey AS src, c_nationkey AS dst, sum(l_extendedprice) AS v FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
edge AS (SELECT src, dst FROM flow QUALIFY row_number() OVER (PARTITION BY src ORDER BY round(v, 2) DESC, dst) <= 2)"""


def _nation_edges(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window as W

    li = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice")
    flow = (
        li.join(table(spark, sf, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(F.col("s_nationkey").alias("src"), F.col("c_nationkey").alias("dst"))
        .agg(F.round(F.sum("l_extendedprice"), 2).alias("v"))
    )
    return flow.withColumn("_rn", F.row_number().over(W.partitionBy("src").orderBy(F.desc("v"), "dst"))).where("_rn <= 2").select("src", "dst")


@query(f"""
WITH RECURSIVE {_NATION_EDGES}, walk(node, depth) AS (SELECT 0, 0 UNION SELECT dst, depth + 1 FROM walk JOIN edge ON src = node WHERE depth < 30)
SELECT node, min(depth)::INT AS depth FROM walk GROUP BY node""")
def transitive_nations(spark: SparkSession, sf: str) -> DataFrame:
    """G1."""
    return graph.reach(_nation_edges(spark, sf), spark.sql("SELECT 0 AS node"))


@query("""
WITH RECURSIVE n AS (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst, value FROM events), edge AS (SELECT src, dst FROM n WHERE dst IS NOT NULL AND src <> dst GROUP BY ALL),
walk(node, depth) AS (SELECT 'signup', 0 UNION SELECT dst, depth + 1 FROM walk JOIN edge ON src = node WHERE depth < 3)
SELECT node, min(depth)::INT AS depth FROM walk GROUP BY node""")
def transitive_events(spark: SparkSession, sf: str) -> DataFrame:
    """G1 with a depth bound."""
    from pyspark.sql import Window as W

    e = table(spark, sf, "events").select(F.col("event_type").alias("src"), F.lead("event_type").over(W.partitionBy("user_id").orderBy("ts", "event_id")).alias("dst")).where("src <> dst")
    return graph.reach(e, spark.sql("SELECT 'signup' AS node"), 3)


@query("""
SELECT e.event_id, e.user_id, e.event_type FROM events e WHERE NOT EXISTS (SELECT 1 FROM events w WHERE w.event_type = 'error' AND w.user_id = e.user_id AND epoch(e.ts) BETWEEN epoch(w.ts) AND epoch(w.ts) + 60)""")
def interval_waiver(spark: SparkSession, sf: str) -> DataFrame:
    """An error opens a minute on its user in which nothing counts."""
    e = table(spark, sf, "events").withColumn("s", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return pairs.range_hits(e, e.where("event_type = 'error'"), "user_id", F.col("s"), F.col("s"), F.col("s") + 60, 60.0, "left_anti").select("event_id", "user_id", "event_type")


@query("""
WITH k AS (SELECT o_custkey, o_orderpriority, count(*) FILTER (o_orderdate >= TIMESTAMP '1998-01-01') AS a, count(*) FILTER (o_orderdate < TIMESTAMP '1998-01-01') AS b FROM orders GROUP BY ALL)
SELECT o_custkey, o_orderpriority, least(a, b) AS unchanged, greatest(a - b, 0) AS new, greatest(b - a, 0) AS gone FROM k""")
def baseline_orders(spark: SparkSession, sf: str) -> DataFrame:
    """U2, W6."""
    o = table(spark, sf, "orders")
    return sets.multiset_diff(o.where("o_orderdate >= timestamp'1998-01-01'"), o.where("o_orderdate < timestamp'1998-01-01'"), ["o_custkey", "o_orderpriority"])


@query("""
WITH a AS (SELECT o_custkey, o_orderstatus, o_orderkey, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) AS rn FROM orders WHERE year(o_orderdate) = 1998),
b AS (SELECT o_custkey, o_orderstatus, o_orderkey AS was, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) AS rn FROM orders WHERE year(o_orderdate) = 1997)
SELECT o_custkey, o_orderstatus, o_orderkey, was FROM a JOIN b USING (o_custkey, o_orderstatus, rn)""")
def moved_orders(spark: SparkSession, sf: str) -> DataFrame:
    """U2 (moved): new rows paired with gone ones of the same key."""
    o = table(spark, sf, "orders").select("o_custkey", "o_orderstatus", "o_orderkey", F.year("o_orderdate").alias("y"))
    return sets.moved(o.where("y = 1998").drop("y"), o.where("y = 1997").drop("y"), ["o_custkey", "o_orderstatus"], "o_orderkey")


def _status_sites(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").where("o_totalprice > 250000").groupBy(F.col("o_custkey").alias("site")).agg(F.array_sort(F.collect_set("o_orderstatus")).alias("variants")).withColumn("enum", F.lit("status"))


@query("""
WITH s AS (SELECT o_custkey AS site, list_sort(list(DISTINCT o_orderstatus)) AS v FROM orders WHERE o_totalprice > 250000 GROUP BY 1)
SELECT 'status' AS enum, site, len(v)::INT AS covered, 3 AS variants, array_to_string([x for x in ['F', 'O', 'P'] if NOT list_contains(v, x)], ',') AS missing, round(len(v) / 3.0, 6)::DOUBLE AS gap FROM s WHERE len(v) < 3""")
def enum_coverage_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Two definitions of one name; a site is held against the smallest that fits."""
    defs = spark.sql("SELECT * FROM VALUES ('status', 'own', array('F', 'O', 'P')), ('status', 'other', array('F', 'O', 'P', 'X')) AS t(enum, def_id, variants)")
    return sets.coverage(_status_sites(spark, sf), defs)


@query("""
WITH s AS (SELECT o_custkey AS site, list_sort(list(DISTINCT o_orderstatus)) AS v, count(*) > 10 AS wildcard FROM orders GROUP BY 1)
SELECT 'status' AS enum, array_to_string(v, ',') AS covers, wildcard, count(*) AS sites, min(site) AS first FROM s GROUP BY ALL""")
def parallel_sets_orders(spark: SparkSession, sf: str) -> DataFrame:
    """A10."""
    s = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("site")).agg(F.collect_set("o_orderstatus").alias("variants"), (F.count("*") > 10).alias("wildcard")).withColumn("enum", F.lit("status"))
    return sets.parallel_sets(s)


@query("""
WITH s AS (SELECT o_custkey % 7 AS file, o_custkey AS site, list_sort(list(DISTINCT o_orderstatus)) AS v FROM orders WHERE o_totalprice > 250000 GROUP BY ALL HAVING count(DISTINCT o_orderstatus) < 3),
c AS (SELECT file, v, min(site) AS site, count(*) AS n FROM s GROUP BY ALL),
p AS (SELECT a.file, a.v, a.site, a.n, [x for x in b.v if NOT list_contains(a.v, x)] AS miss, b.site AS rich, b.n AS rn, len(list_intersect(a.v, b.v)) / len(b.v)::DOUBLE / len([x for x in b.v if NOT list_contains(a.v, x)]) * CASE WHEN a.file = b.file THEN 1.0 ELSE 0.5 END AS sc
  FROM c a JOIN c b ON len(list_intersect(a.v, b.v)) > 0 AND len(b.v) >= len(a.v) AND len([x for x in b.v if NOT list_contains(a.v, x)]) > 0)
SELECT 'status' AS enum, site, n AS sites, array_to_string(v, ',') AS has, array_to_string(miss, ',') AS missing_here, round(sc, 6) AS score, rich AS vs, (sum(rn) OVER (PARTITION BY file, v, miss) - 1)::BIGINT AS more
FROM p WHERE sc >= 0.25 QUALIFY row_number() OVER (PARTITION BY file, v, miss ORDER BY sc DESC, rich) = 1""")
def divergence_orders(spark: SparkSession, sf: str) -> DataFrame:
    """C11, J8, W1."""
    s = _status_sites(spark, sf).where("size(variants) < 3").withColumn("file", F.expr("site % 7")).withColumn("ord", F.col("site"))
    return pairs.lean_and_rich(s)


@query("""
WITH x AS (SELECT user_id, event_type, event_id AS site, CASE WHEN value < 5 THEN 0 WHEN value < 20 THEN 1 WHEN value < 100 THEN 2 ELSE 3 END AS care FROM events), b AS (SELECT user_id, event_type, max(care) AS best, count(*) AS n FROM x GROUP BY ALL)
SELECT user_id, event_type, site, care, best, best - care AS gap, n - 1 AS siblings FROM x JOIN b USING (user_id, event_type) WHERE best - care >= 2""")
def handling_events(spark: SparkSession, sf: str) -> DataFrame:
    """J9, W2."""
    e = table(spark, sf, "events").select("user_id", "event_type", "event_id", F.expr("CASE WHEN value < 5 THEN 0 WHEN value < 20 THEN 1 WHEN value < 100 THEN 2 ELSE 3 END").alias("care"))
    return pairs.care_gaps(e, ["user_id", "event_type"], "event_id", "care")


@query("""
WITH f AS (SELECT r_name AS kind, s_nationkey AS a, c_nationkey AS b, max(l_orderkey) AS at FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE l_quantity > 49 AND l_discount > 0.08 GROUP BY ALL)
SELECT x.kind, x.a, x.b, x.at, y.at AS reverse_at FROM f x JOIN f y ON x.kind = y.kind AND x.a = y.b AND x.b = y.a AND x.a < x.b""")
def conversion_pairs_nations(spark: SparkSession, sf: str) -> DataFrame:
    """J6."""
    t = {n: table(spark, sf, n) for n in ("lineitem", "supplier", "orders", "customer", "nation", "region")}
    f = t["lineitem"].where("l_quantity > 49 AND l_discount > 0.08").join(t["supplier"], F.expr("l_suppkey = s_suppkey")).join(t["orders"], F.expr("l_orderkey = o_orderkey")).join(t["customer"], F.expr("o_custkey = c_custkey")).join(t["nation"], F.expr("s_nationkey = n_nationkey")).join(t["region"], F.expr("n_regionkey = r_regionkey"))
    return pairs.mutual(f.select(F.col("r_name").alias("kind"), "s_nationkey", "c_nationkey", "l_orderkey"), ["kind"], "s_nationkey", "c_nationkey", "l_orderkey")


@query("SELECT event_type, user_id % 10 AS bucket, count(*) AS n, grouping(event_type, user_id % 10)::BIGINT AS level FROM events GROUP BY ROLLUP (event_type, user_id % 10)")
def grouped_counts_events(spark: SparkSession, sf: str) -> DataFrame:
    """A1 and its rollup."""
    return groups.grouped_counts(table(spark, sf, "events").select("event_type", F.expr("user_id % 10").alias("bucket")), ["event_type", "bucket"])


@query("""
WITH g AS (SELECT l_suppkey, count(*) AS lines, sum(l_quantity)::BIGINT AS quantity, count(DISTINCT l_partkey) AS parts, max(l_linenumber) AS depth FROM lineitem GROUP BY 1 HAVING count(*) >= 15)
SELECT * FROM g ORDER BY quantity DESC, l_suppkey LIMIT 20""")
def metrics_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Measures by owner above a threshold, the first twenty."""
    g = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("lines"), F.sum("l_quantity").cast("long").alias("quantity"), F.countDistinct("l_partkey").alias("parts"), F.max("l_linenumber").alias("depth"))
    return g.where("lines >= 15").orderBy(F.desc("quantity"), "l_suppkey").limit(20)


@query("""
WITH r AS (SELECT p_brand, p_type, p_size, p_partkey FROM part WHERE p_type IS NOT NULL AND p_brand <> 'Brand#11')
SELECT p_brand, count(*) AS n, count(*) FILTER (p_size > 10) AS code, count(*) FILTER (NOT p_size > 10) AS doc, min(p_partkey) AS first FROM r GROUP BY 1""")
def module_uses_part(spark: SparkSession, sf: str) -> DataFrame:
    """References from outside a module, split by kind, with the first site."""
    r = table(spark, sf, "part").where("p_type IS NOT NULL AND p_brand <> 'Brand#11'")
    return r.groupBy("p_brand").agg(F.count("*").alias("n"), F.count(F.when(F.expr("p_size > 10"), 1)).alias("code"), F.count(F.when(F.expr("NOT p_size > 10"), 1)).alias("doc"), F.min("p_partkey").alias("first"))


_FNV = "list_reduce([14695981039346656037::UHUGEINT] || [ord(c)::UHUGEINT for c in string_split(p_name, '')], lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)"


@query(f"SELECT p_partkey, lower(lpad(to_hex(({_FNV})::UBIGINT), 16, '0')) AS hash FROM part")
def fingerprint_rows(spark: SparkSession, sf: str) -> DataFrame:
    """X10, C9."""
    return table(spark, sf, "part").select("p_partkey", fnv1a(F.col("p_name")).alias("hash"))


@query()
def finding_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    """Identity cells only, so equal parts at other places share one."""
    p = table(spark, sf, "part")
    return p.select("p_partkey", fingerprint(F.lit("part"), [F.col("p_brand"), F.col("p_type")], F.concat(F.col("p_name"), F.lit(":"), F.col("p_partkey"))).alias("fp"))


@query()
def similar_names(spark: SparkSession, sf: str) -> DataFrame:
    """The six names nearest to a query; each name is compared once."""
    names = table(spark, sf, "part").groupBy("p_name").agg(F.min("p_partkey").alias("first"))
    return names.withColumn("similarity", F.round(name_similarity(F.col("p_name"), F.lit("green steel")), 6)).where("similarity >= 0.3").orderBy(F.desc("similarity"), "p_name").limit(6)


@query("""
WITH c AS (SELECT l_suppkey AS name, o_custkey AS caller, o_custkey % 9 AS module FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
u AS (SELECT name, count(DISTINCT caller) AS callers, count(DISTINCT module) AS modules FROM c GROUP BY 1 HAVING count(DISTINCT caller) >= 3)
SELECT s_suppkey AS name, callers, modules, round(least(callers / 12.0, 1) * 0.35 * t + least((modules - 1) / 4.0, 1) * 0.25 * t + least((s_nationkey + 1) / 80.0, 1) * 0.20 + CASE WHEN s_acctbal < 0 THEN 0.12 ELSE 0 END + CASE WHEN s_acctbal > 5000 THEN 0.08 ELSE 0 END, 6)::DOUBLE AS score
FROM (SELECT *, CASE WHEN s_suppkey % 2 = 0 THEN 1.0 ELSE 0.5 END AS t FROM supplier) JOIN u ON name = s_suppkey""")
def contract_candidates_suppliers(spark: SparkSession, sf: str) -> DataFrame:
    """A13."""
    fns = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("name"), F.expr("s_nationkey + 1").alias("loc"), F.expr("CASE WHEN s_acctbal < 0 THEN 'Result' ELSE 'value' END").alias("ret"), F.expr("s_suppkey % 2 = 0").alias("free"), F.expr("NOT s_acctbal > 5000").alias("documented"))
    calls = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.expr("l_orderkey = o_orderkey")).select(F.col("l_suppkey").alias("callee"), F.col("o_custkey").alias("caller"), F.expr("o_custkey % 9").alias("module"))
    return battery.contract_candidates(fns, calls)


@query("""
WITH x AS (SELECT p_partkey AS id, unnest([f for f in [CASE WHEN l_discount > 0.05 THEN 'ret:bound' END, CASE WHEN l_quantity > 45 THEN 'arg1:literal' END, CASE WHEN l_returnflag = 'R' THEN 'env:loop' END] if f IS NOT NULL]) AS fact, l_suppkey AS caller, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey),
k AS (SELECT p_brand, fact, caller, count(*) AS n FROM x GROUP BY ALL), c AS (SELECT *, row_number() OVER (PARTITION BY p_brand, fact ORDER BY caller) AS rn FROM k)
SELECT p_brand, fact, sum(n)::BIGINT AS sites, count(*) AS callers, string_agg(caller::VARCHAR, ',' ORDER BY caller::VARCHAR) FILTER (rn <= 3) AS detail FROM c GROUP BY ALL""")
def contract_usage_brands(spark: SparkSession, sf: str) -> DataFrame:
    """C7, A12."""
    li = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.expr("l_partkey = p_partkey"))
    return drift.usage_facts(li, "p_brand", "l_suppkey", {"ret:bound": F.expr("l_discount > 0.05"), "arg1:literal": F.expr("l_quantity > 45"), "env:loop": F.expr("l_returnflag = 'R'")})


@query("""
WITH p AS (SELECT doc_id AS id, source AS file, 1 + length(text) - length(replace(text, chr(10), '')) AS n, text FROM documents), l AS (SELECT id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM p)
SELECT f.id, f.no AS finding, l.no AS line_no, length(l.line)::INT AS chars FROM l f JOIN l ON l.id = f.id AND l.no BETWEEN f.no - 1 AND f.no + 1 WHERE f.line ILIKE '%licens%'""")
def snippet_join(spark: SparkSession, sf: str) -> DataFrame:
    """The lines around each finding; a line meets the three findings it can be near to by an equi-join on the line number."""
    lines = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.posexplode(F.split("text", "\n")).alias("no", "line")).withColumn("no", F.col("no") + 1)
    near = lines.where("line ILIKE '%licens%'").select("id", F.col("no").alias("finding"), F.explode(F.expr("sequence(no - 1, no + 1)")).alias("no"))
    return near.join(lines, ["id", "no"]).select("id", F.col("finding").cast("long").alias("finding"), F.col("no").cast("long").alias("line_no"), F.length("line").alias("chars"))


_SWALLOW = "least(1.0, CASE WHEN o_orderpriority LIKE '5%' THEN 0.0 ELSE CASE o_orderstatus WHEN 'F' THEN 0.60 WHEN 'O' THEN 0.35 ELSE 0.20 END + CASE WHEN o_totalprice > 300000 THEN 0.20 ELSE 0.0 END END + CASE o_orderpriority WHEN '1-URGENT' THEN 0.30 WHEN '2-HIGH' THEN 0.20 ELSE 0.05 END)"


@query(f"SELECT o_orderkey, round({_SWALLOW}, 6)::DOUBLE AS score FROM orders WHERE {_SWALLOW} >= 0.55 - 1e-9")
def error_swallows_orders(spark: SparkSession, sf: str) -> DataFrame:
    """F19, F25."""
    kind = F.expr("CASE o_orderpriority WHEN '1-URGENT' THEN 'let-_' WHEN '2-HIGH' THEN '.ok' ELSE 'map_err' END")
    effect = F.expr("CASE o_orderstatus WHEN 'F' THEN 'mutation' WHEN 'O' THEN 'io' ELSE 'unknown' END")
    s = scores.error_swallows(kind, effect, F.expr("o_orderpriority LIKE '5%'"), F.expr("o_totalprice > 300000"))
    return table(spark, sf, "orders").select("o_orderkey", F.round(s, 6).alias("score")).where("score >= 0.55D - 1e-9D")


@query("""
WITH i AS (SELECT p_partkey AS item, p_type || '/' || p_size AS cluster, CASE WHEN p_retailprice > 1700 THEN p_brand END AS concept FROM part), g AS (SELECT cluster, count(concept) AS n, max(concept) AS c FROM i GROUP BY 1)
SELECT cluster, c AS concept, item FROM i JOIN g USING (cluster) WHERE n = 1 AND i.concept IS NULL""")
def vocabulary_part(spark: SparkSession, sf: str) -> DataFrame:
    """Clusters of which exactly one member declares a concept."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("item"), F.expr("concat(p_type, '/', p_size)").alias("cluster"), F.expr("CASE WHEN p_retailprice > 1700 THEN p_brand END").alias("concept"))
    return sets.declared_once(p.where("concept IS NOT NULL").select("item", "concept"), p.select("cluster", "item"))


@query("""
WITH p AS (SELECT p_partkey AS id, p_name AS name, p_brand || p_size AS shape, p_type || p_brand AS signature FROM part), q AS (SELECT 'green steel' AS name, 'Brand#1212' AS shape, 'STANDARDBrand#12' AS signature UNION ALL SELECT (SELECT min(name) FROM p), (SELECT min(shape) FROM p), (SELECT min(signature) FROM p))
SELECT q.name AS proposed, 'same name' AS why, 'collide' AS verdict, count(*) AS hits, min(p.id) AS existing FROM q JOIN p ON p.name = q.name GROUP BY 1
UNION ALL SELECT q.name, 'same shape', 'warn', count(*), min(p.id) FROM q JOIN p ON p.shape = q.shape GROUP BY 1
UNION ALL SELECT q.name, 'same signature', 'warn', count(*), min(p.id) FROM q JOIN p ON p.signature = q.signature GROUP BY 1""")
def gate_part(spark: SparkSession, sf: str) -> DataFrame:
    """A proposal held against the corpus."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.expr("concat(p_brand, p_size)").alias("shape"), F.expr("concat(p_type, p_brand)").alias("signature"), F.lit(None).cast("string").alias("doc"), F.lit(None).cast("string").alias("body"))
    own = p.agg(F.min("name").alias("name"), F.min("shape").alias("shape"), F.min("signature").alias("signature"))
    q = spark.sql("SELECT 'green steel' AS name, 'Brand#1212' AS shape, 'STANDARDBrand#12' AS signature").unionByName(own).withColumn("doc", F.lit(None).cast("string")).withColumn("body", F.lit(None).cast("string"))
    return battery.gate(q, p)


@query("""
WITH w AS (SELECT s_suppkey, s_nationkey AS file, s_suppkey % 7 AS lo, s_suppkey % 7 + 3 AS hi, CASE WHEN s_suppkey % 3 = 0 THEN 'AUTOMOBILE' END AS chk, DATE '2024-01-01' + (s_suppkey % 50)::INT AS day FROM supplier),
f AS (SELECT c_nationkey AS file, c_custkey % 12 AS line, c_mktsegment AS chk FROM customer)
SELECT s_suppkey, (SELECT count(*) FROM f WHERE f.file = w.file AND f.line BETWEEN w.lo AND w.hi AND (w.chk IS NULL OR w.chk = f.chk)) AS suppresses, date_diff('day', day, DATE '2024-06-01')::INT AS age FROM w""")
def waiver_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """A15, C4."""
    w = table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("file"), F.expr("s_suppkey % 7").alias("lo"), F.expr("s_suppkey % 7 + 3").alias("hi"), F.expr("CASE WHEN s_suppkey % 3 = 0 THEN 'AUTOMOBILE' END").alias("check"), F.lit(None).cast("string").alias("key"), F.expr("date_add(DATE'2024-01-01', CAST(s_suppkey % 50 AS INT))").alias("date"))
    f = table(spark, sf, "customer").select(F.col("c_nationkey").alias("file"), F.expr("c_custkey % 12").alias("line"), F.col("c_mktsegment").alias("check"), F.lit(None).cast("string").alias("key"))
    return battery.ledger(w, f, F.expr("DATE'2024-06-01'")).select("s_suppkey", "suppresses", "age")


@query("""
WITH w AS (SELECT s_nationkey AS file, s_suppkey % 7 AS lo, s_suppkey % 7 + 1 AS hi, CASE WHEN s_suppkey % 3 = 0 THEN 'AUTOMOBILE' END AS chk FROM supplier WHERE s_suppkey % 4 = 0)
SELECT c_custkey FROM customer f WHERE NOT EXISTS (SELECT 1 FROM w WHERE f.c_nationkey = w.file AND f.c_custkey % 12 BETWEEN w.lo AND w.hi AND (w.chk IS NULL OR w.chk = f.c_mktsegment))""")
def waived_findings(spark: SparkSession, sf: str) -> DataFrame:
    """C3, J12, X18."""
    w = table(spark, sf, "supplier").where("s_suppkey % 4 = 0").select(F.col("s_nationkey").alias("file"), F.expr("s_suppkey % 7").alias("lo"), F.expr("s_suppkey % 7 + 1").alias("hi"), F.expr("CASE WHEN s_suppkey % 3 = 0 THEN 'AUTOMOBILE' END").alias("check"), F.lit(None).cast("string").alias("key"))
    f = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("file"), F.expr("c_custkey % 12").alias("line"), F.col("c_mktsegment").alias("check"), F.lit(None).cast("string").alias("key"))
    return battery.waive(f, w).select("c_custkey")


def _battery(spark: SparkSession, sf: str) -> DataFrame:
    clones = clones_documents(spark, sf).select("label", F.col("first").alias("site"), "score")
    arith = arith_drift_lineitem(spark, sf).select(F.col("l_returnflag").alias("label"), F.col("l_suppkey").alias("site"), "score")
    swallows = error_swallows_orders(spark, sf).select(F.lit("order").alias("label"), F.col("o_orderkey").alias("site"), "score")
    return battery.findings({"clones": clones, "arith-drift": arith, "error-swallows": swallows})


_BATTERY = f"""
f AS (SELECT 'clones' AS "check", label, first::VARCHAR AS site, score, 0.75 AS gate FROM ({_clones_sql("text")})
UNION ALL SELECT 'arith-drift', l_returnflag, l_suppkey::VARCHAR, score, 0.60 FROM ({{arith}})
UNION ALL SELECT 'error-swallows', 'order', o_orderkey::VARCHAR, score, 0.55 FROM ({{swallows}}))"""


@query("WITH " + _BATTERY.format(arith=ORACLES["arith_drift_lineitem"], swallows=ORACLES["error_swallows_orders"]) + """ SELECT "check", count(*) FILTER (score >= gate) AS gating, count(*) FILTER (NOT score >= gate) AS advisory FROM f GROUP BY 1""")
def audit_totals(spark: SparkSession, sf: str) -> DataFrame:
    """C1, U1, A16."""
    return battery.totals(_battery(spark, sf))


@query("WITH " + _BATTERY.format(arith=ORACLES["arith_drift_lineitem"], swallows=ORACLES["error_swallows_orders"]) + """, r AS (SELECT *, row_number() OVER (PARTITION BY "check" ORDER BY score DESC, site, label) AS rank, count(*) OVER (PARTITION BY "check") AS n FROM f)
SELECT "check", label, site, score, rank::INT AS rank, n AS "of" FROM r WHERE rank <= 5 OR round(score, 2) >= gate""")
def audit_capped(spark: SparkSession, sf: str) -> DataFrame:
    """Five rows of each check, and all that gate as printed."""
    return battery.rank_cap(_battery(spark, sf), 5).select("check", "label", "site", "score", "rank", "of")


@query("""
WITH RECURSIVE d AS (SELECT c_custkey AS name FROM customer), c AS (SELECT DISTINCT CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE o_custkey END AS caller, (o_custkey * 7 + 1) % 1500 AS target FROM orders WHERE o_totalprice > 400000),
r0 AS (SELECT name FROM d WHERE name NOT IN (SELECT target FROM c)),
r1 AS (SELECT name FROM d WHERE name NOT IN (SELECT target FROM c WHERE caller IS NULL OR caller NOT IN (SELECT name FROM r0)) AND name NOT IN (SELECT name FROM r0))
SELECT name, 0 AS round FROM r0 UNION ALL SELECT name, 1 FROM r1""")
def dead_two_rounds(spark: SparkSession, sf: str) -> DataFrame:
    """G2, bounded to two rounds so that plain SQL can check it."""
    calls = table(spark, sf, "orders").where("o_totalprice > 400000").select(F.expr("CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE o_custkey END").alias("caller"), F.expr("(o_custkey * 7 + 1) % 1500").alias("target"))
    return graph.transitively_unused(table(spark, sf, "customer").select(F.col("c_custkey").alias("name")), calls, 2)


@query()
def dead_customers(spark: SparkSession, sf: str) -> DataFrame:
    """G2 to its fixpoint over all orders, with targets spread over all customers. Recursive SQL can't subtract what it has found, so a test has brute force."""
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("name"))
    calls = table(spark, sf, "orders").crossJoin(F.broadcast(customers.agg(F.count("*").alias("n"))))
    calls = calls.select(F.expr("CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE o_custkey END").alias("caller"), F.expr("(CAST(o_custkey AS BIGINT) * o_custkey * o_custkey + 7 * o_custkey + 1) % n").alias("target"))
    return graph.transitively_unused(customers, calls, None)



@query("""
WITH w AS (SELECT list_sort(list(DISTINCT event_type)) AS v, user_id FROM events GROUP BY user_id) SELECT user_id, array_to_string(v, ',') AS kinds FROM w WHERE len(v) = 1 UNION ALL SELECT user_id, NULL FROM w WHERE len(v) > 1""")
def single_meaning_users(spark: SparkSession, sf: str) -> DataFrame:
    """X25 (ambiguous names have no answer)."""
    e = table(spark, sf, "events").select("user_id", "event_type")
    one = groups.only_definition(e, "user_id", "event_type")
    return e.select("user_id").distinct().join(one, "user_id", "left").select("user_id", F.col("event_type").alias("kinds"))
