"""Pair operators: near copies with spanning forests, lean and rich sets, mutual conversions, nearest witnesses."""

from __future__ import annotations

from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import scores
from ..sources.tables import materialize

#: Rows of a bucket up to which near_copies() compares it; larger ones are reported by oversized() and compared by near_copies_all().
BUCKET = 12
#: Sets of leaves that may be left out, up to which near_copies_all() goes by them.
SETS = 64


def _sized(df: DataFrame, skeleton: list[str]) -> DataFrame:
    sizes = df.groupBy(*skeleton).agg(F.count("*").alias("_size")).where("_size > 1")
    return df.join(sizes, skeleton)


def oversized(df: DataFrame, skeleton: list[str], bucket: int = BUCKET) -> DataFrame:
    """Buckets that near_copies() does not compare, with their sizes: never silent."""
    return df.groupBy(*skeleton).agg(F.count("*").alias("size")).where(F.col("size") > bucket)


def near_copies(df: DataFrame, skeleton: list[str], leaves: list[str], key: str, max_diff: int = 2, bucket: int = BUCKET) -> DataFrame:
    """Rows of one skeleton that differ in 1 to max_diff leaves, as a minimum spanning forest: skeleton, a, b, diffs, family.

    Edges rank by difference and keys, so the forest is unique; family is the size of its tree. Leaves are compared null-safely.
    A bucket has at most `bucket` rows, so a group handed to Python is small by construction.
    """
    small = _sized(df, skeleton).where(F.col("_size") <= bucket)
    x = small.select(*skeleton, F.col(key).alias("a"), F.array(*[F.col(c).cast("string") for c in leaves]).alias("_x"))
    y = small.select(*skeleton, F.col(key).alias("b"), F.array(*[F.col(c).cast("string") for c in leaves]).alias("_y"))
    delta = F.size(F.filter(F.zip_with("_x", "_y", lambda p, q: ~p.eqNullSafe(q)), lambda d: d))
    edges = x.join(y, skeleton).where("a < b").withColumn("diffs", delta).where(f"diffs BETWEEN 1 AND {max_diff}").select(*skeleton, "a", "b", "diffs")

    def forest(pdf: pd.DataFrame) -> pd.DataFrame:
        parent: dict = {}

        def root(n):
            while parent.setdefault(n, n) != n:
                parent[n] = n = parent[parent[n]]
            return n

        kept = []
        for k, (a, b) in zip(*(lambda s: (s.index, zip(s.a, s.b, strict=True)))(pdf.sort_values(["diffs", "a", "b"])), strict=True):
            p, q = root(a), root(b)
            if p != q:
                parent[q] = p
                kept.append(k)
        out = pdf.loc[kept].copy()
        size = pd.Series([root(n) for n in list(parent)]).value_counts()
        out["family"] = [int(size[root(a)]) for a in out.a]
        return out

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in edges.schema.fields) + ", family int"
    return edges.groupBy(*skeleton).applyInPandas(forest, schema)


def _class_links(classes: DataFrame, skeleton: list[str], n: int, max_diff: int) -> DataFrame:
    """Links between classes of rows with the same n leaves, among them all of their forest and of each class the least: skeleton, a, b, diffs and the classes ja, jb. classes: skeleton, j, a, _x."""
    left_out = [s for k in range(1, min(n, max_diff) + 1) for s in combinations(range(n), k)]
    delta = F.size(F.filter(F.zip_with("_x", "_y", lambda p, q: ~p.eqNullSafe(q)), lambda d: d))
    if len(left_out) <= SETS:
        agree = [F.array(*[F.when(F.lit(i not in s), F.get("_x", F.lit(i))) for i in range(n)]) for s in left_out]
    else:
        cuts = [n * i // (max_diff + 1) for i in range(max_diff + 2)]
        agree = [F.slice("_x", p + 1, q - p) for p, q in zip(cuts, cuts[1:], strict=False)]
    block = F.array(*[F.struct(F.lit(i).alias("i"), F.to_json(v, {"ignoreNullFields": "false"}).alias("v")) for i, v in enumerate(agree)])
    x = classes.withColumn("_block", F.explode(block))
    if len(left_out) <= SETS:
        y = x.groupBy(*skeleton, "_block").agg(F.min(F.struct("a", "j", "_x")).alias("_y")).select(*skeleton, "_block", F.col("_y.a").alias("b"), F.col("_y.j").alias("jb"), F.col("_y._x").alias("_y"))
    else:
        y = x.select(*skeleton, "_block", F.col("a").alias("b"), F.col("j").alias("jb"), F.col("_x").alias("_y"))
    met = x.join(y, [*skeleton, "_block"]).where("a < b" if len(left_out) > SETS else "a <> b").withColumn("diffs", delta).where(f"diffs BETWEEN 1 AND {max_diff}")
    return met.select(*skeleton, "a", "b", "diffs", F.col("j").alias("ja"), "jb").distinct()


def near_copies_all(df: DataFrame, skeleton: list[str], leaves: list[str], key: str, max_diff: int = 2) -> DataFrame:
    """near_copies() of buckets of any size, with the same columns and the same forest by difference and keys.

    Rows with the same leaves are one class, for which its least key stands. As edges rank by difference and keys, the forest takes an edge between two classes only from one
    of these keys, and each further key of a class takes the one edge to the key that stands for the nearest class, of these the least. Of classes that agree in all leaves but a
    few, the forest takes edges from the least key only, as any other is the last of the triangle with it. So the edges looked at grow with the rows, not with
    their pairs. Of many leaves, of which too many sets of a few can be left out, classes meet in one of max_diff + 1 blocks of leaves, in one of which they agree.

    The forest is Boruvka's: in each round every tree takes its least edge, which is unique as edges are ordered, and no bucket
    is gathered anywhere; a round at least halves the trees that can grow.
    """
    rows = df.select(*skeleton, F.col(key).alias("a"), F.array(*[F.col(c).cast("string") for c in leaves]).alias("_x")).dropna(subset=[*skeleton, "a"])
    rows = rows.withColumn("j", F.to_json("_x", {"ignoreNullFields": "false"})).dropDuplicates([*skeleton, "a", "j"])
    classes = materialize(rows.groupBy(*skeleton, "j").agg(F.min("a").alias("a"), F.first("_x").alias("_x")))
    links = materialize(_class_links(classes, skeleton, len(leaves), max_diff))
    ends = links.select(*skeleton, F.col("ja").alias("j"), "diffs", F.col("b").alias("to")).union(links.select(*skeleton, "jb", "diffs", "a"))
    near = classes.select(*skeleton, "j", F.col("a").alias("_least")).join(ends.groupBy(*skeleton, "j").agg(F.min(F.struct("diffs", "to")).alias("_near")), [*skeleton, "j"])
    # a key with several leaves is in several classes, and so no leaf of the forest
    again = rows.groupBy(*skeleton, "a").agg((F.count("*") > 1).alias("_again")).where("_again")
    further = rows.join(near, [*skeleton, "j"]).where("a <> _least AND a <> _near.to").join(again, [*skeleton, "a"], "left")
    further = materialize(further.select(*skeleton, "a", F.col("_near.to").alias("to"), F.col("_near.diffs").alias("diffs"), "_again"))
    edges = links.select(*skeleton, "a", "b", "diffs").union(further.where("_again").select(*skeleton, "a", "to", "diffs"))
    edges = materialize(edges.select(*skeleton, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "diffs").distinct())
    tree = materialize(edges.select(*skeleton, F.col("a").alias("node")).union(edges.select(*skeleton, "b")).distinct().withColumn("root", F.col("node")))
    kept = edges.limit(0)
    while True:
        ends = edges.join(tree.withColumnsRenamed({"node": "a", "root": "_p"}), [*skeleton, "a"]).join(tree.withColumnsRenamed({"node": "b", "root": "_q"}), [*skeleton, "b"]).where("_p <> _q")
        both = ends.select(*skeleton, "a", "b", "diffs", F.col("_p").alias("root"), F.col("_q").alias("to")).union(ends.select(*skeleton, "a", "b", "diffs", "_q", "_p"))
        least = materialize(both.groupBy(*skeleton, "root").agg(F.min(F.struct("diffs", "a", "b", "to")).alias("e")))
        if least.isEmpty():
            break
        kept = materialize(kept.unionByName(least.select(*skeleton, "e.a", "e.b", "e.diffs").distinct()))
        # trees joined by these edges: each follows its edge until the two that took one and the same edge, of which the smaller is the root
        step = least.select(*skeleton, "root", F.col("e.to").alias("to"))
        back = step.select(*skeleton, F.col("root").alias("to"), F.col("to").alias("_back"))
        up = step.join(back, [*skeleton, "to"], "left").select(*skeleton, "root", F.expr("CASE WHEN _back = root AND root < to THEN root ELSE to END").alias("to"))
        while True:
            up = materialize(up)
            ahead = up.select(*skeleton, F.col("root").alias("to"), F.col("to").alias("_next"))
            moved = up.join(ahead, [*skeleton, "to"]).withColumn("_moved", F.col("_next") != F.col("to"))
            moved = materialize(moved.select(*skeleton, "root", F.col("_next").alias("to"), "_moved"))
            up = moved.drop("_moved")
            if moved.where("_moved").isEmpty():
                break
        tree = materialize(tree.join(up, [*skeleton, "root"], "left").select(*skeleton, "node", F.coalesce("to", "root").alias("root")))
    further = further.where("_again IS NULL").join(tree.withColumnRenamed("node", "to"), [*skeleton, "to"])
    family = tree.select(*skeleton, "root").union(further.select(*skeleton, "root")).groupBy(*skeleton, "root").agg(F.count("*").cast("int").alias("family"))
    kept = kept.join(tree.withColumnRenamed("node", "a"), [*skeleton, "a"]).select(*skeleton, "a", "b", "diffs", "root")
    kept = kept.union(further.select(*skeleton, F.least("a", "to"), F.greatest("a", "to"), "diffs", "root"))
    return kept.join(family, [*skeleton, "root"]).select(*skeleton, "a", "b", "diffs", "family")


def lean_and_rich(sites: DataFrame, least: float = 0.25) -> DataFrame:
    """Sites of one enum with part of its variants, each against richer kin: enum, lean, missing, best rich, score, more.

    sites: enum, site, file, ord, variants (array). Sites with the same variants in one file are one class, so the self-join is
    over distinct sets, which the enum's size bounds, not over sites. Kinship: 1.0 within a file, else 0.5. Of each lean site and
    missing set the best exemplar is kept with the number of others.
    """
    sites = sites.withColumn("variants", F.array_sort("variants"))
    classes = sites.groupBy("enum", "file", "variants").agg(F.min(F.struct("ord", "site")).alias("first"), F.count("*").alias("n"))
    lean = classes.select("enum", F.col("file").alias("lean_file"), F.col("variants").alias("lean_set"), F.col("n").alias("lean_n"), F.col("first.site").alias("lean_site"))
    rich = classes.select("enum", F.col("file").alias("rich_file"), F.col("variants").alias("rich_set"), F.col("n").alias("rich_n"), F.col("first.site").alias("rich_site"), F.col("first.ord").alias("rich_ord"))
    met = lean.join(rich, "enum").where("arrays_overlap(lean_set, rich_set) AND size(rich_set) >= size(lean_set)").withColumn("missing", F.array_except("rich_set", "lean_set")).where("size(missing) > 0")
    kin = F.when(F.col("lean_file") == F.col("rich_file"), 1.0).otherwise(0.5)
    met = met.withColumn("score", scores.divergence(F.size(F.array_intersect("lean_set", "rich_set")), F.size("rich_set"), F.size("missing"), kin, F.lit(False))).where(F.col("score") >= least)
    w = W.partitionBy("enum", "lean_file", "lean_set", "missing")
    best = met.withColumn("more", F.sum("rich_n").over(w) - 1).withColumn("_rn", F.row_number().over(w.orderBy(F.desc("score"), "rich_ord", "rich_site"))).where("_rn = 1")
    return best.select("enum", F.col("lean_site").alias("site"), F.col("lean_n").alias("sites"), F.array_join("lean_set", ",").alias("has"), F.array_join("missing", ",").alias("missing_here"), F.round("score", 6).alias("score"), F.col("rich_site").alias("vs"), "more")


def mutual(df: DataFrame, kind: list[str], src: str, dst: str, site: str) -> DataFrame:
    """Conversions that exist both ways, each pair once with the smaller end first; of repeated ones the last site counts."""
    one = df.groupBy(*kind, F.col(src).alias("a"), F.col(dst).alias("b")).agg(F.max(site).alias("at")).where("a <> b")
    back = one.select(*kind, F.col("b").alias("a"), F.col("a").alias("b"), F.col("at").alias("reverse_at"))
    return one.where("a < b").join(back, [*kind, "a", "b"])


def care_gaps(df: DataFrame, by: list[str], site: str, care: str, gap: int = 2) -> DataFrame:
    """Sites that treat what others of their group treat with more care: by, site, care, best, gap, siblings. The group's most careful site stands for all that are."""
    best = df.groupBy(*by).agg(F.max(care).alias("best"), F.count("*").alias("_n"))
    return df.join(best, by).where(F.col("best") - F.col(care) >= gap).select(*by, F.col(site).alias("site"), F.col(care).alias("care"), "best", (F.col("best") - F.col(care)).alias("gap"), (F.col("_n") - 1).alias("siblings"))


def nearest(left: DataFrame, right: DataFrame, by: list[str], at: str, ident: str) -> DataFrame:
    """For each row of left the row of right in its group whose `at` is nearest, either way; the earlier of equals, then the smaller ident.

    Both sides are one stream sorted by group and place, so a group is scanned once and never paired with itself.
    """
    both = left.select(*by, at, F.lit(0).alias("_side"), F.col(ident).alias("_id")).unionByName(right.select(*by, at, F.lit(1).alias("_side"), F.col(ident).alias("_id")))
    hit = F.when(F.col("_side") == 1, F.struct(F.col(at), F.col("_id")))
    w = W.partitionBy(*by).orderBy(at, "_side", "_id")
    # the last place at or before, of which the first ident; and the first place after
    before = F.max(F.when(F.col("_side") == 1, F.col(at))).over(W.partitionBy(*by).orderBy(at).rangeBetween(W.unboundedPreceding, 0))
    after = F.min(F.when(F.col("_side") == 1, F.col(at))).over(W.partitionBy(*by).orderBy(at).rangeBetween(0, W.unboundedFollowing))
    del hit, w
    places = right.groupBy(*by, F.col(at).alias("_to")).agg(F.min(ident).alias(f"near_{ident}"))
    seen = both.withColumn("_b", before).withColumn("_a", after).where("_side = 0").withColumn("_to", F.expr(f"CASE WHEN _b IS NULL THEN _a WHEN _a IS NULL OR {at} - _b <= _a - {at} THEN _b ELSE _a END"))
    return seen.join(places, [*by, "_to"]).select(*by, F.col("_id").alias(ident), at, F.col("_to").alias(f"near_{at}"), f"near_{ident}")


def range_hits(points: DataFrame, spans: DataFrame, by: str, at: Column, start: Column, end: Column, width: float, how: str = "left_semi") -> DataFrame:
    """Points inside (left_semi) or outside (left_anti) any span of their group. Spans are cut into bins of `width`, so a hot group is joined bin by bin, not whole."""
    cut = spans.select(F.col(by).alias("_by"), start.alias("_s"), end.alias("_e")).where("_s <= _e")
    cut = cut.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("_s") / width), F.floor(F.col("_e") / width))))
    p = points.withColumn("_at", at).withColumn("_pbin", F.floor(F.col("_at") / width))
    return p.join(cut, (p[by] == cut["_by"]) & (p["_pbin"] == cut["_bin"]) & (p["_at"] >= cut["_s"]) & (p["_at"] <= cut["_e"]), how).drop("_at", "_pbin")
